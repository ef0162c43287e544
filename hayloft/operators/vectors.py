"""Embedding tables and exact vector search.

``vectors(item_id, kind, frame, vec, text_sha)`` stays where it lies: the query batch travels to it.
Queries up to a checked size are shipped to the tasks as one matrix, each Arrow batch is scored by a
matrix product, and an item's frames and a list's tail are reduced before anything is shuffled. A
larger query batch is cut into blocks that each meet the stream of their kind's vectors (``_blocked_scores``).
Products are made a bounded number at a time, so memory depends neither on the batch nor on the collection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.functions.scoring import RANK_DIGITS
from hayloft.operators import digests, fusion
from hayloft.session import checkpointed

QUERY_MATRIX_ROWS = 20_000
MULTI_KINDS = ("V",)  # video frames: several vectors per item
CELLS = 2_000_000  # products a task holds at once
LEAST_BLOCK = 500  # queries of a block, at least: each block passes over all vectors of its kind
HELD = 4_000_000  # rows a task holds of the lists it is making: queries of a block x k, and as many candidates
SCORES = "query_id long, kind string, item_id long, score double"
_ARROW_SCORES = pa.schema(
    [("query_id", pa.int64()), ("kind", pa.string()), ("item_id", pa.int64()), ("score", pa.float64())]
)


def as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column -> float64 matrix; every list must have the same length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = np.unique(flat.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of one kind have lengths {widths.tolist()}")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _reduce_block(items, matrix, query_ids, query_matrix, kind, k, limits=None) -> Iterator[pa.RecordBatch]:
    """One kind's block of vectors x queries -> score rows, best frame per item; ``CELLS`` products at once.

    Products below a query's limit become minus infinity.
    """
    order = np.argsort(items, kind="stable")
    items, starts = np.unique(items[order], return_index=True)
    matrix = matrix[order]
    per_emit = max(1, CELLS // len(matrix))
    for lo in range(0, len(query_ids), per_emit):
        ids = query_ids[lo : lo + per_emit]
        part = matrix @ query_matrix[lo : lo + per_emit].T
        if limits is not None:
            part[np.round(part, RANK_DIGITS) < limits[lo : lo + per_emit]] = -np.inf
        if len(items) < len(matrix):
            part = np.maximum.reduceat(part, starts, axis=0)
        yield from _best_rows(items, np.round(part, RANK_DIGITS) + 0.0, ids, kind, k)


def _best_rows(items, part, ids, kind, k) -> Iterator[pa.RecordBatch]:
    """Score rows of ascending items x queries, the best ``k`` of each query."""
    if k is not None and len(items) > k:
        # items ascend, so a stable sort on the negated score breaks ties on the item
        rows = np.argsort(-part, axis=0, kind="stable")[:k]
    else:
        rows = np.broadcast_to(np.arange(len(items))[:, None], part.shape)
    scores = np.take_along_axis(part, rows, axis=0)
    yield _score_rows(np.broadcast_to(ids, rows.shape).ravel(), kind, items[rows].ravel(), scores.ravel())


def _score_rows(query_ids, kind, items, scores) -> pa.RecordBatch:
    kinds = pa.array([kind]).take(pa.array(np.zeros(len(scores), dtype=np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(query_ids), kinds, pa.array(items), pa.array(scores)], schema=_ARROW_SCORES)


def _score_table(vec_batch, queries: Mapping[str, tuple[np.ndarray, np.ndarray]], k) -> Iterator[pa.RecordBatch]:
    kinds = np.asarray(vec_batch.column("kind").to_pylist(), dtype=object)
    items = vec_batch.column("item_id").to_numpy()
    for kind, (query_ids, query_matrix) in queries.items():
        rows = np.flatnonzero(kinds == kind)
        if len(rows) and len(query_ids):
            # a matrix for each kind: kinds differ in the length of their vectors
            matrix = as_matrix(vec_batch.column("vec").take(pa.array(rows)))
            yield from _reduce_block(items[rows], matrix, query_ids, query_matrix, kind, k)


def _by_kind(queries: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    kinds = np.asarray(queries.column("kind").to_pylist(), dtype=object)
    ids = queries.column("query_id").to_numpy()
    out = {}
    if len(ids):
        for kind in sorted(set(kinds)):
            rows = np.flatnonzero(kinds == kind)
            out[kind] = (ids[rows], as_matrix(queries.column("vec").take(pa.array(rows))))
    return out


def similarity(
    vectors: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    multi: Sequence[str] = MULTI_KINDS,
    merge: bool = True,
    matrix_rows: int = QUERY_MATRIX_ROWS,
) -> DataFrame:
    """(query_id, kind, item_id, score): inner product of each query with each vector of its kind.

    ``queries(query_id, kind, vec)``. An item with several vectors of a kind (``multi``) gets its best
    one; kinds with one vector per item need no grouping for that. ``k`` keeps the k best items per
    query and kind, ``None`` keeps all. With ``merge=False`` an item of a multi-vector kind may come
    in several rows, for a caller that takes the maximum anyway.
    """
    vectors = vectors.where("vec is not null").select("item_id", "kind", "vec")
    queries = queries.where("vec is not null").select("query_id", "kind", "vec")
    head = queries.limit(matrix_rows + 1).toArrow()  # bounded: one row above the limit at most
    if head.num_rows <= matrix_rows:
        by_kind = _by_kind(head)
        if not by_kind:
            return vectors.sparkSession.createDataFrame([], SCORES)
        shipped = vectors.sparkSession.sparkContext.broadcast(by_kind)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _score_table(batch, shipped.value, k)

        partial = vectors.where(F.col("kind").isin(*by_kind)).mapInArrow(score, SCORES)
        merge = merge and bool(set(multi) & set(by_kind))
    else:
        # whole lists, each item once
        return _blocked_scores(vectors, checkpointed(queries), k, matrix_rows)
    merged = partial.groupBy("query_id", "kind", "item_id").agg(F.max("score").alias("score")) if merge else partial
    return merged if k is None else fusion.rank(merged, ("query_id", "kind"), limit=k).drop("rank")


def _blocked_scores(vectors: DataFrame, queries: DataFrame, k, block_rows: int) -> DataFrame:
    """Query blocks, each with the stream of all vectors of its kind in the order of their items.

    A task holds one block and the best ``k`` of each of its queries so far; vectors pass by. So a list leaves its
    task whole and final, and neither pairs nor heads of lists are shuffled: only one copy of a kind's vectors for each block.
    Blocks are dealt by a hash of the query, and are small enough to employ all cores.
    """
    counts = {r["kind"]: r["count"] for r in queries.groupBy("kind").count().collect()}
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = min(block_rows, max(1, HELD // (k or 1)), max(LEAST_BLOCK, math.ceil(sum(counts.values()) / (2 * cores))))
    blocks = {kind: math.ceil(n / rows) for kind, n in counts.items()}
    many = F.create_map(*[F.lit(x) for kind, n in blocks.items() for x in (kind, n)])[F.col("kind")]
    block = F.pmod(F.xxhash64("query_id", "kind"), many).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))).alias("block")
    vec = F.col("vec").cast("array<double>") if vectors.schema["vec"].dataType != queries.schema["vec"].dataType else F.col("vec")
    asked = queries.select("kind", block, F.lit(0).alias("side"), F.col("query_id").alias("id"), vec.alias("vec"))
    passing = vectors.where(F.col("kind").isin(*blocks)).select("kind", every, F.lit(1).alias("side"), F.col("item_id").alias("id"), vec.alias("vec"))
    # as many partitions as blocks, some with several: a task works on one block after the other
    dealt = asked.unionByName(passing).repartition(sum(blocks.values()), "kind", "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            kinds, numbers = np.asarray(batch.column("kind").to_pylist(), dtype=object), batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (numbers[1:] != numbers[:-1])) + 1).tolist(), len(kinds)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    name = kinds[lo], int(numbers[lo])
                    if work is None or work.name != name:
                        if work is not None:
                            yield from work.ended()
                        work = _Block(name, k)
                    side, ids, vecs = (batch.column(c).slice(lo, hi - lo) for c in ("side", "id", "vec"))
                    first = int(np.searchsorted(side.to_numpy(), 1))
                    if first:
                        work.ask(ids.slice(0, first).to_numpy(), as_matrix(vecs.slice(0, first)))
                    if first < hi - lo:
                        yield from work.meet(ids.slice(first).to_numpy(), as_matrix(vecs.slice(first)))
        if work is not None:
            yield from work.ended()

    return dealt.sortWithinPartitions("kind", "block", "side", "id").mapInArrow(score, SCORES)


class _Block:
    """Queries of a block and their lists while the vectors pass, in the order of items."""

    def __init__(self, name: tuple[str, int], k: int | None):
        self.name, self.kind, self.k = name, name[0], k
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids = self.matrix = self.starts = None
        self.rest = (np.zeros(0, np.int64), None)  # vectors of the last item: more of them may follow
        self.limit = None  # the k-th best score of each query so far
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query's place, item, score
        self.held = 0

    def ask(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.asked.append((ids, matrix))

    def meet(self, items: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(self.rest[0]):
            items, matrix = np.concatenate([self.rest[0], items]), np.concatenate([self.rest[1], matrix])
        whole = int(np.searchsorted(items, items[-1]))
        self.rest = items[whole:], matrix[whole:]
        yield from self._scored(items[:whole], matrix[:whole])

    def ended(self) -> Iterator[pa.RecordBatch]:
        yield from self._scored(*self.rest)
        if self.k is not None:
            self._cut()
            for query, item, score in self.found:
                for lo in range(0, len(query), CELLS):
                    some = slice(lo, lo + CELLS)
                    yield _score_rows(self.ids[query[some]], self.kind, item[some], score[some])

    def _scored(self, items: np.ndarray, matrix: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if self.ids is None and self.asked:
            ids, matrix_of = (np.concatenate(x) for x in zip(*self.asked))
            # rows of one query are one list
            order = np.argsort(ids, kind="stable")
            self.matrix = matrix_of[order]
            self.ids, self.starts = np.unique(ids[order], return_index=True)
            self.limit, self.asked = np.full(len(self.ids), -np.inf), []
        if not len(items) or self.ids is None:
            return
        begins = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
        ends = np.append(begins[1:], len(items))
        least = max(1, CELLS // len(self.matrix))
        first = 0
        while first < len(begins):
            last = max(first + 1, int(np.searchsorted(ends, begins[first] + least, side="right")))
            rows = slice(begins[first], ends[last - 1])
            best = self.matrix @ matrix[rows].T
            if best.shape[1] > last - first:
                best = np.maximum.reduceat(best, begins[first:last] - begins[first], axis=1)
            if len(self.ids) < len(self.matrix):
                best = np.maximum.reduceat(best, self.starts, axis=0)
            yield from self._kept(items[begins[first:last]], best)
            first = last

    def _kept(self, items: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.k is None:
            score = np.round(best, RANK_DIGITS) + 0.0
            yield _score_rows(np.repeat(self.ids, len(items)), self.kind, np.tile(items, len(self.ids)), score.ravel())
            return
        # an item that comes later goes behind its equals, so it must be better than the k-th
        query, item = np.nonzero(best > self.limit[:, None])
        score = np.round(best[query, item], RANK_DIGITS) + 0.0
        better = np.flatnonzero(score > self.limit[query])
        self.found.append((query[better], items[item[better]], score[better]))
        self.held += len(better)
        if self.held > len(self.ids) * self.k + HELD // 2:
            self._cut()

    def _cut(self) -> None:
        """The best ``k`` of each query among what is held, and the limits that follow."""
        if not self.found:
            return
        query, item, score = (np.concatenate(x) for x in zip(*self.found))
        # items ascend among equals, which stable sorts keep; few distinct queries sort by digits
        order = np.argsort(-score, kind="stable")
        order = order[np.argsort(query[order].astype(np.min_scalar_type(len(self.ids))), kind="stable")]
        query, item, score = query[order], item[order], score[order]
        many = np.bincount(query, minlength=len(self.ids))
        place = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
        keep = place < self.k
        full = place == self.k - 1
        self.limit[query[full]] = score[full]
        self.found = [(query[keep], item[keep], score[keep])]
        self.held = int(keep.sum())


def search_kinds(vectors: DataFrame, queries: DataFrame, kinds: Sequence[str], k: int | None = None) -> DataFrame:
    """``similarity`` of one vector per query against several kinds of vectors."""
    asked = queries.withColumn("kind", F.explode(F.array(*[F.lit(x) for x in kinds])))
    return similarity(vectors, asked, k)


def combined(
    vectors: DataFrame, queries: DataFrame, weights: Mapping[str, float], k: int | None = None, dealt_by: tuple[str, Column] | None = None
) -> DataFrame:
    """Search over several kinds fused by the greatest weighted score; kinds of weight 0 are not searched.

    ``dealt_by`` names a column made of ``query_id`` that the lists are dealt by and that comes with them: what follows per
    value of it needs no other exchange.
    """
    used = {kind: w for kind, w in weights.items() if w}
    found = search_kinds(vectors, queries, list(used), k)
    if dealt_by is None:
        return fusion.max_weighted(found, used, "kind")
    name, value = dealt_by
    return fusion.max_weighted(found.withColumn(name, value).repartition(name), used, "kind", (name, "query_id"))


def by_item(store: DataFrame) -> DataFrame:
    """(item_id, one column of vectors for each kind): what several kinds say about an item can be settled where its row is."""
    kinds = (*S.KIND_TEXT_FIELD, *S.CLIP_KIND_WEIGHTS)
    lists = [F.collect_list(F.when(F.col("kind") == k, F.col("vec"))).alias(k) for k in kinds]
    return store.where("vec is not null").groupBy("item_id").agg(*lists)


# --- embedding store ------------------------------------------------------------------------------


def to_store(wide: DataFrame, texts: Mapping[str, str], kinds: Mapping[str, str]) -> DataFrame:
    """One column per kind -> long rows; nulls vanish, text kinds carry the hash of their text.

    ``kinds`` maps kind to vector column, ``texts`` maps text kinds to the text column. Columns that
    hold a list of vectors (frames) give one row per vector.
    """
    cells = []
    for kind, column in kinds.items():
        dtype = wide.schema[column].dataType
        vecs = F.col(column) if dtype.elementType.typeName() == "array" else F.array(F.col(column))
        sha = F.sha2(F.col(texts[kind]), 256) if kind in texts else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(kind).alias("kind"), vecs.alias("vecs"), sha.alias("text_sha")))
    return (
        wide.select("item_id", F.explode(F.array(*cells)).alias("c"))
        .select("item_id", "c.kind", F.posexplode("c.vecs").alias("frame", "vec"), "c.text_sha")
        .where("vec is not null")
    )


def consistent(store: DataFrame, current_texts: DataFrame) -> DataFrame:
    """Stored vectors whose text hash equals that of the current text ``(item_id, kind, text)``.

    A row without expected text (pixel kinds, or no text given) is not checked.
    """
    expected = current_texts.select("item_id", "kind", F.sha2("text", 256).alias("expected_sha"))
    return (
        store.join(expected, ["item_id", "kind"], "left")
        .where(F.col("expected_sha").isNull() | (F.col("text_sha") == F.col("expected_sha")))
        .drop("expected_sha")
    )


def with_texts(store: DataFrame, current_texts: DataFrame) -> DataFrame:
    """Every stored vector with the current text attached, valid or not."""
    return store.join(current_texts.select("item_id", "kind", "text"), ["item_id", "kind"], "left")


def embedded_items(store: DataFrame) -> DataFrame:
    return store.select("item_id").distinct()


def vector_of(store: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    return store.where(F.col("kind") == kind).join(items.select("item_id"), "item_id", "left_semi")


def upsert(store: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Replace all vectors of each changed (item, kind), drop the deleted ones, keep the rest."""
    keys = ["item_id", "kind"]
    touched = changed.select(*keys).distinct()
    if deleted is not None:
        touched = touched.unionByName(deleted.select(*keys)).distinct()
    return store.join(touched, keys, "left_anti").unionByName(changed.select(*store.columns))


def expected_texts(files: DataFrame) -> DataFrame:
    """(item_id, kind, text) a stored text vector must match; empty where the file has none."""
    texts = {
        "D": F.coalesce("description", F.lit("")),
        "O": F.when(F.col("is_screenshot"), F.coalesce("ocr_text", F.lit(""))).otherwise(""),
        "T": F.when(F.col("is_transcript_analyzed"), F.coalesce("transcript", F.lit(""))).otherwise(""),
        "L": F.when(F.col("is_llm_description_analyzed"), F.coalesce("llm_description", F.lit(""))).otherwise(""),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in texts.items()])
    return files.select(F.col("id").alias("item_id"), F.explode(cells).alias("c")).select("item_id", "c.*")


def wanted_embeddings(files: DataFrame) -> DataFrame:
    """(item_id, kind, text) that should have a vector; text is null for pixel kinds."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    ok = ~F.coalesce(F.col("embedding_generation_failed"), F.lit(False))
    rules = [
        ("D", has("description"), F.col("description")),
        ("O", F.col("is_screenshot") & F.col("is_ocr_analyzed") & has("ocr_text"), F.col("ocr_text")),
        ("T", F.col("is_transcript_analyzed") & has("transcript"), F.col("transcript")),
        ("L", F.col("is_llm_description_analyzed") & has("llm_description"), F.col("llm_description")),
        ("C", (F.col("ftype") == "image") & ok, F.lit(None).cast("string")),
        ("V", (F.col("ftype") == "video") & ok, F.lit(None).cast("string")),
    ]
    cells = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.coalesce(cond, F.lit(False)).alias("wanted"), t.alias("text")) for k, cond, t in rules]
    )
    return (
        files.select(F.col("id").alias("item_id"), F.explode(cells).alias("c"))
        .where("c.wanted")
        .select("item_id", "c.kind", "c.text")
    )


def work_list(files: DataFrame, store: DataFrame) -> DataFrame:
    """(item_id, kind, action): what an embedding run has to do to bring the store up to date.

    create: wanted and missing; stale: stored for another text; keep: valid; drop: the file is gone or
    its text is. Pixel vectors of a known file are kept even when they would not be made again. Buckets of
    items whose wanted and stored digests agree are kept without a join.
    """
    wanted = wanted_embeddings(files).select("item_id", "kind", F.sha2("text", 256).alias("sha"))
    stored = store.groupBy("item_id", "kind").agg(F.max("text_sha").alias("sha"))
    parts = digests.compare(stored, wanted, ["item_id", "kind"], ["sha"])
    known = files.select(F.col("id").alias("item_id"), F.lit(True).alias("known"))
    wanted = parts.right.withColumnRenamed("sha", "want_sha").withColumn("wanted", F.lit(True))
    stored = parts.left.withColumnRenamed("sha", "have_sha").join(known, "item_id", "left").withColumn("stored", F.lit(True))
    pixels = ~F.col("kind").isin(*S.KIND_TEXT_FIELD)
    action = (
        F.when(F.col("stored").isNull(), "create")
        .when(F.col("wanted").isNull() & pixels & F.col("known"), "keep")
        .when(F.col("wanted").isNull(), "drop")
        .when(F.col("want_sha").isNull() | (F.col("want_sha") == F.col("have_sha")), "keep")
        .otherwise("stale")
    )
    settled = parts.same.select("item_id", "kind", F.lit("keep").alias("action"))
    return settled.unionByName(wanted.join(stored, ["item_id", "kind"], "full_outer").select("item_id", "kind", action.alias("action")))
