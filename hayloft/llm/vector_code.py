"""Short codes for vectors: product codebooks learned by Lloyd rounds over members that stay where they are.

A vector is cut into equal parts, each position has a codebook of its own, and a part's code is its nearest entry. A part
is a *member* of the entry it was assigned to, kept with the other members of (position, entry, salt): its owner. A round

1. looks at the members where they lie: those whose nearest entry has changed leave, and only they go through a shuffle,
   to their new owners, where they are written as a layer of their own;
2. lets each owner add up the members it has now; one row per task, position and entry leaves it, and the new
   codebook (parts x entries rows, whatever the input) goes through the driver.

Layers are written to the shared folder and never rewritten. Whether a member of an older layer has left meanwhile
follows from the codebooks since that layer, so nothing but vectors that move is written twice. Salts split an
entry's members into owners of about ``OWNER_PARTS`` parts: an entry that holds a third of all rows, or all of them, is
many owners.

Arithmetic is in integers: a component x becomes floor(scale * x), distances are squared Euclidean, means are rounded down.
It is exact: products below 2**53 are formed in doubles, larger ones in Python's integers.

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite component is left out; so is one whose length
differs from that of the first kept vector, as it has no place in its codebooks. Rows that share a key, also null, are
rows of their own; null keys come last, vectors with the same key by their components. Fewer rows than entries: a
codebook of as many entries. An empty table: no rows, an empty codebook. Null labels are one label. Components of 2**50 or more
stop the job. Columns other than key, vector and label are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import release, stored

OWNER_PARTS = 65_536
# Parts worked on at a time; sixteen distances of eight bytes each.
CHUNK = 65_536
# Codebooks of so many labels travel to the tasks; more are joined by a shuffle.
SMALL_LABELS = 100_000

Book = list[np.ndarray]  # per position: entries x width

MEMBER = "row long, position int, entry int, part array<long>, key long, label long"
CODED = "row long, position int, entry int, distance long, key long, label long"
SUMS = "position int, entry int, count long, total array<long>"


class Coded(NamedTuple):
    codes: DataFrame  # key, label, code, error
    books: Book


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (the lowest of equals) and the squared distance."""
    if not part.size:
        return np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    most = 2 * max(int(np.abs(part).max()), int(np.abs(book).max()))
    if part.shape[1] * most**2 < 2**53:
        part, book = part.astype(np.float64), book.astype(np.float64)
        # the part's own square is the same for all entries
        from_zero = (part**2).sum(1)
        distance = (book**2).sum(1) - 2 * (part @ book.T)
        entry = distance.argmin(1)
        return entry, (distance[np.arange(len(part)), entry] + from_zero).astype(np.int64)
    part, book = part.astype(object), book.astype(object)
    distance = np.stack([((part - b) ** 2).sum(1) for b in book], 1)
    entry = distance.argmin(1)
    return entry, distance[np.arange(len(part)), entry].astype(np.int64)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            yield batch.slice(start, CHUNK)
    release()


def _each_position(position: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for k in np.unique(position):
        yield int(k), np.flatnonzero(position == k)


def _first_members(book: Book, scale: int):
    """Whole vectors cut into parts, each with its nearest entry."""
    parts, width = len(book), book[0].shape[1]

    def cut(batches):
        for batch in _chunks(batches):
            whole = np.floor(_matrix(batch.column("vector"), parts * width).astype(np.float64) * scale)
            if whole.size and np.abs(whole).max() >= 2.0**62:
                raise ValueError("components of 2**50 or more have no exact integer here")
            whole = whole.astype(np.int64)
            rows = batch.column("row")
            for k in range(parts):
                part = np.ascontiguousarray(whole[:, k * width : (k + 1) * width])
                entry, _ = nearest(part, book[k])
                none = pa.nulls(len(part), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, width, dtype=np.int32)), pa.array(part.ravel()))
                columns = [rows, pa.array(np.full(len(part), k, np.int32)), pa.array(entry.astype(np.int32)), lists]
                columns += [none, none] if k else [batch.column("key"), batch.column("label")]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "position", "entry", "part", "key", "label"])

    return cut


def _resident(batch: pa.RecordBatch, books: list[Book]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of members that came to a layer: those that stayed under all codebooks but the last, and what the last one says.

    Returns row numbers in the batch, entries and distances under the last codebook.
    """
    position = batch.column("position").to_numpy()
    entry = batch.column("entry").to_numpy()
    matrix = _matrix(batch.column("part"), books[0][0].shape[1])
    left, now, far = [], [], []
    for k, rows in _each_position(position):
        for book in books[:-1]:
            rows = rows[nearest(matrix[rows], book[k])[0] == entry[rows]]
        code, distance = nearest(matrix[rows], books[-1][k])
        left.append(rows)
        now.append(code)
        far.append(distance)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(now), np.concatenate(far)


def _movers(books: list[Book]):
    """Members that the last codebook gives to another entry, with that entry."""

    def move(batches):
        for batch in _chunks(batches):
            rows, code, _ = _resident(batch, books)
            changed = code != batch.column("entry").to_numpy()[rows]
            gone = batch.take(pa.array(rows[changed]))
            yield gone.set_column(2, "entry", pa.array(code[changed].astype(np.int32)))

    return move


def _owned_sums(books: list[Book]):
    """Count and sum of the members that are still here, one row per position and entry a task has seen.

    ``books``: those since the layer was written, none for the newest one.
    """

    def add(batches):
        totals: dict[tuple[int, int], list] = {}
        for batch in _chunks(batches):
            entry = batch.column("entry").to_numpy()
            if books:
                rows, code, _ = _resident(batch, books)
                rows = rows[code == entry[rows]]
            else:
                rows = np.arange(batch.num_rows)
            if not len(rows):
                continue
            offsets = batch.column("part").value_lengths()
            matrix = _matrix(batch.column("part"), offsets[0].as_py())
            position = batch.column("position").to_numpy()
            owner = position[rows].astype(np.int64) << 32 | entry[rows]
            order = np.argsort(owner, kind="stable")
            names, first = np.unique(owner[order], return_index=True)
            sums = np.add.reduceat(matrix[rows[order]], first, axis=0)
            counts = np.diff(np.append(first, len(order)))
            for name, n, s in zip(names.tolist(), counts.tolist(), sums.tolist()):
                old = totals.setdefault((name >> 32, name & 0xFFFFFFFF), [0, [0] * len(s)])
                old[0] += n
                old[1] = [a + b for a, b in zip(old[1], s)]
        keys = sorted(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([totals[k][0] for k in keys], pa.int64()),
                pa.array([totals[k][1] for k in keys], pa.list_(pa.int64())),
            ],
            names=["position", "entry", "count", "total"],
        )

    return add


def _coded(books: list[Book]):
    """Members that are still here, with their entry and distance under the last codebook."""

    def code(batches):
        for batch in _chunks(batches):
            rows, entry, distance = _resident(batch, books)
            kept = batch.take(pa.array(rows))
            columns = [kept.column("row"), kept.column("position"), pa.array(entry.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays([*columns, kept.column("key"), kept.column("label")], names=["row", "position", "entry", "distance", "key", "label"])

    return code


def kept(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(key, label, vector)`` of rows with a vector of finite components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return chosen.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def first_book(vectors: DataFrame, parts: int, entries: int, scale: int) -> Book:
    """The parts of the vectors with the smallest keys; empty for an empty table."""
    seeds = vectors.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    if not seeds:
        return []
    width, rest = divmod(len(seeds[0]["vector"]), parts)
    if rest:
        raise ValueError(f"vectors of {len(seeds[0]['vector'])} components cannot be cut into {parts} equal parts")
    whole = np.array([np.floor(np.array(s["vector"]) * scale) for s in seeds if len(s["vector"]) == parts * width]).astype(np.int64)
    return [whole[:, k * width : (k + 1) * width] for k in range(parts)]


def _next_book(book: Book, layers: list[DataFrame], since: list[list[Book]]) -> Book:
    sums = None
    for layer, books in zip(layers, since):
        part = layer.mapInArrow(_owned_sums(books), SUMS)
        sums = part if sums is None else sums.unionAll(part)
    per_component = sums.select("position", "entry", "count", F.posexplode("total"))
    added = per_component.groupBy("position", "entry", "pos").agg(F.sum("count").alias("count"), F.sum("col").alias("total")).collect()
    new = [b.copy() for b in book]
    for r in added:
        new[r["position"]][r["entry"], r["pos"]] = r["total"] // r["count"]
    return new


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Coded:
    """Codes of all vectors and the codebooks after ``rounds`` rounds of Lloyd's method.

    ``codes`` has key, label, code (two hex digits for each position) and error (squared distances added up).
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each position")
    vectors = kept(rows, key, vector, label)
    spark = rows.sparkSession
    book = first_book(vectors, parts, entries, scale)
    if not book:
        return Coded(spark.createDataFrame([], "key long, label long, code string, error long"), [])
    vectors = vectors.where(F.size("vector") == sum(b.shape[1] for b in book))
    salts = 1 + vectors.count() // OWNER_PARTS

    def settled(members: DataFrame, name: str) -> DataFrame:
        salt = F.pmod(F.xxhash64("row"), F.lit(salts))
        return stored(members.repartition("position", "entry", salt), name)

    numbered = vectors.withColumn("row", F.monotonically_increasing_id())
    layers = [settled(numbered.mapInArrow(_first_members(book, scale), MEMBER), "members")]
    # since[k]: the codebooks that layer k's members have met after they came to it
    since: list[list[Book]] = [[]]
    for turn in range(rounds):
        if turn:
            leaving = [layer.mapInArrow(_movers([*books, book]), MEMBER) for layer, books in zip(layers, since)]
            moved = leaving[0]
            for more in leaving[1:]:
                moved = moved.unionAll(more)
            since = [[*books, book] for books in since] + [[]]
            layers.append(settled(moved, "movers"))
        book = _next_book(book, layers, since)
    coded = None
    for layer, books in zip(layers, since):
        part = layer.mapInArrow(_coded([*books, book]), CODED)
        coded = part if coded is None else coded.unionAll(part)
    place = F.expr(f"shiftleft(cast(entry as bigint), 8 * ({parts} - 1 - position))") if parts <= 8 else None
    if place is not None:
        code = F.lower(F.lpad(F.hex(F.sum(place)), 2 * parts, "0"))
    else:
        code = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))))
    grouped = coded.groupBy("row").agg(F.max("key").alias("key"), F.max("label").alias("label"), code.alias("code"), F.sum("distance").alias("error"))
    return Coded(grouped.drop("row"), book)


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the error added up over the rows of equal label."""
    codes = stored(codes, "codes")
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    small = totals.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS
    return codes.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def digest(books: Book) -> str:
    """Hash of all entries' components, by position and entry."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
