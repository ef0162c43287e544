"""Exact Jaccard self-join of word shingle sets with filters under several token orders.

A shingle is a hashed run of words; a text with fewer words is one shingle as a whole. Equal sets are
one class. Two classes whose sets A and B have ``4 |A n B| >= 3 |A u B|`` share a token in their
prefixes under *every* global order of tokens, so a pair is verified only if it does under all of:

* **rare first** among the lower half of the hashes (a relational index): of ``n`` tokens the
  ``ceil(n/2)`` lowest hashes stay, sharing at least a quarter of the larger set; sorted by document
  frequency, the first ``ceil(n/2) - max(1, n // 4) + 1`` of them must meet. Tokens of one document
  only are counted, not indexed;
* **highest hash first** and **scrambled hash first**, with prefixes of ``n - ceil(3n/4) + 1``.

Groups of copies are settled without pairs of all members. Each index entry has a pivot, the class
whose tokens are the most common; members are verified against it. Members linked to a pivot are
connected. Linked members that are not both linked to a pivot of theirs are found by comparing the
members of that pivot in blocks of bounded size: near ones (linked to the pivot), middle ones
(distance at most 1/2) and far ones. A near and a far one cannot link, as the Jaccard distance is a
metric. A block pair returns the links of a spanning forest of what it finds. So connectivity is
exact, and no group of any size meets in one task.

Defined cases: null and empty texts and texts without words have no tokens, link with nothing and are
their own component; repeated rows are copies; rows without an id link others like any row, and a group
of such rows only has no component id; ids are meant to be unique, and groups led by the same id come
out as one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayloft.llm.common import U64, coded, gram_hashes, hashes, keeping_ids, mixed, slices, split_words, stored
from hayloft.llm.components import components

SHINGLE = 5
BLOCK_ROWS, BLOCK_TOKENS = 64, 400_000
NEAR, MIDDLE, FAR = 0, 1, 2
BUCKET_TOKENS = 2_000_000  # tokens counted together, 8 MB
NUMBER = "decimal(20,0)"  # ids, and above all of them the numbers of classes without one


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, rows = split_words(text, lower=True)
    values, place = coded(flat)
    word = hashes(values)[place] if len(flat) else np.empty(0, U64)
    starts = np.searchsorted(rows, np.arange(len(text) + 1))
    grams = gram_hashes(word, size).view(np.int64)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            padded = np.concatenate([word[a:b], np.full(size - (b - a), 1 + b - a, U64)])
            out.append(gram_hashes(padded, size).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def _node(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def lower_half(tokens: np.ndarray) -> np.ndarray:
    return tokens[: (len(tokens) + 1) // 2]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_node, sets), pa.binary())], ["doc_id", "n", "node"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4_000_000):
        sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
        if sets:
            halves = list(map(lower_half, sets))
            at = pa.array(np.repeat(np.arange(len(sets)), [len(h) for h in halves]))
            nodes, sizes = pa.array(map(_node, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(halves)), nodes.take(at), sizes.take(at)], ["token", "node", "n"])


def _key_mask(buckets: int) -> int:
    """The bits of a token that name it while tokens are counted: those of its bucket, then 32 bits inside it."""
    return (buckets << 32) - 1


def _token_parts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.int64(_key_mask(buckets))
        for batch in slices(batches, "text"):
            halves = [lower_half(s) for s in shingle_sets(batch.column("text"))]
            keys, counts = np.unique(np.concatenate(halves) & mask, return_counts=True)
            names, starts = np.unique(keys >> 32, return_index=True)
            ends = np.append(starts[1:], len(keys))
            again = [a + np.flatnonzero(counts[a:b] > 1) for a, b in zip(starts, ends)]
            keys = keys.astype(np.uint32)  # the bits inside a bucket
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.astype(np.int64)),
                    pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([keys[x].tobytes() for x in again], pa.binary()),
                    pa.array([(counts[x] - 1).astype(np.int64).tobytes() for x in again], pa.binary()),
                ],
                ["bucket", "keys", "again", "more"],
            )

    return run


def _frequencies(group: pa.Table) -> pa.Table:
    """Keys of a bucket that several documents have."""
    keys, again, more = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group.column(c)]) for c, t in (("keys", np.uint32), ("again", np.uint32), ("more", np.int64)))
    keys, df = np.unique(keys, return_counts=True)
    np.add.at(df, np.searchsorted(keys, again), more)
    bucket = group.column("bucket")[0].as_py() << 32
    return pa.table({"key": bucket + keys[df > 1].astype(np.int64), "df": df[df > 1].astype(np.int64)})


def document_frequencies(texts: DataFrame, buckets: int) -> DataFrame:
    """``(key, df)`` of the lower-half tokens that several rows have; a token's key is its bits in ``_key_mask``.

    The tasks count their slices of the rows, so a frequent token is one entry of four bytes for each slice, and pack
    the tokens of a bucket into one value. Tokens of one key are counted together: all have the same, higher count
    then, which orders them as well as any other and never hides a token that several rows have.
    """
    parts = texts.mapInArrow(_token_parts(buckets), "bucket long, keys binary, again binary, more binary")
    return parts.groupBy("bucket").applyInArrow(_frequencies, "key long, df long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4_000_000):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"])


def prefix_length(n):
    return n - -(-3 * n // 4) + 1


def scrambled(tokens: np.ndarray) -> np.ndarray:
    """The tokens that come first when ordered by another hash of theirs."""
    key = mixed(tokens.view(U64).copy())
    return tokens[np.argsort(key)[: prefix_length(len(tokens))]]


def linked(a: np.ndarray, b: np.ndarray) -> int:
    """Kind of a pair: NEAR (linked), MIDDLE or FAR; middle or far only matters for pruning."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return NEAR if 4 * common >= 3 * union else MIDDLE if 2 * common >= union else FAR


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("pivot_tokens"), batch.column("tokens")
        kinds = [linked(left[k].values.to_numpy(), right[k].values.to_numpy()) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("node"), batch.column("n"), pa.array(kinds, pa.int32())], ["pivot", "node", "n", "kind"])


def _incidence(owner: np.ndarray, place: np.ndarray, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, width), np.float32)
    out[owner, place] = 1
    return out


def overlaps(sets: list[np.ndarray], tile: int = 16_384) -> np.ndarray:
    """Size of the intersection of each two sets."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[place] > 1
    owner, place = owner[keep], shared[place[keep]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared[-1]) + 1 if len(shared) else 0, tile):
        some = (place >= start) & (place < start + tile)
        matrix = _incidence(owner[some], place[some] - start, len(sets), tile)
        total += matrix @ matrix.T
    return total


def block_links(sets: list[np.ndarray], wanted: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the ``wanted`` pairs (a boolean matrix)."""
    n = np.array(list(map(len, sets)))
    wanted = wanted & (4 * np.minimum.outer(n, n) >= 3 * np.maximum.outer(n, n))
    for prefix in (lambda s: s[-prefix_length(len(s)) :], scrambled):
        if wanted.any():
            wanted = wanted & (overlaps(list(map(prefix, sets))) > 0)
    if not wanted.any():
        return []
    common = overlaps(sets)
    union = np.add.outer(n, n) - common
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for a, b in zip(*np.nonzero(np.triu(wanted | wanted.T, 1) & (4 * common >= 3 * union))):
        x, y = find(int(a)), find(int(b))
        if x != y:
            parent[y] = x
            found.append((int(a), int(b)))
    return found


def _block(group: pa.Table) -> pa.Table:
    sets = [np.asarray(s.values.to_numpy()) for s in group.column("tokens").combine_chunks()]
    left = group.column("left").to_numpy().astype(bool)
    right = group.column("right").to_numpy().astype(bool)
    nodes = group.column("node").combine_chunks()
    found = block_links(sets, np.logical_or(np.outer(left, right), np.outer(right, left)))
    a, b = ([nodes[pair[k]].as_py() for pair in found] for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, node)``: size of each text's set and the name of its class, null for an empty set."""
    return docs.select("doc_id", "text").mapInArrow(_classes, "doc_id long, n long, node binary")


def _some_without_id(named: DataFrame) -> bool:
    return named.where("doc_id is null and node is not null").limit(1).count() > 0


def _leaders(named: DataFrame) -> DataFrame:
    """``(node, leader)``: the smallest id of each class; if some rows have none, as a ``NUMBER``."""
    leaders = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("leader"))
    if not _some_without_id(named):
        return leaders
    # stored, as these numbers differ when computed again
    numbered = stored(leaders.where("leader is null").select("node", F.monotonically_increasing_id().alias("number")), "numbered")
    above = F.col("number").cast(NUMBER) + F.lit(Decimal(2**63)).cast(NUMBER)
    return leaders.where("leader is not null").select("node", F.col("leader").cast(NUMBER).alias("leader")).unionByName(numbered.select("node", above.cast(NUMBER).alias("leader")))


def _id(number: str):
    return F.when(F.col(number) < F.lit(Decimal(2**63)).cast(NUMBER), F.col(number).cast("long"))


def class_links(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between classes that connect what the similarity connects."""
    texts = docs.where(F.col("text").isNotNull())
    only = texts.select("text")
    n_tokens = named.agg(F.coalesce(F.sum((F.col("n") / 2).cast("long")), F.lit(0))).first()[0]
    buckets = 1 << (n_tokens // BUCKET_TOKENS).bit_length()
    common = document_frequencies(only, buckets)
    index = only.mapInArrow(_index, "token long, node binary, n long")
    kept = index.join(common.hint("shuffle_hash"), F.col("token").bitwiseAND(F.lit(_key_mask(buckets))) == F.col("key"))
    half = F.ceil(F.col("n") / 2)
    # the join has dealt the rows by key, so copies are dropped without another shuffle
    distinct = kept.select("key", "token", "node", "n", "df").distinct()
    own = Window.partitionBy("node")
    entries = (
        distinct.withColumn("place", F.row_number().over(own.orderBy("df", "token")))
        .withColumn("shared", F.count("*").over(own))
        .withColumn("weight", F.sum(F.log2("df")).over(own) / half)
        .where(F.col("place") <= F.col("shared") - F.greatest(F.lit(1), F.floor(F.col("n") / 4)) + 1)
        .select("node", "n", "weight", "token")
    )
    entries = stored(entries, "entries")
    pivots = entries.groupBy("token").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot"), F.min("node").alias("low"), F.max("node").alias("high"))
    met = entries.select("token", "node", "n").join(pivots.where("low <> high").select("token", "pivot"), "token")
    pairs = stored(met.where("node <> pivot").groupBy("pivot", "node").agg(F.first("n").alias("n")), "pairs")

    needed = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    readers = named.join(needed, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    by_id = readers.where("doc_id is not null").select("doc_id").distinct()
    sets = keeping_ids(texts.select("doc_id", "text"), by_id, "doc_id").mapInArrow(_sets, "node binary, tokens array<bigint>")
    sets = sets.where("node is not null")
    if _some_without_id(named):
        # classes of rows without an id are found by their name, one row each
        unnamed = texts.where("doc_id is null").select("text").mapInArrow(_sets, "node binary, tokens array<bigint>")
        sets = sets.unionByName(unnamed.join(readers.where("doc_id is null").select("node"), "node", "left_semi").dropDuplicates(["node"]))
    sets = stored(sets, "sets")
    with_sets = pairs.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("tokens").alias("pivot_tokens")), "pivot")
    verified = stored(with_sets.mapInArrow(_kinds, "pivot binary, node binary, n long, kind int"), "verified")
    stars = verified.where(f"kind = {NEAR}").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return stars.unionByName(_between_members(verified, sets))


def _between_members(verified: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a pivot that are not both linked to it."""
    counted = verified.groupBy("pivot", "kind").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    counted = counted.select("pivot", "kind", blocks.alias("blocks"))
    sides = counted.groupBy("pivot").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("blocks"))), F.lit(0)).alias(f"b{k}") for k in (NEAR, MIDDLE, FAR)))

    def matched(left: int, right: int):
        """Pairs of block numbers; within one kind each pair once."""
        inner = lambda i: F.transform(
            F.sequence(i if left == right else F.lit(1), F.col(f"b{right}")),
            lambda j: F.struct(F.lit(left).alias("lk"), i.alias("lb"), F.lit(right).alias("rk"), j.alias("rb")),
        )
        rows = F.flatten(F.transform(F.sequence(F.lit(1), F.col(f"b{left}")), inner))
        return F.when((F.col(f"b{left}") > 0) & (F.col(f"b{right}") > 0), rows).otherwise(F.array().cast("array<struct<lk:int,lb:int,rk:int,rb:int>>"))

    tasks = sides.where(f"b{MIDDLE} + b{FAR} > 0").select(
        "pivot", F.inline(F.concat(matched(MIDDLE, NEAR), matched(MIDDLE, MIDDLE), matched(MIDDLE, FAR), matched(FAR, FAR)))
    )
    name = ["pivot", "lk", "lb", "rk", "rb"]
    slots = tasks.select(*name, F.inline(F.when((F.col("lk") == F.col("rk")) & (F.col("lb") == F.col("rb")), F.array(_slot("l", True, True))).otherwise(F.array(_slot("l", True, False), _slot("r", False, True)))))
    members = verified.join(counted, ["pivot", "kind"]).select("pivot", "kind", "node", (F.pmod(F.xxhash64("node"), "blocks") + 1).cast("int").alias("block"))
    rows = slots.join(members, ["pivot", "kind", "block"]).join(sets, "node")
    return rows.groupBy(*name).applyInArrow(_block, "a binary, b binary")


def _slot(side: str, left: bool, right: bool):
    return F.struct(F.col(f"{side}k").alias("kind"), F.col(f"{side}b").alias("block"), F.lit(left).alias("left"), F.lit(right).alias("right"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``."""
    named = stored(classes(docs), "classes")
    links = class_links(docs, named)
    leaders = _leaders(named)
    by_id = (
        stored(links, "links")
        .join(leaders.select(F.col("node").alias("a"), F.col("leader").alias("la")), "a")
        .join(leaders.select(F.col("node").alias("b"), F.col("leader").alias("lb")), "b")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
    )
    grouped = components(by_id)
    return (
        named.join(leaders, "node", "left")
        .join(grouped.withColumnRenamed("id", "leader"), "leader", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(_id("component"), _id("leader"), "doc_id").alias("component_id"))
    )
