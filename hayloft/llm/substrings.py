"""Passages that occur earlier in the corpus are removed: suffix trees partitioned by prefixes of variable length.

Every place with ``size`` words before the end of its text begins a suffix; two suffixes that agree on ``size`` words meet in
an internal node of that depth or more, and of its leaves all but the earliest are repeats. The tree of the corpus is
cut into groups by prefixes:

1. The prefix of a suffix ends with its *anchor*, the run of ``ANCHOR`` words with the smallest hash in its first ``size`` words. So
   prefixes have between ``ANCHOR`` and ``size`` words, suffixes that agree on ``size`` words have the same one, and neighbouring
   suffixes share an anchor: one row stands for all suffixes of an anchor, with a hash of the words they cover. Rows
   that agree in both are pre-aggregated per slice of texts, then by Spark, to their earliest place.
2. A group with one such class has no node but the one of its copies: its first place keeps its words. Groups with several classes
   send for the words of each class's first place; a group is a few rows, and a task builds the subtrees of the
   groups in its partition, one after the other: suffixes sorted by words, common prefixes of neighbours, and nodes of depth
   ``size`` or more with their earliest leaf.
3. A group of more than ``GROUP_CLASSES`` classes (a frequent phrase between other words each time) is split by longer prefixes: all
   ``size`` words, under a hash of 128 bits; such a group is one node, whose first row in sorted order is its earliest leaf.

What comes back to a text is the list of suffixes that are first of their node; every other suffix is a repeat. A passage
that a third of all texts share is one row of each slice on the way out and none on the way back.

Order is by key, then hash of the text, then place. Defined cases: rows with a null key come before all others. Rows that
agree in key and text are one document, and each gets its result. A null text has no words; texts shorter than
``size`` words keep all of theirs. An empty table gives no rows. A long text is one slice of its own; tasks hold a few slices, or
one group. Columns other than key and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayloft.llm.common import U64, coded, gram_hashes, hashes, mixed, release, slices, split_words

SIZE = 20
ANCHOR = 5
SLICE_BYTES = 4_000_000
GROUP_CLASSES = 20_000
FACTOR = 0x9E3779B97F4A7C15
ALL = 0xFFFFFFFF  # every suffix of an anchor; a text has fewer than 2**31 words

OCCURRENCES = "anchor long, region long, doc long, tie long, place long"
CUTTINGS = "anchor long, longer long, doc long, tie long, place long, ahead int, suffixes int, words string"
FIRSTS = "doc long, tie long, mark long"
RESULT = "key long, n_words long, n_removed long, kept string"


class Suffixes(NamedTuple):
    """Suffixes of a slice of texts, by anchor. Places are those of the slice's whole word sequence."""

    words: pa.Array
    row: np.ndarray  # of each word
    begins: np.ndarray  # first word of each text
    hashes: np.ndarray  # of each word
    start: np.ndarray  # of each suffix
    owner: np.ndarray  # of each suffix: its anchor's number
    anchor: np.ndarray  # place of each anchor
    gram: np.ndarray  # hash of each anchor
    low: np.ndarray  # first and last suffix of each anchor
    high: np.ndarray


def suffixes(text: pa.Array, size: int) -> Suffixes:
    words, row = split_words(text)
    distinct, code = coded(words)
    value = hashes(distinct)[code] if len(words) else np.zeros(0, U64)
    begins = np.searchsorted(row, np.arange(len(text)))
    grams = gram_hashes(value, ANCHOR)
    most = len(value) - size + 1
    if most <= 0:
        none = np.zeros(0, np.int64)
        return Suffixes(words, row, begins, value, none, none, none, np.zeros(0, U64), none, none)
    # place of the smallest hash, the first of equals, among the anchors that fit a suffix's first words
    best, reach, width = np.arange(len(grams)), 1, size - ANCHOR + 1
    while reach < width:
        step = min(reach, width - reach)
        one, two = best[: len(best) - step], best[step:]
        best, reach = np.where(grams[two] < grams[one], two, one), reach + step
    start = np.flatnonzero(row[:most] == row[size - 1 :])
    place = best[start]
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    anchor = place[first]
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return Suffixes(words, row, begins, value, start, np.cumsum(new) - 1, anchor, grams[anchor], start[first], start[last])


class Stretches:
    """Hashes of stretches of words from sums over prefixes; the factor is odd and so has an inverse."""

    def __init__(self, value: np.ndarray, factor: int = FACTOR):
        power, back = np.ones(len(value) + 1, U64), np.ones(len(value) + 1, U64)
        np.multiply.accumulate(np.full(len(value), factor, U64), out=power[1:])
        np.multiply.accumulate(np.full(len(value), pow(factor, -1, 2**64), U64), out=back[1:])
        self.back, self.total = back, np.zeros(len(value) + 1, U64)
        np.cumsum(value * power[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _occurrences(size: int):
    """Anchors with a hash of all words their suffixes begin with; of those that agree in a slice, the earliest."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            s = suffixes(batch.column("text"), size)
            region = Stretches(s.hashes).of(s.low, s.high + size)
            shape = (s.anchor - s.low) << 32 | (s.high - s.low)
            region = mixed(region ^ mixed(shape.astype(U64)))
            row = s.row[s.anchor]
            doc, tie = batch.column("doc").to_numpy()[row], batch.column("tie").to_numpy()[row]
            place = s.anchor - s.begins[row]
            order = np.lexsort((place, tie, doc, region, s.gram))
            a, r = s.gram[order], region[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
            first = order[new]
            yield pa.RecordBatch.from_arrays([_long(x[first]) for x in (s.gram, region, doc, tie, place)], names=["anchor", "region", "doc", "tie", "place"])

    return find


def _cuttings(size: int):
    """The words of wanted anchors' suffixes; of anchors to be split, each suffix under the hash of its first words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            s = suffixes(batch.column("text"), size)
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy())
            asked = pc.list_flatten(wanted)
            place, gram, split = (pc.struct_field(asked, k).to_numpy(zero_copy_only=False) for k in range(3))
            number = np.searchsorted(s.anchor, s.begins[row] + place)
            doc, tie = batch.column("doc").to_numpy()[row], batch.column("tie").to_numpy()[row]

            short = ~split
            n = number[short]
            count = s.high[n] - s.low[n] + size
            index = np.repeat(s.low[n] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), s.words.take(pa.array(index)).cast(pa.string()))
            yield _cutting(gram[short], np.zeros(len(n), np.int64), doc[short], tie[short], place[short], s.anchor[n] - s.low[n], s.high[n] - s.low[n] + 1, pc.binary_join(lists, " "))

            n = number[split]
            count = s.high[n] - s.low[n] + 1
            start = np.repeat(s.low[n] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            one, two = (Stretches(s.hashes, f).of(start, start + size) for f in (FACTOR, FACTOR + 2))
            which = np.repeat(np.flatnonzero(split), count)
            yield _cutting(one, two | U64(1), doc[which], tie[which], place[which], np.repeat(s.anchor[n], count) - start, np.ones(len(start)), pa.nulls(len(start), pa.string()))

    return cut


def _cutting(anchor, longer, doc, tie, place, ahead, count, words) -> pa.RecordBatch:
    columns = [_long(x) for x in (anchor, longer, doc, tie, place)] + [pa.array(ahead.astype(np.int32)), pa.array(count.astype(np.int32)), words]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "longer", "doc", "tie", "place", "ahead", "suffixes", "words"])


def earliest_leaves(group: np.ndarray, ahead: np.ndarray, count: np.ndarray, words: pa.Array, size: int) -> np.ndarray:
    """Subtrees of whole groups: for each row, which of its suffixes are the first leaf of their node.

    Rows are in the order of the corpus within a group. Bit b of the result: the suffix b words before the anchor.
    """
    lists = pc.split_pattern(words, " ")
    ids = coded(pc.list_flatten(lists))[1].astype(np.int32)
    begin = np.cumsum(count + size - 1) - (count + size - 1)
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    before = ahead[row] - step
    suffix = ids[(begin[row] + step)[:, None] + np.arange(size)]
    # leaves in order: the prefix (group and words before the anchor), then word by word, then the corpus
    order = np.lexsort((row, *suffix.T[::-1], before, group[row]))
    same = suffix[order[1:]] == suffix[order[:-1]]
    common = np.where(same.all(1), size, same.argmin(1))
    other = (before[order[1:]] != before[order[:-1]]) | (group[row[order[1:]]] != group[row[order[:-1]]])
    first = np.append(True, other | (common < size))[: len(order)]
    bits = np.zeros(len(count), np.int64)
    leaf = order[first]
    np.bitwise_or.at(bits, row[leaf], 1 << before[leaf].astype(np.int64))
    return bits


def _first_suffixes(size: int):
    """Subtrees of the groups of a partition sorted by group and order of the corpus."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen = None

        def trees(table: pa.Table) -> pa.RecordBatch:
            number = table.column("anchor").combine_chunks()
            new = np.append(False, np.diff(number.to_numpy()) != 0)[: table.num_rows]
            ahead, count = table.column("ahead").to_numpy().astype(np.int64), table.column("suffixes").to_numpy().astype(np.int64)
            bits = earliest_leaves(np.cumsum(new), ahead, count, table.column("words").combine_chunks(), size)
            some = np.flatnonzero(bits)
            mark = (table.column("place").to_numpy()[some] << 32) | bits[some]
            return pa.RecordBatch.from_arrays([_long(table.column(c).to_numpy()[some]) for c in ("doc", "tie")] + [_long(mark)], names=["doc", "tie", "mark"])

        for batch in batches:
            split = pc.is_null(batch.column("words"))
            alone = batch.filter(split)
            if alone.num_rows:
                keys = np.stack([alone.column(c).to_numpy() for c in ("anchor", "longer")])
                first = np.ones(alone.num_rows, bool)
                first[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
                first[0] = seen is None or (keys[:, 0] != seen).any()
                seen = keys[:, -1]
                kept = alone.filter(pa.array(first))
                mark = (kept.column("place").to_numpy() << 32) | (1 << kept.column("ahead").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([kept.column("doc"), kept.column("tie"), _long(mark)], names=["doc", "tie", "mark"])
            rest = batch.filter(pc.invert(split))
            if not rest.num_rows:
                continue
            anchor = rest.column("anchor").to_numpy()
            # the last group may go on in the next batch
            whole = int(np.searchsorted(anchor, anchor[-1]))
            if whole:
                yield trees(pa.Table.from_batches([*held, rest.slice(0, whole)]))
                held = []
            elif held and held[-1].column("anchor")[0] != rest.column("anchor")[0]:
                yield trees(pa.Table.from_batches(held))
                held = []
            held.append(rest.slice(whole))
        if held:
            yield trees(pa.Table.from_batches(held))
        release()

    return grow


def _kept(size: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            s = suffixes(batch.column("text"), size)
            marks = pc.fill_null(pc.list_value_length(batch.column("marks")), 0).to_numpy()
            mark = pc.list_flatten(batch.column("marks")).to_numpy()
            bits = np.zeros(len(s.anchor), np.int64)
            place = s.begins[np.repeat(np.arange(batch.num_rows), marks)] + (mark >> 32)
            np.bitwise_or.at(bits, np.searchsorted(s.anchor, place), mark & ALL)
            first = bits[s.owner] >> (s.anchor[s.owner] - s.start) & 1
            again = s.start[first == 0]
            cover = np.zeros(len(s.row) + 1, np.int64)
            cover[again] += 1
            cover[again + size] -= 1
            stay = np.cumsum(cover)[:-1] == 0
            sizes = np.bincount(s.row, minlength=batch.num_rows)
            left = np.bincount(s.row[stay], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)).astype(np.int32)), s.words.filter(pa.array(stay)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), _long(sizes), _long(sizes - left), pc.binary_join(lists, " ")], names=["key", "n_words", "n_removed", "kept"])

    return keep


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``(key, n_words, n_removed, kept)`` of every row: its words but those in a stretch of ``size`` words that occurs earlier."""
    if not ANCHOR < size <= 31 + ANCHOR:
        raise ValueError(f"stretches of {ANCHOR + 1} to {31 + ANCHOR} words")
    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    chosen = chosen.select("key", F.coalesce("key", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    found = chosen.select("doc", "tie", "text").mapInArrow(_occurrences(size), OCCURRENCES)
    classes = found.repartition("anchor").groupBy("anchor", "region").agg(F.min(F.struct("doc", "tie", "place")).alias("first"))
    classes = classes.withColumn("classes", F.count("*").over(Window.partitionBy("anchor"))).select("anchor", "classes", "first.*")

    wanted = classes.where("classes > 1").select("doc", "tie", F.struct("place", "anchor", (F.col("classes") > GROUP_CLASSES).alias("split")).alias("one"))
    wanted = wanted.groupBy("doc", "tie").agg(F.collect_list("one").alias("wanted"))
    cuttings = chosen.join(wanted, ["doc", "tie"]).select("key", "doc", "tie", "text", "wanted").mapInArrow(_cuttings(size), CUTTINGS)
    grown = cuttings.repartition("anchor").sortWithinPartitions("anchor", "longer", "doc", "tie", "place").mapInArrow(_first_suffixes(size), FIRSTS)

    alone = classes.where("classes = 1").select("doc", "tie", F.expr(f"shiftleft(place, 32) | {ALL}L").alias("mark"))
    marks = alone.unionAll(grown).groupBy("doc", "tie").agg(F.collect_list("mark").alias("marks"))
    joined = chosen.join(marks, ["doc", "tie"], "left").select("key", "doc", "tie", "text", "marks")
    return joined.mapInArrow(_kept(size), RESULT)
