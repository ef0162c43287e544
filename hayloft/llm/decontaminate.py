"""Test items inside training texts: shared word runs as a filter that loses nothing, then Smith-Waterman alignment.

Words are lower-cased and stripped of everything but letters and digits, so case and punctuation do not
matter. Window and item are aligned (match 2, mismatch -1, gap -1), and the score is the alignment's
share of a perfect one. Edited and paraphrased copies lose some of it, chance matches reach little.

Every pair at or above the threshold is found. With a share ``t`` of an item of ``m`` words, an
alignment of ``M`` matches has at most ``2M - 2tm`` errors, so it keeps at least ``2tm - m - 1`` pairs of
neighbouring words and ``tm`` words, and its gaps move it by at most ``2m(1 - t)`` places. Places of
shared pairs (single words for items too short for a pair to be sure) are counted per text, item and
stretch of that many shifts; two neighbouring stretches that hold enough name the window to align.
The items travel to the tasks, in parts if there are many, so no group of copies meets in one task.

Defined cases: null, empty and short texts hold nothing; items of fewer than three words and null items
are never found; repeated items with one id count as one when equal, else the best score counts; rows
without a document id cannot be named and are skipped; rows sharing an id are reported together; ties
go to the earliest window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import U64, coded, gram_hashes, hashes, slices, split_words, stored

LEAST_WORDS = 3
ITEM_WORDS = 2_000_000  # words of items sent to the tasks at once, 8 bytes each
PLACES = 250_000  # shared places compared at once: about 100 bytes each while they are sorted
SLICE = 1_000_000  # bytes of text at once: words and their hashes take many times that
THRESHOLD = 0.6
BASE = 1 << 32  # scores and starts share one integer


def clean_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each cleaned word of all rows, and where each row starts."""
    raw, rows = split_words(text)
    distinct, place = coded(raw)
    values, to_value = coded(pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\pL\pN]+", ""))
    if not len(raw):
        return np.empty(0, np.int64), np.zeros(len(text) + 1, np.int64)
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    place = to_value[place]
    keep = full[place]
    return hashes(values)[place[keep]].view(np.int64), np.searchsorted(rows[keep], np.arange(len(text) + 1))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        words, starts = clean_words(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(words))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], ["item_id", "item"])


def _least(share: float) -> np.ndarray:
    """Whole numbers from ``share`` on, safe against its rounding."""
    return np.ceil(np.asarray(share) - 1e-9).astype(np.int64)


class Runs:
    """Word runs of the items, found by their hashes: pairs, or single words where no pair is sure."""

    def __init__(self, items: list[np.ndarray], threshold: float):
        self.length = np.array(list(map(len, items)), np.int64)
        self.width = np.maximum(1, _least(2 * (1 - threshold) * self.length))
        pairs = _least((2 * threshold - 1) * self.length - 1)
        self.least_words = np.maximum(1, _least(threshold * self.length))
        self.least = np.where(pairs > 0, pairs, self.least_words)
        self.tables = [self._table(items, np.flatnonzero((pairs > 0) == (size == 2)), size) for size in (1, 2)]

    @staticmethod
    def _table(items: list[np.ndarray], numbers: np.ndarray, size: int):
        grams = [gram_hashes(items[k].view(U64), size) for k in numbers]
        counts = list(map(len, grams))
        flat = np.concatenate([np.empty(0, U64), *grams])
        order = np.argsort(flat, kind="stable")
        keys, begin = np.unique(flat[order], return_index=True)
        place = np.concatenate([np.empty(0, np.int64), *map(np.arange, counts)])
        return size, keys, np.append(begin, len(flat)), np.repeat(numbers, counts)[order], place[order]

    def windows(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and cell of shifts where two neighbouring cells hold enough shared runs, the first of them some."""
        found = [self._cells(words, starts, *table) for table in self.tables]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _cells(self, words, starts, size, keys, begin, item, place):
        grams = gram_hashes(words.view(U64), size)
        none = np.empty(0, np.int64)
        if not len(keys) or not len(grams):
            return none, none, none
        key = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        at = np.flatnonzero(keys[key] == grams)
        row = np.searchsorted(starts, at, side="right") - 1
        inside = at + size <= starts[row + 1]
        at, row = at[inside], row[inside]
        key = key[at]
        ends = np.cumsum(begin[key + 1] - begin[key])
        # shifts of a text lie above -longest item and below its length
        below = int((self.length // self.width).max()) + 2
        span = below + int(np.diff(starts).max()) + 2
        codes, counts, first = [none], [none], 0
        while first < len(at):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PLACES, side="right")))
            many = np.diff(ends[first:last], prepend=done)
            hit = np.repeat(np.arange(first, last), many)
            which = begin[key[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
            of = item[which]
            cell = (at[hit] - starts[row[hit]] - place[which]) // self.width[of]
            code, count = np.unique((row[hit] * len(self.length) + of) * span + cell + below, return_counts=True)
            codes.append(code)
            counts.append(count)
            first = last
        code, which = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(which, np.concatenate(counts), len(code)).astype(np.int64)
        following = np.append(np.where(np.diff(code) == 1, count[1:], 0), 0)[: len(code)]
        owner = code // span
        keep = count + following >= self.least[owner % len(self.length)]
        return owner[keep] // len(self.length), owner[keep] % len(self.length), code[keep] % span - below


def _found(ids: pa.Array, items: list[np.ndarray], threshold: float):
    runs = Runs(items, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, starts = clean_words(batch.column("text"))
            rows, of, lows, texts = [], [], [], []
            for row, item, cell in zip(*runs.windows(words, starts)):
                width = runs.width[item]
                low = max(0, (cell - 1) * width)
                window = words[starts[row] + low : min(starts[row + 1], starts[row] + (cell + 2) * width + runs.length[item])]
                if np.isin(items[item], window).sum() >= runs.least_words[item]:
                    rows.append(row)
                    of.append(item)
                    lows.append(low)
                    texts.append(window)
            score, start, end = _aligned([items[k] for k in of], texts)
            share = score / (2 * runs.length[np.array(of, np.int64)])
            keep = np.flatnonzero(share >= threshold)
            low = np.array(lows, np.int64)[keep]
            doc, item = (column.take(pa.array(np.array(x, np.int64)[keep])) for column, x in ((batch.column("doc_id"), rows), (ids, of)))
            yield pa.RecordBatch.from_arrays([doc, item, pa.array(share[keep]), pa.array(low + start[keep]), pa.array(low + end[keep])], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its text: score, first word and end in the text."""
    m, n = max(map(len, items)), max(map(len, texts))
    a = np.zeros((len(items), m), np.int64)
    b = np.zeros((len(items), n), np.int64)
    for k, (x, y) in enumerate(zip(items, texts)):
        a[k, : len(x)] = x
        b[k, : len(y)] = y
    in_text = np.arange(n) < np.array(list(map(len, texts)))[:, None]
    slope = np.arange(1, n + 1) * BASE
    fresh = np.broadcast_to(BASE - 1 - np.arange(n + 1), (len(items), n + 1))  # score 0; the earliest start is the largest
    row, best, end = fresh.copy(), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(m):
        in_item = (i < np.array(list(map(len, items))))[:, None]
        same = (a[:, i : i + 1] == b) & in_text & in_item
        top = np.maximum(row[:, :-1] + np.where(same, 2 * BASE, -BASE), row[:, 1:] - BASE)
        top = np.maximum(top, fresh[:, 1:])
        cells = np.maximum.accumulate(top + slope, axis=1) - slope
        cells = np.maximum(np.where(in_text & in_item, cells, fresh[:, 1:]), fresh[:, 1:])
        row = np.concatenate([fresh[:, :1], cells], axis=1)
        at = cells.argmax(axis=1)
        here = cells[np.arange(len(items)), at]
        better = here // BASE > best // BASE
        best, end = np.where(better, here, best), np.where(better, at + 1, end)
    return best // BASE, BASE - 1 - best % BASE, end


def _aligned(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``align`` in parts of items of about the same length."""
    order = np.argsort([len(x) for x in items], kind="stable")
    score, start, end = (np.zeros(len(items), np.int64) for _ in range(3))
    begin = 0
    while begin < len(order):
        # cells of the padded tables are what memory goes to
        size = max(1, min(256, 4_000_000 // max(1, 4 * len(items[order[min(begin + 255, len(order) - 1)]]))))
        some = order[begin : begin + size]
        score[some], start[some], end[some] = align([items[k] for k in some], [texts[k] for k in some])
        begin += size
    return score, start, end


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word)`` of the best alignment of each pair at or above ``threshold``.

    The word range counts cleaned words of the text, its end is exclusive.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = items.mapInArrow(_items, "item_id long, item array<bigint>").where(F.size("item") >= LEAST_WORDS).distinct()
    items = stored(items, "items")
    parts = max(1, -(-items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0] // ITEM_WORDS))

    def scored(part: int) -> DataFrame:
        some = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(parts)) == part).toArrow()
        lists = some.column("item").combine_chunks()
        found = _found(some.column("item_id").combine_chunks(), [np.array(x.values) for x in lists], threshold)
        return texts.mapInArrow(found, "doc_id long, item_id long, score double, start_word long, end_word long")

    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), "end_word"))
    every = reduce(DataFrame.unionByName, map(scored, range(parts)))
    return every.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
