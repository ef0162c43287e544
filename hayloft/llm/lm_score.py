"""Stupid-backoff scores of texts by n-gram counts of the corpus, joined by hash.

``S(w | v)`` is ``c(vw) / c(v)`` where the pair ``vw`` occurs at least ``cutoff`` times in the corpus, else
``0.4 c(w) / N``; the first word of a text backs off. Texts are taken in slices of bounded size. A slice
names each of its distinct words and pairs once, with how often it has it; these rows are dealt to
ranges of the hash, where the counts of all slices are added up and every slice gets the counts that it asked
for. The logarithms are summed per text. So a frequent n-gram is one entry for each slice, however often it
occurs, ranges hold about ``RANGE_GRAMS`` entries at any size of the corpus, and no table is collected.

Defined cases: null texts and texts without words have 0 words and a null score; ids are meant to be
unique, rows that share one are scored together; rows without id are scored as one document; an empty table
gives an empty result; a text of any length stays in one slice; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import U64, coded, gram_hashes, hashes, slices, split_words, stored

BACKOFF = 0.4
CUTOFF = 2
SLICE_BYTES = 6_000_000  # text of a slice
RANGE_GRAMS = 2_000_000
CODED = "slice long, doc_ids array<bigint>, n_words long, lengths binary, vocabulary binary, words binary"


def packed(values: np.ndarray) -> bytes:
    """Values by their bytes, all first bytes together and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice: its words as places in a vocabulary of hashes."""
    name = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", SLICE_BYTES):
        raw, rows = split_words(batch.column("text"))
        values, place = coded(raw)
        lengths = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
        binary = [pa.array([packed(x)], pa.binary()) for x in (lengths, hashes(values), place.astype(np.int32))]
        ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([name]), ids, pa.array([len(place)], pa.int64()), *binary], ["slice", "doc_ids", "n_words", "lengths", "vocabulary", "words"])
        name += 1


class Slice:
    """Distinct words and pairs of a slice, in the order of their hashes."""

    def __init__(self, lengths: bytes, vocabulary: bytes, words: bytes):
        self.lengths, self.words = unpacked(lengths, np.int64), unpacked(words, np.int32)
        self.vocabulary = unpacked(vocabulary, U64)
        self.inner = np.ones(len(self.words), bool)  # has a word before it in its text
        self.inner[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = False
        pair = gram_hashes(self.vocabulary[self.words], 2)[self.inner[1:]]
        self.pairs, self.pair, self.pair_counts = np.unique(pair, return_inverse=True, return_counts=True)
        grams = np.concatenate([self.vocabulary, self.pairs])
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]

    def counts(self) -> np.ndarray:
        seen = np.bincount(self.words, minlength=len(self.vocabulary))
        return np.concatenate([seen, self.pair_counts]).astype(np.int64)[self.order]

    def log_scores(self, answer: np.ndarray, total: int, cutoff: int) -> np.ndarray:
        """Sum of each text's logarithms, given the corpus's count of each of ``grams``."""
        count = np.empty(len(answer), np.int64)
        count[self.order] = answer
        single = np.log(count[: len(self.vocabulary)])[self.words]
        out = single + np.log(BACKOFF / total)
        joint = count[len(self.vocabulary) :][self.pair]
        at = np.flatnonzero(self.inner)[joint >= cutoff]
        out[at] = np.log(joint[joint >= cutoff]) - single[at - 1]
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(owner, weights=out, minlength=len(self.lengths)).astype(float)


def _slices_of(table) -> Iterator[tuple[int, Slice]]:
    for row in table.select(["slice", "lengths", "vocabulary", "words"]).to_pylist():
        yield row["slice"], Slice(row["lengths"], row["vocabulary"], row["words"])


def _asked(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for name, texts in _slices_of(batch.slice(k, 1)):
                    place = (texts.grams >> U64(32)) * U64(ranges) >> U64(32)
                    names, starts = np.unique(place, return_index=True)
                    spans = list(zip(starts, np.append(starts[1:], len(place))))
                    counts = texts.counts()
                    steps = [packed(np.diff(texts.grams[a:b], prepend=U64(0))) for a, b in spans]
                    arrays = [pa.array(names.astype(np.int64)), pa.array([name] * len(names), pa.int64()), pa.array(steps, pa.binary())]
                    arrays.append(pa.array([packed(counts[a:b]) for a, b in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, ["range", "slice", "grams", "counts"])
        pa.default_memory_pool().release_unused()

    return run


def _answers(group: pa.Table) -> pa.Table:
    """Counts of a range's n-grams over all slices, for each slice in the order it asked in."""
    asked = [np.cumsum(unpacked(x, U64), dtype=U64) for x in group.column("grams").to_pylist()]
    counts = np.concatenate([unpacked(x, np.int64) for x in group.column("counts").to_pylist()])
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(at.max() + 1, np.int64)
    np.add.at(total, at, counts)
    answers = np.split(total[at], np.cumsum([len(x) for x in asked])[:-1])
    return pa.table({"range": group.column("range"), "slice": group.column("slice"), "counts": pa.array([packed(x) for x in answers], pa.binary())})


def _summed(total: int, cutoff: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (_, texts), *_ = _slices_of(left)
        rows = sorted(right.select(["range", "counts"]).to_pylist(), key=lambda r: r["range"])
        answer = np.concatenate([np.empty(0, np.int64), *(unpacked(r["counts"], np.int64) for r in rows)])
        logs = texts.log_scores(answer, total, cutoff)
        ids = left.column("doc_ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_words": pa.array(texts.lengths), "log_score": pa.array(logs)})

    return run


def scores(docs: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """``(doc_id, n_words, log_score, score)``: sum of the logarithms, and their mean over the words."""
    texts = stored(docs.select("doc_id", "text").mapInArrow(_code, CODED), "coded")
    total = texts.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // RANGE_GRAMS))
    asked = texts.select("slice", "lengths", "vocabulary", "words").mapInArrow(_asked(ranges), "range long, slice long, grams binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(_answers, "range long, slice long, counts binary")
    both = texts.drop("n_words").groupBy("slice").cogroup(answers.groupBy("slice"))
    parts = both.applyInArrow(_summed(max(1, total), cutoff), "doc_id long, n_words long, log_score double")
    summed = parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    log_score = F.when(F.col("n_words") > 0, F.col("log_score"))
    return summed.select("doc_id", "n_words", log_score.alias("log_score"), (log_score / F.col("n_words")).alias("score"))
