"""Toxicity categories by a chain of linear classifiers.

Categories are predicted one after the other. Each model is a logistic regression over the hashed distinct
words of a text and over the probabilities of the categories before it. While the chain is trained, those
come from models that have not seen the row (out-of-fold), as they will when it is applied; for
prediction each category's model is fitted on all rows of the sample.

The chain is fitted on a sample of labelled rows of a stated size, taken by a checksum of the id; it is
applied to whole texts of all rows.

Defined cases: null texts and texts without letters have no words and get the probabilities of the bias;
rows with a null label teach that category nothing; an id with several labels takes the largest of each;
a category without both labels in the sample has probability 0 or 1 as labelled, 0 without any;
further columns stay, columns named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import U64, coded, hashes, spans, split_words
from hayloft.llm.langid import letters

FEATURES = 1 << 18
SAMPLE_ROWS = 20_000  # labelled rows that the chain is fitted on
FOLDS = 3
TELLING = 10.83  # chi-squared of a word and a label from which on the word counts (one in a thousand by chance)
ROUNDS, RATE, DECAY = 100, 0.3, 1.0


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word features of all texts in a row, and where each text's begin."""
    raw, rows = split_words(text)
    if not len(raw):
        return np.empty(0, np.int64), np.zeros(len(text) + 1, np.int64)
    distinct, place = coded(raw)
    values, to_value = coded(letters(distinct))
    number = (hashes(values) % U64(FEATURES - 1)).astype(np.int64) + 1
    number[[k for k, v in enumerate(values.to_pylist()) if not v]] = 0
    found = np.unique(rows * FEATURES + number[to_value[place]])
    found = found[found % FEATURES > 0]
    return found % FEATURES, np.searchsorted(found // FEATURES, np.arange(len(text) + 1))


@dataclass(frozen=True)
class Linear:
    words: np.ndarray
    earlier: np.ndarray  # weights of the log odds of the categories before
    bias: float

    def log_odds(self, words: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        return np.bincount(rows, self.words[words], len(starts) - 1) + earlier @ self.earlier + self.bias


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def fit_linear(words: np.ndarray, starts: np.ndarray, earlier: np.ndarray, labels: np.ndarray) -> Linear:
    """Logistic regression by adaptive gradient steps, with a penalty on the squares of the weights."""
    positive = labels.sum()
    if not len(labels) or positive in (0, len(labels)):
        return Linear(np.zeros(FEATURES), np.zeros(earlier.shape[1]), 30.0 if positive else -30.0)
    rows = np.repeat(np.arange(len(labels)), np.diff(starts))
    known = _telling(words, labels[rows], positive, len(labels))
    words, rows = words[known[words]], rows[known[words]]
    used, place = np.unique(words, return_inverse=True)
    weight, link, bias = np.zeros(len(used)), np.zeros(earlier.shape[1]), np.log(positive / (len(labels) - positive))
    squares = [np.full(len(used), 1e-6), np.full(len(link), 1e-6), 1e-6]
    for _ in range(ROUNDS):
        error = probability(np.bincount(rows, weight[place], len(labels)) + earlier @ link + bias) - labels
        steps = [np.bincount(place, error[rows], len(used)) + DECAY * weight, earlier.T @ error, error.sum()]
        squares = [s + g**2 for s, g in zip(squares, steps)]
        weight = weight - RATE * steps[0] / np.sqrt(squares[0])
        link = link - RATE * steps[1] / np.sqrt(squares[1])
        bias = bias - RATE * steps[2] / np.sqrt(squares[2])
    full = np.zeros(FEATURES)
    full[used] = weight
    return Linear(full, link, float(bias))


def _telling(words: np.ndarray, labels: np.ndarray, positive: float, count: int) -> np.ndarray:
    """Words whose presence and the label depend on each other; most words of a sample are chance."""
    seen = np.bincount(words, minlength=FEATURES).astype(float)
    both = np.bincount(words, labels, FEATURES)
    expected = seen * positive / count
    spread = expected * (1 - positive / count) * (1 - seen / count)
    return (both - expected) ** 2 >= TELLING * np.maximum(spread, 1e-9) + 2 * np.abs(both - expected)


def _rows(words: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(starts)
    return words[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(lengths[keep])])


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    models: tuple[Linear, ...]

    def probabilities(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        odds = np.zeros((len(starts) - 1, 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.log_odds(words, starts, odds), -30, 30)])
        return probability(odds)


def fit_chain(categories: list[str], words: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Chain:
    """``labels`` has a column for each category, in the order of the chain; nan where unknown."""
    models, odds = [], np.zeros((len(labels), 0))
    fold = np.arange(len(labels)) % FOLDS
    for k in range(len(categories)):
        known = ~np.isnan(labels[:, k])
        unseen = np.zeros(len(labels))
        for f in range(FOLDS if k + 1 < len(categories) else 0):
            keep = known & (fold != f)
            part = fit_linear(*_rows(words, starts, keep), odds[keep], labels[keep, k])
            rest = fold == f
            unseen[rest] = part.log_odds(*_rows(words, starts, rest), odds[rest])
        models.append(fit_linear(*_rows(words, starts, known), odds[known], labels[known, k]))
        odds = np.column_stack([odds, np.clip(unseen, -30, 30)])
    return Chain(tuple(categories), tuple(models))


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents, by the checksum of their ids."""
    once = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.col(c).cast("double")).alias(c) for c in categories))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS) -> Chain:
    """Fit the chain; only the word features of the sample come to the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in spans(batch.column("text")):
                part = batch.slice(a, b - a)
                words, starts = features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(words, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in categories), lists], ["doc_id", *categories, "words"])

    schema = ", ".join(["doc_id long", *(f"`{c}` double" for c in categories), "words array<int>"])
    found = sample(docs, labels, categories, rows).mapInArrow(extract, schema).toArrow().sort_by("doc_id")
    lists = found.column("words").combine_chunks()
    words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    table = np.column_stack([found.column(c).to_numpy() for c in categories]).astype(float)
    return fit_chain(categories, words, starts, table)


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category of the chain."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            parts = [chain.probabilities(*features(whole.slice(a, b - a))) for a, b in spans(whole)]
            table = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(names))], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.withColumn("__p", F.arrow_udf(run, ", ".join(f"`{n}` double" for n in names))(F.col(text)))
    return out.withColumns({n: F.col(f"__p.{n}") for n in names}).drop("__p")
