"""Language of texts by unigram pieces, summed over all segmentations.

A word is a run of letters inside a space-delimited word, lower-cased and marked at its start. Each
language gives every piece of a fixed public vocabulary a probability, learned from counts of pieces
over all labelled texts. The probability of a word in a language is the sum over all ways to cut it
into pieces (forward algorithm); a text's is the product over its words.

* null text, empty text or text without letters: language ``und``, score 0;
* rows with null language teach nothing; without any labelled text every row is ``und``;
* letters that no piece holds cost the same in all languages, so alone they never decide;
* equal likelihoods: the first language by code point;
* a word of more than 40 letters is scored in parts of 40; texts are read whole;
* further columns of ``docs`` stay; ``lang_pred`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import U64, coded, slices, spans, split_words

MARK = 0x2581  # starts a word in the vocabulary
BASE = 0x9E3779B97F4A7C15
LONGEST = 40
GROUP = 4_000  # words whose sums over all cuts are held at once, one row for each letter
UNKNOWN = 1e-7  # probability of a letter that no piece holds, in every language
PRIOR = 0.1  # added to each piece's count
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    keys: np.ndarray  # sorted hashes of the pieces
    probs: np.ndarray  # piece x language
    longest: int  # letters in the longest piece


@functools.lru_cache(maxsize=2)
def _processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def letters(values: pa.Array) -> pa.Array:
    """Lower-cased letters of each word, the rest removed."""
    return pc.replace_substring_regex(pc.utf8_lower(values), r"\PL+", "")


def _word_table(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; then (row, word, count) once for each word of a row."""
    raw, rows = split_words(text)
    distinct, place = coded(raw)
    clean, to_clean = coded(letters(distinct))
    place = to_clean[place].astype(np.int64) if len(place) else np.empty(0, np.int64)
    full = pc.greater(pc.utf8_length(clean), 0).to_numpy(zero_copy_only=False) if len(clean) else np.empty(0, bool)
    keep = full[place] if len(place) else np.empty(0, bool)
    pairs, counts = np.unique(rows[keep] * max(1, len(clean)) + place[keep], return_counts=True)
    return clean, pairs // max(1, len(clean)), pairs % max(1, len(clean)), counts


def fit(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> Model:
    """Learn piece probabilities from every row with a language; ``vocabulary`` is a SentencePiece file.

    Counts are summed in the tasks; what reaches the driver has at most vocabulary x languages rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(vocabulary)
        size = processor.get_piece_size()
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            clean, rows, place, counts = _word_table(batch.column("text"))
            names, lang_of = coded(batch.column("lang"))
            used, place = np.unique(place, return_inverse=True)
            pieces = processor.encode(clean.take(pa.array(used)).to_pylist(), num_threads=1)
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.fromiter((p for ids in pieces for p in ids), np.int64, int(lengths.sum()))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for code, name in enumerate(names.to_pylist()):
                weight = np.bincount(place[lang_of[rows] == code], counts[lang_of[rows] == code], len(used))
                mine = total.setdefault(name, np.zeros(size))
                mine += np.bincount(flat, np.repeat(weight, np.diff(starts)), size)
        for name, mine in total.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(mine[at].astype(np.int64))], ["lang", "piece", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    learned = rows.mapInArrow(count, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    processor = _processor(vocabulary)
    names = tuple(sorted(set(learned["lang"])))
    counts = np.zeros((processor.get_piece_size(), len(names)))
    counts[learned["piece"].to_numpy(np.int64), [names.index(x) for x in learned["lang"]]] = learned["n"]
    special = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) for i in range(len(counts))]
    usable = np.flatnonzero(~np.array(special))
    texts = [processor.id_to_piece(int(i)) for i in usable]
    counts = counts[usable] + PRIOR
    keys = np.array([_key(t) for t in texts], U64)
    order = np.argsort(keys)
    return Model(names, keys[order], (counts / counts.sum(axis=0))[order], max(map(len, texts)))


def _key(piece: str) -> int:
    value = 0
    for c in piece:
        value = (value * BASE + ord(c)) % 2**64
    return value


def word_log_probs(model: Model, values: list[str]) -> np.ndarray:
    """Log probability of each word in each language, summed over its segmentations."""
    out = np.zeros((len(values), len(model.languages)))
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    power = [U64(pow(BASE, k, 2**64)) for k in range(model.longest + 1)]
    for length in np.unique(lengths):
        group = np.flatnonzero(lengths == length)
        for part in range(0, length, LONGEST):
            size = min(LONGEST, length - part)
            for begin in range(0, len(group), GROUP):
                some = group[begin : begin + GROUP]
                text = points[starts[some][:, None] + part + np.arange(size)]
                out[some] += np.log(_forward(model, text, power))
    return out


def _forward(model: Model, text: np.ndarray, power: list[np.uint64]) -> np.ndarray:
    """Sums over all segmentations of words of one length, marked at the start."""
    count, length = len(text), text.shape[1] + 1
    prefix = [np.zeros(count, U64), np.full(count, MARK, U64)]
    for k in range(length - 1):
        prefix.append(prefix[-1] * U64(BASE) + text[:, k])
    upto = [np.ones((count, len(model.languages)))]
    for end in range(1, length + 1):
        here = np.zeros_like(upto[0])
        for size in range(1, min(end, model.longest) + 1):
            key = prefix[end] - prefix[end - size] * power[size]
            place = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
            hit = np.flatnonzero(model.keys[place] == key)
            here[hit] += upto[end - size][hit] * model.probs[place[hit]]
            if size == 1 and len(hit) < count:
                miss = np.setdiff1d(np.arange(count), hit, assume_unique=True)
                here[miss] += upto[end - 1][miss] * UNKNOWN
        upto.append(here)
    return upto[-1]


def log_likelihoods(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text in each language, and its number of words."""
    clean, rows, place, counts = _word_table(text)
    used, place = np.unique(place, return_inverse=True)
    logs = word_log_probs(model, clean.take(pa.array(used)).to_pylist())
    total = np.stack([np.bincount(rows, counts * logs[place, k], len(text)) for k in range(len(model.languages))], axis=1)
    return total, np.bincount(rows, counts, len(text))


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language's share of the likelihood under equal priors."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            names, scores = [], []
            for a, b in spans(whole):
                column = whole.slice(a, b - a)
                if not model.languages:
                    names += [UNDETERMINED] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                total, n = log_likelihoods(model, column)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names += [model.languages[k] if m else UNDETERMINED for k, m in zip(best, n)]
                scores += np.where(n > 0, share, 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    guess = F.arrow_udf(predict, "lang_pred string, score double")
    out = docs.withColumn("__guess", guess(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__guess.lang_pred"), "score": F.col("__guess.score")}).drop("__guess")


def held_out(doc_id: str = "doc_id"):
    """One document in four, by a checksum of its id, is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
