"""Transcript quality (word and character error rates) and selection of fine-tuning data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hayloft import schemas as S
from hayloft.functions import text
from hayloft.operators import media

# One character per distinct word of a pair; letters of one Unicode block are as good as any.
_LETTERS = "".join(map(chr, range(0x4E00, 0x4E00 + 4096)))


def words_of(column: Column) -> Column:
    return text.split_lemmas(column)


def _word_distance(ref: list[str], hyp: list[str]) -> int:
    """Edit distance over words, one numpy row per reference word."""
    codes: dict[str, int] = {}
    r = [codes.setdefault(w, len(codes)) for w in ref]
    h = np.array([codes.setdefault(w, len(codes)) for w in hyp], dtype=np.int64)
    steps = np.arange(len(h) + 1)
    row = steps.copy()
    for i, word in enumerate(r, start=1):
        change = np.minimum(row[1:] + 1, row[:-1] + (h != word))
        row = np.minimum.accumulate(np.concatenate(([i], change)) - steps) + steps
    return int(row[-1])


@F.pandas_udf(T.LongType())
def _big_word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else _word_distance(list(r), list(h)) for r, h in zip(ref, hyp)], dtype="Int64")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of two texts.

    Each distinct word of the pair becomes one character, so the JVM's ``levenshtein`` does the
    work. Only a pair with more distinct words than there are letters goes to Python.
    """
    r, h = words_of(ref), words_of(hyp)
    vocabulary = F.array_distinct(F.concat(r, h))
    spell = lambda ws: F.array_join(
        F.transform(ws, lambda w: F.substring(F.lit(_LETTERS), F.array_position(vocabulary, w).cast("int"), 1)), ""
    )
    small = F.size(vocabulary) <= len(_LETTERS)
    return F.when(small, F.levenshtein(spell(r), spell(h)).cast("long")).otherwise(
        _big_word_distance(F.when(~small, r), F.when(~small, h))
    )


def word_errors(pairs: DataFrame) -> DataFrame:
    """(id, edits, n_ref) per pair ``(id, ref, hyp)``; sums over any chunking add up."""
    return pairs.select("id", word_edits(F.col("ref"), F.col("hyp")).alias("edits"), F.size(words_of(F.col("ref"))).cast("long").alias("n_ref"))


def character_errors(pairs: DataFrame) -> DataFrame:
    return pairs.select("id", F.levenshtein("ref", "hyp").cast("long").alias("edits"), F.length("ref").cast("long").alias("n_ref"))


def error_rate(errors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Corpus-level rate: all edits over all reference units, per key."""
    return errors.groupBy(*keys).agg(
        F.sum("edits").alias("edits"),
        F.sum("n_ref").alias("n_ref"),
        F.try_divide(F.sum("edits").cast("double"), F.sum("n_ref").cast("double")).alias("rate"),
    )


def finetuning_set(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """(id, name, transcription): hand-corrected transcripts of recordings that fit one segment."""
    audible = files.where("is_transcript_analyzed and is_transcript_fixed and transcript <> ''").join(
        skipped.select("name"), "name", "left_anti"
    )
    parts = media.segment_plan(audible.select(F.col("id").alias("item_id"), "duration"))
    single = parts.groupBy("item_id").agg(F.count("*").alias("n")).where("n = 1").select(F.col("item_id").alias("id"))
    return audible.join(single, "id", "left_semi").select(
        "id", "name", F.translate("transcript", "\n", " ").alias("transcription")
    )


def split_names(ids: Column, seed: str = "split", test_share: float = 0.15, eval_share: float = 0.15) -> Column:
    """train / eval / test by a hash of the id: the same on every run and partitioning."""
    draw = lambda salt: (
        F.conv(F.substring(F.md5(F.concat(ids.cast("string"), F.lit(f":{seed}:{salt}"))), 1, 8), 16, 10).cast("long") % 10_000
    )
    return (
        F.when(draw("test") < round(test_share * 10_000), "test")
        .when(draw("eval") < round(eval_share * 10_000), "eval")
        .otherwise("train")
    )
