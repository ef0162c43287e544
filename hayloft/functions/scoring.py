"""Score arithmetic: BM25 terms, confidences, vector products. Scores are rounded before ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hayloft import schemas as S

# Sums of doubles depend on their order; ranks are taken on rounded scores so that they do not.
RANK_DIGITS = 9


def settled(score: Column) -> Column:
    """Score cut to nine digits by plain double arithmetic (``round`` goes through decimals); no -0.0."""
    scale = 10.0**RANK_DIGITS
    return F.rint(score * scale) / scale + 0.0


def idf(n_items: Column, df: Column) -> Column:
    return F.ln((n_items - df + 0.5) / (df + 0.5) + 1.0)


def bm25_saturation(tf: Column, dl: Column, avgdl: Column, k1: float = S.BM25_K1, b: float = S.BM25_B) -> Column:
    """BM25 share of one token in one text, before idf; an empty index (avgdl 0) has no texts to score."""
    length_norm = F.lit(1.0 - b) + F.lit(b) * F.try_divide(dl.cast("double"), avgdl)
    return tf * (k1 + 1.0) / (tf + k1 * length_norm)


def lexical_confidence(score: Column, exact_match: Column) -> Column:
    return F.least(F.try_divide(score, exact_match), F.lit(1.0))


def range_confidence(score: Column, low: Column | float, high: Column | float) -> Column:
    """0 up to half a range below ``low``, linear to 0.75 at ``high``, 1 above ``high``."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    ramp = F.greatest(F.lit(0.0), F.lit(0.5) + (score - low) / (high - low)) * 0.5
    return F.when(score > high, 1.0).otherwise(F.least(F.lit(1.0), ramp))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, without leaving the JVM."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_normalize(vec: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(vec, vec))
    return F.when(norm == 0, F.transform(vec, lambda x: x.cast("double"))).otherwise(
        F.transform(vec, lambda x: x.cast("double") / norm)
    )
