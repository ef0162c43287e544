"""Quality rules: surface counts, and a hashed n-gram likelihood ratio between trusted and all text.

Words and pairs of neighbouring words fall into ``buckets`` by hash. Two multinomials over the buckets, one
of a trusted part of the corpus and one of all of it, give each bucket a log ratio; a text's score is
the mean over its n-grams. A text is kept when it passes the base rules and its score is at or above a
fixed threshold, so the verdict depends on nothing but the counts. The table of ratios has a fixed
size whatever the corpus; everything else is an expression on a text's own row, and only counts per
bucket are shuffled.

Defined cases: null, empty and blank texts have no words, fail the base rules and score 0; without any
trusted text all ratios are 0; repeated rows count as often as they occur; null ids are never trusted;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import stored, words

BUCKETS = 16_384
PRIOR = 1.0  # added to each bucket's count
THRESHOLD = -0.06
WINDOW = 8
TRUSTED_IDS = 1_000_000  # broadcast up to so many ids of eight bytes, joined by a shuffle beyond


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds ``word``, the words, ``one``, their hashes, and ``two``, the hashes of neighbours."""
    one = F.transform("word", lambda w: F.xxhash64(w))
    two = F.when(F.size("one") > 1, F.transform(F.sequence(F.lit(0), F.size("one") - 2), lambda i: F.xxhash64(F.get("one", i), F.get("one", i + 1))))
    return (
        docs.withColumn("word", words(F.col("text")))
        .withColumn("one", one)
        .withColumn("two", F.coalesce(two, F.array().cast("array<bigint>")))
    )


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratio``, the log ratio of every bucket, in order.

    ``trusted(doc_id)`` names documents of ``docs(doc_id, text)`` to learn the target from.
    """
    ids = trusted.where(F.col("doc_id").isNotNull()).distinct()
    small = ids.limit(TRUSTED_IDS + 1).count() <= TRUSTED_IDS
    marked = ids.withColumnRenamed("doc_id", "trusted_id")
    known = docs.select("doc_id", "text").join(F.broadcast(marked) if small else marked, F.col("doc_id") == F.col("trusted_id"), "left")
    grams = _hashed(known.select("text", F.col("trusted_id").isNotNull().alias("good"))).select("good", F.explode(F.concat("one", "two")).alias("gram"))
    counts = grams.groupBy(F.pmod("gram", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))
    counts = stored(counts, "gram-counts")
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()

    def log_share(name: str) -> Column:
        return F.log((F.coalesce(F.col(name), F.lit(0)) + PRIOR) / (totals[name] + PRIOR * buckets))

    ratio = log_share("target") - log_share("raw") if totals["target"] else F.lit(0.0)
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("bucket", ratio.alias("ratio"))))["ratio"].alias("ratio"))


def _repeated_words() -> tuple[Column, Column, Column]:
    """Windows of eight words; those that occur twice, by hash; the words they cover."""
    pairs = [F.lit(0), F.lit(2), F.lit(4), F.lit(6)]
    windows = F.when(
        F.size("one") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("one") - WINDOW), lambda i: F.xxhash64(*(F.get("two", i + k) for k in pairs)))
    )
    # most texts repeat nothing, which the number of distinct windows shows without sorting
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    again = F.filter("ordered", lambda e, k: (e["x"] == F.get("ordered", k - 1)["x"]) | (e["x"] == F.get("ordered", k + 1)["x"]))
    places = F.sort_array(F.transform(again, lambda e: e["i"]))
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate(
        places, start, lambda s, i: F.struct((s["covered"] + i + WINDOW - F.greatest(i, s["end"])).alias("covered"), (i + WINDOW).alias("end"))
    )["covered"]
    return windows, ordered, F.coalesce(covered, F.lit(0).cast("long"))


def scored(docs: DataFrame, ratio: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of each row of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    base = docs.select(
        "doc_id", "text", (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"), lines.alias("lines")
    ).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    windows, ordered, repeated = _repeated_words()
    counted = (
        _hashed(base.select("doc_id", "text", "n_symbols", "n_dup_lines"))
        .select(
            "doc_id",
            "n_symbols",
            "n_dup_lines",
            F.size("word").cast("long").alias("n_words"),
            F.length(F.array_join("word", "")).cast("long").alias("word_chars"),
            "one",
            "two",
            windows.alias("windows"),
        )
        .withColumn("ordered", ordered)
        .withColumn("ratios", ratio.scalar())
    )
    with_sums = counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        F.aggregate(F.concat("one", "two"), F.lit(0.0), lambda s, x: s + F.get("ratios", F.pmod(x, F.lit(buckets)).cast("int"))).alias("total"),
    )
    # a filter on the verdict would be pushed into the expressions above and repeat them for every word: the counts are written first
    with_sums = stored(with_sums, "quality-counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    score = F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words") - 1)).otherwise(0.0)
    return (
        with_sums.withColumn("base_failed", failed)
        .withColumn("score", score)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("total")
    )
