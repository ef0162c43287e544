"""Inverted index and BM25 over several text fields, each in original and lemma form.

Shapes: ``texts(item_id, field, text)`` -> ``postings(field, variant, token, item_id, tf, dl)`` and
``doc_stats(field, variant, item_id, dl)``. Inverse frequencies and average lengths are derived when a
query batch is scored, so postings never carry numbers that another file's change would make stale.

Texts are dealt to tasks by item once; an item's tokens are then counted where its text is, row by row, so that
memory does not grow with the postings of a task. Scoring drops postings of tokens nobody asked for first. The item
length travels inside the posting, which saves the join of postings with item lengths.

Stored postings lie in partitions by a hash of their token, and so do the token statistics: a batch of queries reads the
partitions of its own tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from hayloft import schemas as S
from hayloft.functions import scoring, text
from hayloft.session import BROADCAST_ROWS, broadcast_if_small, fits

# Partitions of stored postings; a batch's tokens name at most so many.
BUCKETS = 64
# Postings of a part are grouped in slices by token, as many as there are so many items in the part.
SLICE_ITEMS = 1_000


class LexicalIndex(NamedTuple):
    postings: DataFrame  # field, variant, token, item_id, tf, dl
    doc_stats: DataFrame  # field, variant, item_id, dl
    token_stats: DataFrame | None = None  # field, variant, token, df; counted from the postings when not stored
    field_stats: DataFrame | None = None  # field, variant, n_items, total_len, avgdl; likewise


def bucket_of(token: Column) -> Column:
    """Partition of a token's stored postings."""
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


# field -> (text column, analysed flag or None, stored lemma column)
FIELD_COLUMNS = {
    "description": ("description", None, "lemmatized_description"),
    "ocr": ("ocr_text", "is_ocr_analyzed", "lemmatized_ocr_text"),
    "transcript": ("transcript", "is_transcript_analyzed", "lemmatized_transcript"),
    "caption": ("llm_description", "is_llm_description_analyzed", "lemmatized_llm_description"),
}


def indexable_texts(files: DataFrame, fields=S.TEXT_FIELDS) -> DataFrame:
    """Which text of which file enters which field index: analysed, present, not empty."""
    cells = []
    for field in fields:
        column, flag, lemma_column = FIELD_COLUMNS[field]
        usable = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)
        lemma = F.col(lemma_column) if lemma_column in files.columns else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(field).alias("field"), F.when(usable, F.col(column)).alias("text"), lemma.alias("lemmas")))
    return (
        files.select(F.col("id").alias("item_id"), F.explode(F.array(*cells)).alias("cell"))
        .select("item_id", "cell.*")
        .where("text <> ''")
    )


def variant_tokens(texts: DataFrame, lemmatize: Callable[[Column], Column] = text.plain_stem) -> DataFrame:
    """(item_id, field, variant, tokens): original tokens, and the stored lemmas or their stand-in."""
    # a column of its own: the text is matched once for both variants
    texts = texts.withColumn("_original", text.tokens(F.col("text")))
    original = F.col("_original")
    lemmas = lemmatize(original)
    if "lemmas" in texts.columns:
        lemmas = F.coalesce(text.split_lemmas(F.col("lemmas")), lemmas)
    both = F.array(
        F.struct(F.lit("original").alias("variant"), original.alias("tokens")),
        F.struct(F.lit("lemma").alias("variant"), lemmas.alias("tokens")),
    )
    return texts.select("item_id", "field", F.explode(both).alias("v")).select("item_id", "field", "v.*")


def lemmatize_by_table(texts: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """(item_id, pos, lemma): words of each text looked up in ``(lang, form, lemma)``, in order.

    An unknown form is its own lemma; single punctuation marks are dropped. Words meet the table by
    an equi-join; a frequent word's rows are split by the adaptive skew join.
    """
    words = texts.select("item_id", "lang", F.posexplode(text.split_lemmas(F.lower("text"))).alias("pos", "form"))
    lemma = F.coalesce("lemma", "form")
    return (
        words.join(broadcast_if_small(lemma_table.select("lang", "form", "lemma")), ["lang", "form"], "left")
        .select("item_id", "pos", F.lower(lemma).alias("lemma"))
        .where(text.keep_lemma(F.col("lemma")))
    )


@F.arrow_udf(ArrayType(StructType().add("token", "string").add("tf", "long")))
def token_counts(tokens: pa.Array) -> pa.Array:
    """Distinct tokens of each text with their numbers."""
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode(null_encoding="encode")
    size = max(1, len(words.dictionary))
    rows = np.repeat(np.arange(len(tokens)), lengths)
    found, counts = np.unique(rows * size + words.indices.to_numpy(), return_counts=True)
    starts = np.searchsorted(found, np.arange(len(tokens) + 1) * size)
    entries = pa.StructArray.from_arrays([words.dictionary.take(pa.array(found % size)), pa.array(counts, pa.int64())], ["token", "tf"])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entries)


def build_index(texts: DataFrame, lemmatize: Callable[[Column], Column] = text.plain_stem) -> LexicalIndex:
    # ids are unique per text, so no task gets more than its share; moving texts is cheaper than moving
    # the tokens of both variants
    dealt = texts.repartition("item_id")
    toks = variant_tokens(dealt, lemmatize).withColumn("dl", F.size("tokens").cast("long"))

    def counted(some: DataFrame) -> DataFrame:
        tokens = variant_tokens(some, lemmatize).withColumn("dl", F.size("tokens").cast("long"))
        counts = tokens.select("field", "variant", "item_id", "dl", token_counts("tokens").alias("counts"))
        # an inner explode would ask for the counts once more, to leave out texts without any
        entries = counts.select("field", "variant", "item_id", "dl", F.explode_outer("counts").alias("c")).where("c is not null")
        return entries.select("field", "variant", "c.token", "item_id", "c.tf", "dl")

    # a text's tokens are counted in its own row, which takes no table of a task's postings; only where an
    # item has several texts of a field are these added up over rows
    item = ("item_id", "field")
    if fits(texts.groupBy(*item).count().where("count > 1"), 0):
        postings = counted(dealt)
    else:
        copies = dealt.withColumn("_copies", F.count("*").over(Window.partitionBy(*item)))
        key = ("field", "variant", "token", "item_id", "dl")
        several = counted(copies.where("_copies > 1")).groupBy(*key).agg(F.sum("tf").alias("tf"))
        postings = counted(copies.where("_copies = 1")).unionByName(several)
    return LexicalIndex(postings, toks.select("field", "variant", "item_id", "dl"))


def token_stats(postings: DataFrame) -> DataFrame:
    """Number of items that hold a token; postings are unique per item, so this is a count."""
    return postings.groupBy("field", "variant", "token").agg(F.count("*").alias("df"))


def token_bounds(postings: DataFrame) -> DataFrame:
    """Document frequency of each token, its greatest count in a text and the shortest text that holds it.

    The BM25 share grows with the count and falls with the length, so these two bound it for any average length.
    """
    return postings.groupBy("field", "variant", "token").agg(
        F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")
    )


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row per field and variant: items, total and average length."""
    return doc_stats.groupBy("field", "variant").agg(
        F.count("*").alias("n_items"),
        F.sum("dl").alias("total_len"),
        F.avg("dl").alias("avgdl"),
    )


def idf_table(index: LexicalIndex) -> DataFrame:
    stats = F.broadcast(corpus_stats(index.doc_stats))  # at most fields x variants rows
    return (
        token_stats(index.postings)
        .join(stats, ["field", "variant"])
        .select("field", "variant", "token", "df", scoring.idf(F.col("n_items"), F.col("df")).alias("idf"), "avgdl")
    )


def inverted_sets(postings: DataFrame, span: int = 100_000) -> DataFrame:
    """(field, variant, token, part, items): the sorted items of a token, for reports.

    A frequent token's items come in parts, one per ``span`` of item ids, so that no row or task
    holds a list that grows with the collection. Scoring reads postings, never these sets.
    Postings are dealt once by slices of a part, sorted by slice, and a task makes the sets of one slice after the other.
    """
    slices = max(1, span // SLICE_ITEMS)
    parts = postings.select("field", "variant", "token", "item_id", F.floor(F.col("item_id") / span).alias("part"))
    place = F.pmod(F.xxhash64("token"), F.lit(slices))
    dealt = parts.withColumn("slice", F.col("part") * slices + place).repartition("slice").sortWithinPartitions("slice")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            number = batch.column("slice").fill_null(np.iinfo(np.int64).min).to_numpy()
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if held and number[lo] != last:
                        yield _sets_of(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = number[lo]
        if held:
            yield _sets_of(pa.Table.from_batches(held))

    kinds = {c: parts.schema[c].dataType.simpleString() for c in ("field", "variant", "token", "part", "item_id")}
    item = kinds.pop("item_id")
    return dealt.mapInArrow(sets, ", ".join([*(f"{c} {t}" for c, t in kinds.items()), f"items array<{item}>"]))


def _sets_of(rows: pa.Table) -> pa.RecordBatch:
    """The sets of a slice, whose rows are of one part; a token that has no item but null has an empty set."""
    group, named = np.zeros(len(rows), np.int64), []
    for c in ("field", "variant", "token"):
        encoded = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        group = group * len(encoded.dictionary) + encoded.indices.to_numpy()
        named.append(encoded.dictionary)
    items = rows.column("item_id").combine_chunks()
    known = items.is_valid().to_numpy(zero_copy_only=False)
    item = items.fill_null(0).to_numpy()
    groups = np.unique(group)
    group, item = group[known], item[known]
    order = np.lexsort((item, group))
    group, item = group[order], item[order]
    new = np.append(True, (group[1:] != group[:-1]) | (item[1:] != item[:-1]))[: len(group)]
    group, item = group[new], item[new]
    ends = np.append(np.searchsorted(group, groups), len(group))
    columns, left = [], groups
    for values in reversed(named):
        columns.append(values.take(pa.array(left % len(values))))
        left = left // len(values)
    part = rows.column("part").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(groups), np.int64)))
    sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(item).cast(items.type))
    return pa.RecordBatch.from_arrays([*reversed(columns), part, sets], names=["field", "variant", "token", "part", "items"])


def query_tokens(
    queries: DataFrame, text_col: str = "query_text", lemmatize: Callable[[Column], Column] = text.plain_stem
) -> DataFrame:
    """Distinct tokens per query and variant."""
    original = text.tokens(F.col(text_col))
    both = F.array(
        F.struct(F.lit("original").alias("variant"), F.array_distinct(original).alias("tokens")),
        F.struct(F.lit("lemma").alias("variant"), F.array_distinct(lemmatize(original)).alias("tokens")),
    )
    return (
        queries.select("query_id", F.explode(both).alias("v"))
        .select("query_id", "v.variant", F.explode("v.tokens").alias("token"))
    )


def token_lookup(postings: DataFrame, qtokens: DataFrame) -> DataFrame:
    """Postings of the asked tokens, one row per asking query."""
    asked = asked_buckets(qtokens)
    hint = F.broadcast if asked.small else (lambda df: df)
    return asked.of(postings).join(hint(qtokens), ["variant", "token"])


class Buckets(NamedTuple):
    """Partitions that the tokens of a batch lie in, and whether the tokens are few enough to be broadcast."""

    numbers: list[int]
    small: bool

    def of(self, stored: DataFrame) -> DataFrame:
        """Rows of a stored table that can hold asked tokens: other partitions are not listed for the scan."""
        if "bucket" not in stored.columns:
            return stored
        return stored.where(F.col("bucket").isin(*self.numbers)).drop("bucket")


def asked_buckets(qtokens: DataFrame) -> Buckets:
    """One row per partition reaches the driver, whatever the number of tokens."""
    counts = qtokens.groupBy(bucket_of(F.col("token")).alias("bucket")).count().collect()
    return Buckets(sorted(r["bucket"] for r in counts), sum(r["count"] for r in counts) <= BROADCAST_ROWS)


def _variant_weight(weights: dict[str, float]) -> Column:
    return reduce(lambda acc, kv: acc.when(F.col("variant") == kv[0], float(kv[1])), weights.items(), F)


class Matched(NamedTuple):
    """What a batch of queries finds in an index: read once for scores and exact-match scores alike."""

    qtokens: DataFrame  # query_id, variant, token
    hits: DataFrame  # field, variant, token, item_id, share: BM25 share of the asked tokens, before idf
    weights: DataFrame  # query_id, field, variant, token, weight (variant weight x idf), avgdl, df and bounds if stored
    filled: DataFrame  # fields that hold any text
    small: bool  # the query tokens passed the size check for broadcasts


def match(
    index: LexicalIndex,
    qtokens: DataFrame,
    fields=S.TEXT_FIELDS,
    k1: float = S.BM25_K1,
    b: float = S.BM25_B,
    variant_weights: dict[str, float] = S.VARIANT_WEIGHTS,
    buckets: Buckets | None = None,
) -> Matched:
    """Postings and weights of the asked tokens.

    Vocabulary and weights hold at most one row per query token and field, so one size check of the
    query tokens decides all broadcasts; a larger batch is joined by shuffling.
    """
    buckets = buckets or asked_buckets(qtokens)
    small = buckets.small
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = qtokens.select("variant", "token").distinct()
    wanted = F.col("field").isin(*fields)
    asked = buckets.of(index.postings.where(wanted)).join(hint(vocabulary), ["variant", "token"], "left_semi")
    per_field = corpus_stats(index.doc_stats.where(wanted)) if index.field_stats is None else index.field_stats.where(wanted)
    sizes = F.broadcast(per_field)  # at most fields x variants rows
    counted = token_stats(asked) if index.token_stats is None else buckets.of(index.token_stats.where(wanted))
    bounds = [c for c in ("df", "max_tf", "min_dl") if c in counted.columns]
    idfs = counted.join(sizes, ["field", "variant"]).select(
        "field", "variant", "token", "avgdl", *bounds, scoring.idf(F.col("n_items"), F.col("df")).alias("idf")
    )
    weights = idfs.join(hint(qtokens), ["variant", "token"]).select(
        "query_id", "field", "variant", "token", "avgdl", *bounds, (_variant_weight(variant_weights) * F.col("idf")).alias("weight")
    )
    share = scoring.bm25_saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    hits = asked.join(sizes, ["field", "variant"]).select("field", "variant", "token", "item_id", share.alias("share"))
    return Matched(hint(qtokens), hits, hint(weights), per_field.select("field").distinct(), small)


def bm25_fields(matched: Matched) -> DataFrame:
    """(query_id, field, item_id, score): BM25 summed over distinct query tokens and variants.

    The sums of an item's fields stand in one row while terms are added up, so that what follows per item needs no other exchange.
    """
    at = lambda f: F.when(F.col("field") == f, F.col("weight") * F.col("share"))
    sums = (
        matched.hits.join(matched.weights, ["field", "variant", "token"])
        .groupBy("query_id", "item_id")
        .agg(*[scoring.settled(F.sum(at(f))).alias(f) for f in S.TEXT_FIELDS])
    )
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("score")) for f in S.TEXT_FIELDS])).alias("f")
    return sums.select("query_id", "item_id", each).select("query_id", "f.field", "item_id", "f.score").where("score is not null")


def exact_match_scores(
    matched: Matched,
    fields=tuple(S.FIELD_WEIGHTS),
    k1: float = S.BM25_K1,
    b: float = S.BM25_B,
    extra_tokens: int = S.EXACT_MATCH_EXTRA_TOKENS,
    missing_score: float = S.MISSING_TOKEN_SCORE,
    skip_empty_fields: bool = False,
) -> DataFrame:
    """(query_id, field, exact_match): score of an imaginary text that is the query plus some filler.

    A token the field does not hold adds a constant. A field without any text scores every token
    that way unless ``skip_empty_fields`` is set.
    """
    known = matched.weights.select("query_id", "field", "variant", "token", "weight", "avgdl")
    lengths = matched.qtokens.groupBy("query_id", "variant").agg((F.count("*") + extra_tokens).alias("dl"))
    asked = matched.qtokens.join(lengths, ["query_id", "variant"]).withColumn(
        "field", F.explode(F.array(*[F.lit(f) for f in fields]))
    )
    if skip_empty_fields:
        asked = asked.join(F.broadcast(matched.filled), "field", "left_semi")  # one row per field
    one_hit = F.col("weight") * scoring.bm25_saturation(F.lit(1.0), F.col("dl"), F.col("avgdl"), k1, b)
    missing = _variant_weight(S.VARIANT_WEIGHTS) * missing_score
    return (
        asked.join(known, ["query_id", "field", "variant", "token"], "left")
        .withColumn("part", F.when(F.col("weight").isNull(), missing).otherwise(one_hit))
        .groupBy("query_id", "field")
        .agg(scoring.settled(F.sum("part")).alias("exact_match"))
    )


def best_exact_match(per_field: DataFrame) -> DataFrame:
    return per_field.groupBy("query_id").agg(F.max("exact_match").alias("exact_match"))


def signed_postings(old_texts: DataFrame, new_texts: DataFrame, lemmatize=text.plain_stem) -> LexicalIndex:
    """Index changes as signed rows: what leaves (-1) and what enters (+1)."""
    gone, come = build_index(old_texts, lemmatize), build_index(new_texts, lemmatize)

    def both(minus: DataFrame, plus: DataFrame) -> DataFrame:
        return minus.withColumn("sign", F.lit(-1)).unionByName(plus.withColumn("sign", F.lit(1)))

    return LexicalIndex(both(gone.postings, come.postings), both(gone.doc_stats, come.doc_stats))


def apply_delta(index: LexicalIndex, delta: LexicalIndex) -> LexicalIndex:
    """Index after a signed change; rows that cancel out disappear.

    Only texts named by the change are summed up again; the rest of the index is passed on by an
    anti join against the changed (field, item) pairs, which are broadcast while they are few.
    """
    key = ["field", "item_id"]
    touched = broadcast_if_small(delta.doc_stats.select(*key).distinct())
    if "bucket" in index.postings.columns:
        delta = delta._replace(postings=delta.postings.withColumn("bucket", bucket_of(F.col("token"))))

    def merged(base: DataFrame, change: DataFrame) -> DataFrame:
        columns = base.columns
        old = base.join(touched, key, "left_semi").withColumn("sign", F.lit(1))
        net = old.unionByName(change).groupBy(*columns).agg(F.sum("sign").alias("n")).where("n > 0")
        return base.join(touched, key, "left_anti").select(*columns).unionByName(net.select(*columns))

    return LexicalIndex(merged(index.postings, delta.postings), merged(index.doc_stats, delta.doc_stats))
