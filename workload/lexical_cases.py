"""Inverted index, statistics, BM25 and its incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.functions import scoring, text
from hayloft.operators import fusion, lexical
from hayloft.session import work_dir
from hayloft.sources import tables
from workload import views as v
from workload.registry import query, shown


def index(spark, sf):
    return lexical.build_index(lexical.indexable_texts(v.files(spark, sf)))


def stored(spark, sf):
    """The index as it lies in storage, in partitions by token."""
    root = work_dir(spark, "index")
    tables.write_index(index(spark, sf), root)
    return tables.read_index(spark, root)


def asked(spark, sf):
    return lexical.query_tokens(v.base_queries(spark, sf))


def matched(spark, sf, fields=S.TEXT_FIELDS, **options):
    return lexical.match(index(spark, sf), asked(spark, sf), fields, **options)


def fields(spark, sf, fields=S.TEXT_FIELDS):
    return lexical.bm25_fields(matched(spark, sf, fields))


def exact(spark, sf):
    return lexical.exact_match_scores(matched(spark, sf, tuple(S.FIELD_WEIGHTS)))


@query("p9_indexable_texts", v.sql("select item_id, field, text from texts", "texts"))
def indexable_texts(spark, sf):
    return lexical.indexable_texts(v.files(spark, sf)).select("item_id", "field", "text")


@query("a1_postings", v.sql("select field, variant, token, item_id, tf from postings", "postings"))
def postings(spark, sf):
    return index(spark, sf).postings.drop("dl")


@query(
    "a2_inverted_sets",
    v.sql(
        "select field, variant, token, item_id // 100 as part, string_agg(item_id::VARCHAR, ',' order by item_id) as items from postings group by all", "postings"
    ),
)
def inverted_sets(spark, sf):
    sets = lexical.inverted_sets(index(spark, sf).postings, span=100)
    return sets.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("a3_document_frequency", v.sql("select field, variant, token, df from token_stats", "token_stats"))
def document_frequency(spark, sf):
    return lexical.token_stats(index(spark, sf).postings)


@query("a4_item_lengths", v.sql("select field, variant, item_id, dl from doc_stats", "doc_stats"))
def item_lengths(spark, sf):
    return index(spark, sf).doc_stats


@query(
    "a5_corpus_stats",
    v.sql("select field, variant, n_items, total_len, round(avgdl, 9) as avgdl from corpus_stats", "corpus_stats"),
)
def corpus_stats(spark, sf):
    return lexical.corpus_stats(index(spark, sf).doc_stats).withColumn("avgdl", F.round("avgdl", 9))


@query("a6_idf", v.sql("select field, variant, token, df, round(idf, 9) as idf from idfs", "idfs"))
def idf(spark, sf):
    return lexical.idf_table(index(spark, sf)).select("field", "variant", "token", "df", scoring.settled(F.col("idf")).alias("idf"))


@query(
    "j3_token_lookup",
    v.sql("select q.query_id, p.field, p.variant, p.token, p.item_id, p.tf from postings p join qtokens q using (variant, token)", "postings", "qtokens"),
)
def token_lookup(spark, sf):
    return lexical.token_lookup(index(spark, sf).postings, asked(spark, sf)).drop("dl")


@query(
    "j3_stored_lookup",
    v.sql("select q.query_id, p.field, p.variant, p.token, p.item_id, p.tf from postings p join qtokens q using (variant, token)", "postings", "qtokens"),
)
def stored_lookup(spark, sf):
    """The same from stored postings: only the partitions of the asked tokens are opened."""
    return lexical.token_lookup(stored(spark, sf).postings, asked(spark, sf)).drop("dl")


@query(
    "l1_bm25_one_variant",
    v.sql(
        """select query_id, field, item_id, round(round_even(sum(idf * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) + 3e-10, 6) as score
           from postings join idfs using (field, variant, token) join qtokens using (variant, token) where variant = 'original' group by all""",
        "postings", "idfs", "qtokens",
    ),
)
def bm25_one_variant(spark, sf):
    one = asked(spark, sf).where("variant = 'original'")
    return shown(lexical.bm25_fields(lexical.match(index(spark, sf), one, variant_weights={"original": 1.0})))


@query("l2_bm25_fields", v.sql("select query_id, field, item_id, round(score + 3e-10, 6) as score from bm25", "bm25"))
def bm25_fields(spark, sf):
    return shown(fields(spark, sf))


@query("l3_exact_match", v.sql("select query_id, field, round(exact_match + 3e-10, 6) as exact_match from exact_fields", "exact_fields"))
def exact_match(spark, sf):
    return shown(exact(spark, sf), "exact_match")


@query(
    "l4_single_field_modes",
    v.sql(
        "select query_id, field, item_id, round(score + 3e-10, 6) as score, row_number() over (partition by query_id, field order by score desc, item_id) as rank from bm25 where field <> 'caption'",
        "bm25",
    ),
)
def single_field_modes(spark, sf):
    scores = fields(spark, sf, fields=tuple(S.FIELD_WEIGHTS))
    return shown(fusion.rank(scores, ("query_id", "field"), list_bound=bound(spark, sf)))


def bound(spark, sf) -> int:
    """Longest possible result list: the number of files, from the table's footers."""
    return v.table(spark, sf, "documents").count()


@query("l5_combined_lexical", v.sql("select query_id, item_id, round(score + 3e-10, 6) as score from lexical_list", "lexical_list"))
def combined_lexical(spark, sf):
    return shown(lexical_list(spark, sf))


@query("l5_stored_lexical", v.sql("select query_id, item_id, round(score + 3e-10, 6) as score from lexical_list", "lexical_list"))
def stored_lexical(spark, sf):
    """Combined lexical search on stored postings, token and field statistics."""
    scored = lexical.bm25_fields(lexical.match(stored(spark, sf), asked(spark, sf), tuple(S.FIELD_WEIGHTS)))
    return shown(fusion.max_weighted(scored, S.FIELD_WEIGHTS, "field"))


def lexical_list(spark, sf):
    return fusion.max_weighted(fields(spark, sf, fields=tuple(S.FIELD_WEIGHTS)), S.FIELD_WEIGHTS, "field")


def _after_edit(spark, sf):
    """Texts after an edit: French ones are cut down to their tokens, those of source 5 are deleted."""
    before = lexical.indexable_texts(v.files(spark, sf))
    facts = v.files(spark, sf).select(F.col("id").alias("item_id"), "lang", F.col("name").startswith("src5_").alias("gone"))
    joined = before.join(facts, "item_id")
    changed = joined.where("lang = 'fr' or gone")
    after = changed.where("not gone").withColumn("text", F.array_join(text.tokens(F.col("text")), " s "))
    return before, changed.select("item_id", "field", "text"), after.select("item_id", "field", "text")


_AFTER_TEXTS = f""", after_texts as (
  select t.item_id, t.field, case when f.lang = 'fr' then array_to_string({v.TOKENS.format('t.text')}, ' s ') else t.text end as text
  from texts t join files f on f.id = t.item_id where f.name not like 'src5\\_%' escape '\\')"""


@query(
    "l6_index_delta",
    v.sql(
        _AFTER_TEXTS
        + f""", toks as (select item_id, field, unnest({v.TOKENS.format('text')}) as token from after_texts)
          select field, variant, token, item_id, count(*) as tf from (
            select field, 'original' as variant, token, item_id from toks
            union all select field, 'lemma', {v.STEM.format('token')}, item_id from toks) group by all""",
        "texts",
    ),
)
def index_delta(spark, sf):
    before, old, new = _after_edit(spark, sf)
    after = lexical.apply_delta(lexical.build_index(before), lexical.signed_postings(old, new))
    return after.postings.drop("dl")


@query(
    "l6_delta_statistics",
    v.sql(
        _AFTER_TEXTS
        + f""" select field, variant, count(*) as n_items, sum(len({v.TOKENS.format('text')}))::BIGINT as total_len
               from after_texts, (select unnest(['original', 'lemma']) as variant) group by all""",
        "texts",
    ),
)
def delta_statistics(spark, sf):
    before, old, new = _after_edit(spark, sf)
    after = lexical.apply_delta(lexical.build_index(before), lexical.signed_postings(old, new))
    return lexical.corpus_stats(after.doc_stats).drop("avgdl")
