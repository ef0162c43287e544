"""Catalog, queries, vectors and logs derived from the given tables.

Every view exists twice: as a DataFrame for our operators and as a SQL common table expression for
the check. The two are written independently of the operators under test and must agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.operators import enrich, vectors
from hayloft.session import spread

MARKERS = (
    "", "@lex ", "@sem ", "@dlex ", "@dsem ", "@olex ", "@osem ", "@tlex ", "@tsem ", "@clip ", "@llm ",
    "@image ", "@!ss @lex ", "@video @sem ", "@ss @nonsense ", "@sem @audio @image @lex ",
)


_tables: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its footer is read once per session, its rows every time."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _tables:
        _tables[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _tables[key]


def files(spark: SparkSession, sf: str) -> DataFrame:
    """One media file per document; source decides the type, language and labels the state."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    captions = (
        table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id")
        .agg(F.expr("listagg(text, ' ') within group (order by turn)").alias("caption"))
    )
    docs = spread(table(spark, sf, "documents"))
    joined = docs.join(labels, "doc_id", "left").join(captions, docs.doc_id == captions.conv_id, "left")
    source = F.substring("source", 4, 9).cast("int")
    typed = joined.withColumn("src", source).withColumn(
        "ftype", F.when(source < 10, "image").when(source < 15, "video").otherwise("audio")
    )
    spanish = F.col("lang") == "es"
    audible, visible = F.col("ftype").isin("video", "audio"), F.col("ftype").isin("image", "video")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    shot = (F.col("ftype") == "image") & ~spanish & good
    suffix = F.when(F.col("ftype") == "image", ".jpg").when(F.col("ftype") == "video", ".mp4").otherwise(".mp3")
    return typed.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), suffix).alias("name"),
        F.expr("timestampadd(SECOND, n_chars, timestamp_ntz'2024-01-01 00:00:00')").alias("added_at"),
        F.when(F.col("lang").isin("en", "de"), F.col("text")).otherwise("").alias("description"),
        "ftype",
        (audible & ~spanish).alias("is_transcript_analyzed"),
        F.when(audible & ~spanish & (F.col("src") != 19), F.lower("text")).alias("transcript"),
        (audible & ~spanish & good).alias("is_transcript_fixed"),
        ((F.col("ftype") == "image") & ~spanish).alias("is_ocr_analyzed"),
        shot.alias("is_screenshot"),
        F.when(shot, F.translate("text", "\n", " ")).alias("ocr_text"),
        (visible & ~spanish).alias("is_llm_description_analyzed"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("caption")).alias("llm_description"),
        (F.col("src") == 3).alias("embedding_generation_failed"),
        (F.col("n_chars") / 10.0).cast("double").alias("duration"),
        "lang",
    )


def base_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark texts as plain queries."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def raw_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text in every search mode, file names, and listings by type."""
    marked = table(spark, sf, "benchmark").select(
        "item_id", "text", F.posexplode(F.array(*[F.lit(m) for m in MARKERS])).alias("pos", "marker")
    )
    texts = marked.select((F.col("item_id") * len(MARKERS) + F.col("pos")).alias("query_id"), F.concat("marker", "text").alias("raw"))
    names = (
        table(spark, sf, "benchmark").join(files(spark, sf), F.col("item_id") == F.col("id"))
        .select((F.col("id") + 1_000_000).alias("query_id"), F.concat(F.lit("@tlex "), "name").alias("raw"))
    )
    marks = F.array(F.lit(""), F.lit(" @ss"), F.lit(" @!ss"))
    types = files(spark, sf).select("ftype").distinct()
    listings = types.select(F.length("ftype").alias("n"), F.ascii("ftype").alias("a"), "ftype", F.posexplode(marks).alias("pos", "mark"))
    listings = listings.select(
        (F.lit(2_000_000) + F.col("a") * 10 + F.col("pos")).cast("long").alias("query_id"),
        F.concat(F.lit("@"), "ftype", "mark").alias("raw"),
    )
    return texts.unionByName(names).unionByName(listings)


def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    wanted = vectors.wanted_embeddings(files(spark, sf)).where("text is not null")
    return enrich.embed_texts(wanted)


def pixel_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Given vectors as picture vectors of image files and as frames, four each, of video files."""
    vecs = table(spark, sf, "embeddings")
    kinds = files(spark, sf).where("not embedding_generation_failed").select(F.col("id").alias("item_id"), "ftype")
    images = vecs.select(F.col("vec_id").alias("item_id"), F.lit(0).alias("frame"), F.col("embedding").alias("vec"))
    frames = vecs.select(
        F.floor(F.col("vec_id") / 4).alias("item_id"), (F.col("vec_id") % 4).cast("int").alias("frame"), F.col("embedding").alias("vec")
    )

    def of(rows: DataFrame, ftype: str, kind: str) -> DataFrame:
        return rows.join(kinds.where(F.col("ftype") == ftype).select("item_id"), "item_id", "left_semi").select(
            "item_id", F.lit(kind).alias("kind"), "frame", "vec", F.lit(None).cast("string").alias("text_sha")
        )

    return of(images, "image", "C").unionByName(of(frames, "video", "V"))


def store(spark: SparkSession, sf: str) -> DataFrame:
    return text_vectors(spark, sf).unionByName(pixel_vectors(spark, sf))


def query_vectors(spark: SparkSession, sf: str, queries: DataFrame) -> DataFrame:
    return enrich.embed_queries(queries).where("vec is not null")


def clip_query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark query's picture vector is the given vector of the same number."""
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vecs.join(base_queries(spark, sf).select("query_id"), "query_id", "left_semi")


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an edit log over the files; purchases edit one field after the other."""
    events = table(spark, sf, "events")
    op = {"click": "description", "view": "transcript", "error": "ocr", "signup": "screenshot"}
    turns = F.element_at(F.array(*[F.lit(x) for x in op.values()]), (F.col("event_id") % 4 + 1).cast("int"))
    named = reduce(lambda acc, kv: acc.when(F.col("event_type") == kv[0], kv[1]), op.items(), F).otherwise(turns)
    value = F.when(F.col("op") == "screenshot", F.when(F.col("value") > 10, "true").otherwise("false")).otherwise(
        F.concat(F.lit("  "), "props", F.lit("\n"))
    )
    return events.withColumn("op", named).select(F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"), "op", value.alias("value"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a file-change feed. Event times are squeezed so that neighbours lie within seconds."""
    events = table(spark, sf, "events")
    ops = {"signup": "created", "view": "opened", "click": "closed", "purchase": "deleted", "error": "moved"}
    op = reduce(lambda acc, kv: acc.when(F.col("event_type") == kv[0], kv[1]), ops.items(), F)
    path = lambda n: F.concat(F.lit("/media/f"), n.cast("string"))
    return events.select(
        F.col("event_id").alias("seq"),
        F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("event_id") * 20).alias("ts"),
        op.alias("op"),
        path(F.col("user_id")).alias("path"),
        F.when(F.col("event_type") == "error", F.concat(F.when(F.col("value") > 30, "/other").otherwise("/media"), F.lit("/f"), (F.col("user_id") + 1).cast("string"))).alias("dest_path"),
        F.lit(False).alias("is_directory"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as the frame tokens of an utterance."""
    from pyspark.sql import Window

    events = table(spark, sf, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    return events.select(F.col("user_id").alias("utt"), t.cast("long").alias("t"), F.col("event_type").alias("token"), (F.col("value") / 1000).alias("prob"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a document as text boxes of an image; a box's place decides its probability."""
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        "item_id", F.col("pos").cast("long").alias("pos"), "text", ((F.col("pos") * 7 % 10) / 10).alias("prob")
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """(lang, word) of every token occurrence of the documents."""
    from hayloft.functions.text import tokens

    return spread(table(spark, sf, "documents")).select("lang", F.explode(tokens(F.col("text"))).alias("word"))


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).groupBy("lang", "word").agg(F.count("*").alias("n"))


def dictionary(spark: SparkSession, sf: str, counts: DataFrame | None = None) -> DataFrame:
    """(lang, word, freq): tokens that occur five times or more, with their share of all dictionary tokens."""
    counted = (word_counts(spark, sf) if counts is None else counts).where("n >= 5")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    return counted.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("freq"))


def query_words(spark: SparkSession, sf: str, counts: DataFrame | None = None) -> DataFrame:
    """(lang, word): tokens of the benchmark queries, as English words, and all tokens of the documents that no dictionary has."""
    from hayloft.functions.text import tokens

    asked = table(spark, sf, "benchmark").select(F.lit("en").alias("lang"), F.explode(tokens(F.col("text"))).alias("word"))
    rare = (word_counts(spark, sf) if counts is None else counts).where("n < 5").select("lang", "word")
    return asked.unionByName(rare).distinct()


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation turn with the next one as reference and hypothesis."""
    turns = table(spark, sf, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return turns.join(nxt, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", F.col("text").alias("ref"), "hyp"
    )


# --- the same views in SQL ------------------------------------------------------------------------

TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_''-]+')"
STEM = "regexp_replace({}, '^(.{{3,}})s$', '\\1')"
_marker_list = ", ".join(f"'{m}'" for m in MARKERS)
_slot = "('0x' || substr(md5(token), 1, 8))::BIGINT % 64"
_sign = "case when ('0x' || substr(md5(token), 9, 1))::BIGINT < 8 then 1 else -1 end"


def _embed(source: str, keys: str) -> str:
    """SQL of signed hashed token counts, unit length, single precision."""
    k = ", ".join(f"x.{c.strip()}" for c in keys.split(","))
    return f"""
      select {keys}, list(((coalesce(v, 0) / norm)::FLOAT)::DOUBLE order by dim) as vec
      from (
        select {k}, d.dim, c.v, x.norm
        from (select {keys}, sqrt(sum(v * v)) as norm from {source} group by all having sum(v * v) > 0) x
        cross join (select unnest(range(64)) as dim) d
        left join {source} c on {" and ".join(f"c.{i.strip()} = x.{i.strip()}" for i in keys.split(","))} and c.dim = d.dim
      ) group by {keys}"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "captions": ((), "select conv_id, string_agg(text, ' ' order by turn) as caption from conversations where role = 'assistant' group by conv_id"),
    "typed": (
        ("captions",),
        """select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, c.caption, substr(d.source, 4)::INT as src,
             case when substr(d.source, 4)::INT < 10 then 'image' when substr(d.source, 4)::INT < 15 then 'video' else 'audio' end as ftype
           from documents d left join labels l on l.doc_id = d.doc_id left join captions c on c.conv_id = d.doc_id""",
    ),
    "files": (
        ("typed",),
        """select doc_id as id,
             source || '_' || doc_id || case ftype when 'image' then '.jpg' when 'video' then '.mp4' else '.mp3' end as name,
             timestamp '2024-01-01 00:00:00' + to_seconds(n_chars) as added_at,
             case when lang in ('en', 'de') then text else '' end as description,
             ftype,
             ftype <> 'image' and lang <> 'es' as is_transcript_analyzed,
             case when ftype <> 'image' and lang <> 'es' and src <> 19 then lower(text) end as transcript,
             ftype <> 'image' and lang <> 'es' and coalesce(quality = 1, false) as is_transcript_fixed,
             ftype = 'image' and lang <> 'es' as is_ocr_analyzed,
             ftype = 'image' and lang <> 'es' and coalesce(quality = 1, false) as is_screenshot,
             case when ftype = 'image' and lang <> 'es' and quality = 1 then replace(text, chr(10), ' ') end as ocr_text,
             ftype <> 'audio' and lang <> 'es' as is_llm_description_analyzed,
             case when toxic = 1 then '' else caption end as llm_description,
             src = 3 as embedding_generation_failed,
             n_chars / 10.0::DOUBLE as duration,
             lang
           from typed""",
    ),
    "base_queries": ((), "select item_id as query_id, text as query_text from benchmark"),
    "raw_queries": (
        ("files",),
        f"""select item_id * {len(MARKERS)} + pos as query_id, marker || text as raw
            from benchmark, (select unnest([{_marker_list}]) as marker, unnest(range({len(MARKERS)})) as pos)
            union all
            select id + 1000000, '@tlex ' || name from files join benchmark on item_id = id
            union all
            select 2000000 + ascii(ftype) * 10 + pos, '@' || ftype || mark
            from (select distinct ftype from files), (select unnest(['', ' @ss', ' @!ss']) as mark, unnest(range(3)) as pos)""",
    ),
    "found_markers": (("raw_queries",), r"select query_id, raw, regexp_extract_all(raw, '@(\S+)', 1) as ms from raw_queries"),
    "parsed": (
        ("found_markers",),
        r"""select query_id, raw,
              regexp_replace(regexp_replace(raw, '@(\S+)', '', 'g'), '^\s+|\s+$', '', 'g') as query_text,
              coalesce(case list_extract(list_filter(ms, lambda m: m in ('lex','sem','dlex','dsem','olex','osem','tlex','tsem','clip','llm')), -1)
                when 'lex' then 'combined_lexical' when 'sem' then 'combined_semantic'
                when 'dlex' then 'description_lexical' when 'dsem' then 'description_semantic'
                when 'olex' then 'ocr_lexical' when 'osem' then 'ocr_semantic'
                when 'tlex' then 'transcript_lexical' when 'tsem' then 'transcript_semantic'
                when 'clip' then 'clip' when 'llm' then 'caption' end, 'hybrid') as metric,
              list_contains(ms, 'ss') as only_screenshot,
              list_contains(ms, '!ss') as no_screenshots,
              list_extract(list_filter(ms, lambda m: m in ('image', 'video', 'audio')), -1) as file_type
            from found_markers""",
    ),
    # --- lexical side
    "texts": (
        ("files",),
        """select id as item_id, 'description' as field, description as text from files where description <> ''
           union all select id, 'ocr', ocr_text from files where is_ocr_analyzed and ocr_text <> ''
           union all select id, 'transcript', transcript from files where is_transcript_analyzed and transcript <> ''
           union all select id, 'caption', llm_description from files where is_llm_description_analyzed and llm_description <> ''""",
    ),
    "occurrences": (
        ("texts",),
        f"""select item_id, field, v.variant, case v.variant when 'original' then t.token else {STEM.format('t.token')} end as token
            from (select item_id, field, unnest({TOKENS.format('text')}) as token from texts) t,
                 (select unnest(['original', 'lemma']) as variant) v""",
    ),
    "doc_stats": (
        ("texts",),
        f"""select field, variant, item_id, len({TOKENS.format('text')})::BIGINT as dl
            from texts, (select unnest(['original', 'lemma']) as variant)""",
    ),
    "postings": (
        ("occurrences", "doc_stats"),
        """select o.field, o.variant, o.token, o.item_id, count(*) as tf, any_value(d.dl) as dl
           from occurrences o join doc_stats d using (field, variant, item_id) group by all""",
    ),
    "corpus_stats": (
        ("doc_stats",),
        "select field, variant, count(*) as n_items, sum(dl)::BIGINT as total_len, avg(dl) as avgdl from doc_stats group by all",
    ),
    "token_stats": (("postings",), "select field, variant, token, count(*) as df from postings group by all"),
    "idfs": (
        ("token_stats", "corpus_stats"),
        "select field, variant, token, df, ln((n_items - df + 0.5e0) / (df + 0.5e0) + 1) as idf, avgdl from token_stats join corpus_stats using (field, variant)",
    ),
    "qtokens": (
        ("base_queries",),
        f"""select distinct query_id, 'original' as variant, unnest({TOKENS.format('query_text')}) as token from base_queries
            union select distinct query_id, 'lemma', {STEM.format('token')} from (select query_id, unnest({TOKENS.format('query_text')}) as token from base_queries)""",
    ),
    "variant_weights": ((), "select unnest(['original', 'lemma']) as variant, unnest([1.5e0, 1.0e0]) as weight"),
    "bm25": (
        ("postings", "idfs", "qtokens", "variant_weights"),
        """select query_id, field, item_id,
             round_even(sum(weight * idf * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) as score
           from postings join idfs using (field, variant, token) join qtokens using (variant, token) join variant_weights using (variant)
           group by all""",
    ),
    "exact_fields": (
        ("idfs", "qtokens", "variant_weights"),
        """select q.query_id, f.field,
             round_even(sum(weight * case when i.idf is null then 2.0e0
               else i.idf * 2.5e0 / (1 + 1.5e0 * (0.25e0 + 0.75e0 * (n.n + 50) / i.avgdl)) end), 9) as exact_match
           from qtokens q
           join (select query_id, variant, count(*) as n from qtokens group by all) n using (query_id, variant)
           cross join (select unnest(['description', 'ocr', 'transcript']) as field) f
           join variant_weights w using (variant)
           left join idfs i on i.field = f.field and i.variant = q.variant and i.token = q.token
           group by all""",
    ),
    # --- vector side
    "wanted": (
        ("files",),
        """select id as item_id, 'D' as kind, description as text from files where description <> ''
           union all select id, 'O', ocr_text from files where is_screenshot and is_ocr_analyzed and ocr_text <> ''
           union all select id, 'T', transcript from files where is_transcript_analyzed and transcript <> ''
           union all select id, 'L', llm_description from files where is_llm_description_analyzed and llm_description <> ''
           union all select id, 'C', null from files where ftype = 'image' and not embedding_generation_failed
           union all select id, 'V', null from files where ftype = 'video' and not embedding_generation_failed""",
    ),
    "text_cells": (
        ("wanted",),
        f"""select item_id, kind, {_slot} as dim, sum({_sign})::DOUBLE as v
            from (select item_id, kind, unnest({TOKENS.format('text')}) as token from wanted where text is not null) group by all""",
    ),
    "text_vectors": (("text_cells",), _embed("text_cells", "item_id, kind")),
    "pixel_vectors": (
        ("wanted",),
        """select vec_id as item_id, 'C' as kind, 0 as frame, embedding::DOUBLE[] as vec from embeddings join wanted w on w.item_id = vec_id and w.kind = 'C'
           union all
           select vec_id // 4, 'V', (vec_id % 4)::INT, embedding::DOUBLE[] from embeddings join wanted w on w.item_id = vec_id // 4 and w.kind = 'V'""",
    ),
    "store": (
        ("text_vectors", "pixel_vectors", "wanted"),
        """select t.item_id, t.kind, 0 as frame, t.vec, sha256(w.text) as text_sha from text_vectors t join wanted w using (item_id, kind)
           union all select item_id, kind, frame, vec, null from pixel_vectors""",
    ),
    "query_cells": (
        ("base_queries",),
        f"""select query_id, {_slot} as dim, sum({_sign})::DOUBLE as v
            from (select query_id, unnest({TOKENS.format('query_text')}) as token from base_queries) group by all""",
    ),
    "query_vectors": (("query_cells",), _embed("query_cells", "query_id")),
    "clip_query_vectors": (("base_queries",), "select vec_id as query_id, embedding::DOUBLE[] as vec from embeddings join base_queries on query_id = vec_id"),
    "sims": (
        ("store", "query_vectors", "clip_query_vectors"),
        """select q.query_id, s.kind, s.item_id, max(round_even(list_dot_product(s.vec, q.vec), 9) + 0.0) as score
           from store s join (select query_id, vec, false as pixel from query_vectors union all select query_id, vec, true from clip_query_vectors) q
             on q.pixel = (s.kind in ('C', 'V'))
           group by all""",
    ),
    # --- retrievers of the combined modes
    "lexical_list": (("bm25",), "select query_id, item_id, arg_max(score, score * w) as score from (select *, case field when 'description' then 0.5e0 when 'ocr' then 0.3e0 else 0.2e0 end as w from bm25 where field <> 'caption') group by all"),
    "semantic_list": (("sims",), "select query_id, item_id, arg_max(score, score * w) as score from (select *, case kind when 'D' then 0.5e0 when 'O' then 0.3e0 else 0.2e0 end as w from sims where kind in ('D', 'O', 'T')) group by all"),
    "clip_list": (("sims",), "select query_id, item_id, arg_max(score, score * 0.5e0) as score from sims where kind in ('C', 'V') group by all"),
    "exact_match": (("exact_fields",), "select query_id, max(exact_match) as exact_match from exact_fields group by query_id"),
    "ranked_lists": (
        ("lexical_list", "semantic_list", "clip_list"),
        """select *, row_number() over (partition by retriever, query_id order by score desc, item_id) as rank from (
             select 'lexical' as retriever, * from lexical_list union all select 'semantic', * from semantic_list union all select 'clip', * from clip_list)""",
    ),
    "confident": (
        ("ranked_lists", "exact_match"),
        """select r.*, case retriever
             when 'lexical' then least(score / exact_match, 1)
             when 'semantic' then case when score > 0.70e0 then 1 else least(1, greatest(0, 0.5e0 + (score - 0.55e0) / (0.70e0 - 0.55e0)) * 0.5e0) end
             else case when score > 0.32e0 then 1 else least(1, greatest(0, 0.5e0 + (score - 0.24e0) / (0.32e0 - 0.24e0)) * 0.5e0) end end as conf
           from ranked_lists r left join exact_match using (query_id)""",
    ),
    "hybrid": (("confident",), "select query_id, item_id, round_even(sum(conf / (60 + rank)), 9) as score from confident group by all"),
    "classic": (("ranked_lists",), "select query_id, item_id, round_even(sum(1e0 / (60 + rank)), 9) as score from ranked_lists group by all"),
    "caption_list": (
        ("bm25", "sims"),
        """select query_id, item_id, round_even(sum(w / (60 + rank)), 9) as score from (
             select query_id, item_id, 0.9e0 as w, row_number() over (partition by query_id order by score desc, item_id) as rank from bm25 where field = 'caption'
             union all
             select query_id, item_id, 1.0e0, row_number() over (partition by query_id order by score desc, item_id) from sims where kind = 'L')
           group by all""",
    ),
    # --- logs
    "edits": (
        (),
        """select seq, item_id, op, case when op = 'screenshot' then case when value > 10 then 'true' else 'false' end else '  ' || props || chr(10) end as value
           from (select event_id as seq, user_id as item_id, value, props,
                   case event_type when 'click' then 'description' when 'view' then 'transcript' when 'error' then 'ocr' when 'signup' then 'screenshot'
                     else case event_id % 4 when 0 then 'description' when 1 then 'transcript' when 2 then 'ocr' else 'screenshot' end end as op
                 from events)""",
    ),
    "changes": (
        (),
        """select event_id as seq, 1704067200000000 + event_id * 20000 as at_us,
             case event_type when 'signup' then 'created' when 'view' then 'opened' when 'click' then 'closed' when 'purchase' then 'deleted' else 'moved' end as op,
             '/media/f' || user_id as path,
             case when event_type = 'error' then case when value > 30 then '/other' else '/media' end || '/f' || (user_id + 1) end as dest_path
           from events""",
    ),
    "frames": ((), "select user_id as utt, row_number() over (partition by user_id order by ts) - 1 as t, event_type as token, value / 1000 as prob from events"),
    "boxes": (
        (),
        """select item_id, pos, text, ((pos * 7) % 10) / 10.0::DOUBLE as prob from (
             select doc_id as item_id, unnest(range(len(lines))) as pos, unnest(lines) as text from (select doc_id, string_split(text, chr(10)) as lines from documents))""",
    ),
    "word_counts": ((), f"select lang, word, count(*) as n from (select lang, unnest({TOKENS.format('text')}) as word from documents) group by all"),
    "dictionary": (
        ("word_counts",),
        "select lang, word, n::DOUBLE / (sum(n) over (partition by lang))::DOUBLE as freq from word_counts where n >= 5",
    ),
    "query_words": (
        ("word_counts",),
        f"select 'en' as lang, word from (select unnest({TOKENS.format('text')}) as word from benchmark) union select lang, word from word_counts where n < 5",
    ),
    "pairs": (
        (),
        """select a.conv_id * 1000 + a.turn as id, a.conv_id, a.text as ref, b.text as hyp
           from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1""",
    ),
}
_MATERIALIZED = {"files", "postings", "bm25", "text_cells", "text_vectors", "store", "sims", "query_vectors", "ranked_lists", "word_counts", "dictionary", "frames"}


def sql(body: str, *needs: str) -> str:
    """``body`` after the common table expressions it needs, directly or not."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dependency in CTES[name][0]:
                add(dependency)
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    parts = [f"{n} as {'materialized ' if n in _MATERIALIZED else ''}({CTES[n][1]})" for n in order]
    # a body that starts with a comma brings common table expressions of its own
    return "with recursive " + ",\n".join(parts) + "\n" + body
