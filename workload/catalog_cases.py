"""Scans, catalog filters, reconciliation, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.functions import text
from hayloft.operators import catalog, vectors
from hayloft.sources import files as file_source
from hayloft.sources import tables
from workload import views as v
from workload.registry import query

_FACTS = ("id", "name", "ftype")


def _stored(spark, sf):
    """Catalog before a scan: it knows nothing of the documents without a quality label."""
    labels = v.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return v.files(spark, sf).join(labels, "id", "left_semi")


def _scan(spark, sf):
    """Names found on disk: files of English and French documents, typed by their extension."""
    named = v.files(spark, sf).where("lang in ('en', 'fr')").select("name", "added_at")
    return file_source.classify(named)


_STORED_SQL = "select f.* from files f where id in (select doc_id from labels)"
_SCAN_SQL = "select name, added_at, ftype from files where lang in ('en', 'fr')"


@query(
    "s2_media_types",
    r"""select url as name, case
          when regexp_matches(lower(url), '\.(jpg|jpeg|jpe|png|gif|bmp|tif|tiff|webp|ico|pbm|pgm|ppm|heic|avif)$') then 'image'
          when regexp_matches(lower(url), '\.(mp4|m4v|mov|qt|mkv|webm|avi|mpg|mpeg|mpe|ogv|3gp|flv|wmv)$') then 'video'
          when regexp_matches(lower(url), '\.(mp3|mp2|m4a|wav|flac|ogg|oga|opus|aac|aif|aiff|aifc|au|snd|wma)$') then 'audio'
          else 'other' end as ftype from pages
        union all """
    + v.sql("select name, ftype from files", "files").replace("with recursive", "(with recursive", 1)
    + ")",
)
def media_types(spark, sf):
    names = v.files(spark, sf).select("name").unionByName(v.table(spark, sf, "pages").select(F.col("url").alias("name")))
    return file_source.classify(names).select("name", "ftype")


@query(
    "s3_reconcile",
    v.sql(
        f"""select coalesce(s.name, a.name) as name,
              case when s.name is null then 'new' when a.name is null then 'deleted' else 'kept' end as status
            from ({_STORED_SQL}) s full join ({_SCAN_SQL}) a on a.name = s.name""",
        "files",
    ),
)
def reconcile(spark, sf):
    return catalog.reconcile(_stored(spark, sf), _scan(spark, sf))


@query(
    "s3_apply_scan",
    v.sql(
        f"""select name, ftype, description, is_screenshot from ({_STORED_SQL}) where name in (select name from ({_SCAN_SQL}))
            union all select name, ftype, '', false from ({_SCAN_SQL}) where name not in (select name from ({_STORED_SQL}))""",
        "files",
    ),
)
def apply_scan(spark, sf):
    after = catalog.apply_scan(_stored(spark, sf), _scan(spark, sf), next_id=1_000_000)
    return after.select("name", "ftype", "description", "is_screenshot")


@query(
    "s4_refresh_types",
    v.sql(
        f"""select f.id, f.name, f.ftype as old_type, coalesce(s.ftype, 'other') as ftype
            from files f left join ({_SCAN_SQL}) s on s.name = f.name where f.ftype is distinct from coalesce(s.ftype, 'other')""",
        "files",
    ),
)
def refresh_types(spark, sf):
    return catalog.changed_types(v.files(spark, sf), _scan(spark, sf))


@query(
    "s6_register_directories",
    """select name, fs_path from (select name, min(fs_path) as fs_path from (
         select url as fs_path, split_part(url, '/', 3) as name from pages) p
       where name not in (select name from (select distinct source as name from documents))
         and fs_path not in (select '/media/' || source from documents)
       group by name) n qualify row_number() over (partition by fs_path order by name) = 1
       union all select distinct source, '/media/' || source from documents""",
)
def register_directories(spark, sf):
    sources = v.table(spark, sf, "documents").select(F.col("source").alias("name"), F.concat(F.lit("/media/"), "source").alias("fs_path"))
    wanted = v.table(spark, sf, "pages").select(F.split("url", "/")[2].alias("name"), F.col("url").alias("fs_path"))
    return tables.register(sources.distinct(), wanted)


@query("s7_description_dump", v.sql("select name, description from files", "files"))
def description_dump(spark, sf):
    from hayloft.session import work_dir

    path = work_dir(spark, "descriptions")
    tables.dump_descriptions(v.files(spark, sf), path)
    return tables.read_descriptions(spark, path)


@query(
    "s8_restore_descriptions",
    v.sql(
        """select f.id, f.name, coalesce(d.description, f.description) as description
           from files f left join (select name, transcript as description from files where is_transcript_fixed) d on d.name = f.name""",
        "files",
    ),
)
def restore_descriptions(spark, sf):
    files = v.files(spark, sf)
    dump = files.where("is_transcript_fixed").select("name", F.col("transcript").alias("description"))
    return catalog.restore_descriptions(files, dump).select("id", "name", "description")


@query("s9_store_vectors", v.sql("select item_id, kind, frame, text_sha, len(vec)::INT as dims from store", "store"))
def store_vectors(spark, sf):
    """Vectors as one column per kind, written to long rows."""
    wide = (
        v.store(spark, sf).groupBy("item_id")
        .agg(
            *[F.max(F.when(F.col("kind") == k, F.col("vec"))).alias(f"vec_{k}") for k in "DOTLC"],
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("kind") == "V", F.struct("frame", "vec")))), lambda f: f["vec"]
            ).alias("vec_V"),
        )
    )
    texts = vectors.expected_texts(v.files(spark, sf)).groupBy("item_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(f"text_{k}") for k in S.KIND_TEXT_FIELD]
    )
    long = vectors.to_store(
        wide.join(texts, "item_id", "left"), {k: f"text_{k}" for k in S.KIND_TEXT_FIELD}, {k: f"vec_{k}" for k in "DOTLCV"}
    )
    return long.select("item_id", "kind", "frame", "text_sha", F.size("vec").alias("dims"))


def _edited(spark, sf):
    """Catalog in which every French text has changed since its vectors were made."""
    files = v.files(spark, sf)
    changed = lambda c: F.when(F.col("lang") == "fr", F.concat(c, F.lit(" edited"))).otherwise(F.col(c)).alias(c)
    kept = [c for c in files.columns if c not in ("transcript", "llm_description")]
    return files.select(*kept, changed("transcript"), changed("llm_description"))


_EDITED = """edited as (select id, description, is_screenshot, is_transcript_analyzed, is_llm_description_analyzed, is_ocr_analyzed, ocr_text,
  case when lang = 'fr' then transcript || ' edited' else transcript end as transcript,
  case when lang = 'fr' then llm_description || ' edited' else llm_description end as llm_description from files),
expected as (
  select id as item_id, 'D' as kind, description as text from edited
  union all select id, 'O', case when is_screenshot then coalesce(ocr_text, '') else '' end from edited
  union all select id, 'T', case when is_transcript_analyzed then coalesce(transcript, '') else '' end from edited
  union all select id, 'L', case when is_llm_description_analyzed then coalesce(llm_description, '') else '' end from edited)"""


@query(
    "s10_consistent_vectors",
    v.sql(
        f""", {_EDITED} select s.item_id, s.kind, s.frame from store s left join expected e using (item_id, kind)
            where e.text is null or s.text_sha = sha256(e.text)""",
        "store",
    ),
)
def consistent_vectors(spark, sf):
    return vectors.consistent(v.store(spark, sf), vectors.expected_texts(_edited(spark, sf))).select("item_id", "kind", "frame")


@query(
    "s11_vectors_with_texts",
    v.sql(f", {_EDITED} select s.item_id, s.kind, s.frame, e.text from store s left join expected e using (item_id, kind)", "store"),
)
def vectors_with_texts(spark, sf):
    return vectors.with_texts(v.store(spark, sf), vectors.expected_texts(_edited(spark, sf))).select("item_id", "kind", "frame", "text")


@query("s12_embedded_items", v.sql("select distinct item_id from store", "store"))
def embedded_items(spark, sf):
    return vectors.embedded_items(v.store(spark, sf))


@query(
    "s13_orphans",
    v.sql(f"select distinct f.name from store s join files f on f.id = s.item_id where f.name not in (select name from ({_SCAN_SQL}))", "store"),
)
def orphans(spark, sf):
    names = v.store(spark, sf).join(v.files(spark, sf).select(F.col("id").alias("item_id"), "name"), "item_id")
    return catalog.orphans(names, _scan(spark, sf))


# --- filters --------------------------------------------------------------------------------------


@query("p1_files_by_id", v.sql("select id, name, ftype from files where id in (select doc_id from labels where toxic = 1)", "files"))
def files_by_id(spark, sf):
    toxic = v.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return catalog.having(v.files(spark, sf), toxic).select(*_FACTS)


@query("p1_file_by_name", v.sql("select id, name, ftype from files where name = 'src7_7.jpg'", "files"))
def file_by_name(spark, sf):
    return catalog.by_name(v.files(spark, sf), "src7_7.jpg").select(*_FACTS)


@query("p2_files_of_types", v.sql("select id, name, ftype from files where ftype in ('image', 'audio')", "files"))
def files_of_types(spark, sf):
    return catalog.of_type(v.files(spark, sf), "image", "audio").select(*_FACTS)


@query("p3_pending_ocr", v.sql("select id, name, ftype from files where ftype = 'image' and not is_ocr_analyzed", "files"))
def pending_ocr(spark, sf):
    return catalog.pending_ocr(v.files(spark, sf)).select(*_FACTS)


@query("p4_pending_transcripts", v.sql("select id, name, ftype from files where ftype <> 'image' and not is_transcript_analyzed", "files"))
def pending_transcripts(spark, sf):
    return catalog.pending_transcripts(v.files(spark, sf)).select(*_FACTS)


@query("p5_retranscribable", v.sql("select id, name, ftype from files where ftype <> 'image' and not is_transcript_fixed", "files"))
def retranscribable(spark, sf):
    return catalog.retranscribable(v.files(spark, sf)).select(*_FACTS)


@query("p6_pending_captions", v.sql("select id, name, ftype from files where ftype <> 'audio' and not is_llm_description_analyzed", "files"))
def pending_captions(spark, sf):
    return catalog.pending_captions(v.files(spark, sf)).select(*_FACTS)


@query("p6_all_captionable", v.sql("select id, name, ftype from files where ftype <> 'audio'", "files"))
def all_captionable(spark, sf):
    return catalog.pending_captions(v.files(spark, sf), regenerate_all=True).select(*_FACTS)


@query(
    "p8_api_rows",
    v.sql(
        """select id, name, description, strftime(added_at, '%Y-%m-%d %H:%M:%S') as added_at, ftype as file_type, is_screenshot, ocr_text,
             case when is_transcript_analyzed then transcript end as transcript,
             case when transcript is not null then is_transcript_fixed end as is_transcript_fixed,
             case when is_llm_description_analyzed then llm_description end as llm_description from files""",
        "files",
    ),
)
def api_rows(spark, sf):
    return catalog.api_rows(v.files(spark, sf))


@query("p10_embedding_eligibility", v.sql("select item_id, kind, text from wanted", "wanted"))
def embedding_eligibility(spark, sf):
    return vectors.wanted_embeddings(v.files(spark, sf))


@query(
    "p11_embedding_work_list",
    v.sql(
        f""", {_EDITED},
            want as (select item_id, kind, sha256(text) as sha from expected e where text <> '' and not (kind = 'O' and (select not is_ocr_analyzed from edited where id = e.item_id))
              union all select item_id, kind, null from wanted where kind in ('C', 'V')),
            have as (select item_id, kind, max(text_sha) as sha from store where item_id in (select doc_id from labels) group by all)
            select coalesce(w.item_id, h.item_id) as item_id, coalesce(w.kind, h.kind) as kind,
              case when h.kind is null then 'create' when w.kind is null then 'drop'
                when w.sha is null or w.sha = h.sha then 'keep' else 'stale' end as action
            from want w full join have h on h.item_id = w.item_id and h.kind = w.kind""",
        "store",
    ),
)
def embedding_work_list(spark, sf):
    labelled = v.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    stored = v.store(spark, sf).join(labelled, "item_id", "left_semi")
    return vectors.work_list(_edited(spark, sf), stored)


# --- joins, order, pages --------------------------------------------------------------------------


@query(
    "j2_files_by_ids",
    v.sql("select id, name from files where id in (select item_id from benchmark)", "files"),
)
def files_by_ids(spark, sf):
    wanted = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return catalog.having(v.files(spark, sf), wanted).select("id", "name")


@query("a7_file_count", v.sql("select count(*) as n from files", "files"))
def file_count(spark, sf):
    return v.files(spark, sf).agg(F.count("*").alias("n"))


@query("a8_file_positions", v.sql("select id, row_number() over (order by added_at desc, id desc) - 1 as position from files", "files"))
def file_positions(spark, sf):
    return catalog.default_positions(v.files(spark, sf))


@query(
    "a8_position_of_file",
    v.sql(
        """select count(*) as position from files f, (select added_at, id from files where id = 100) me
           where f.added_at > me.added_at or (f.added_at = me.added_at and f.id > me.id)""",
        "files",
    ),
)
def position_of_file(spark, sf):
    return catalog.position_of(v.files(spark, sf), 100)


@query("o1_default_order", v.sql("select id, name from files order by added_at desc, id desc", "files"))
def default_order(spark, sf):
    return catalog.default_order(v.files(spark, sf)).select("id", "name")


@query("o2_catalog_page", v.sql("select id, name from files order by added_at desc, id desc limit 50 offset 25", "files"))
def catalog_page(spark, sf):
    return catalog.page(v.files(spark, sf), 25, 50).select("id", "name")


@query("u2_new_names", v.sql(f"select name from ({_SCAN_SQL}) where name not in (select name from ({_STORED_SQL}))", "files"))
def new_names(spark, sf):
    return catalog.new_names(_stored(spark, sf), _scan(spark, sf))


@query("u2_deleted_names", v.sql(f"select name from ({_STORED_SQL}) where name not in (select name from ({_SCAN_SQL}))", "files"))
def deleted_names(spark, sf):
    return catalog.deleted_names(_stored(spark, sf), _scan(spark, sf))


# --- scalar functions -----------------------------------------------------------------------------


@query("x1_tokens", f"select doc_id, array_to_string({v.TOKENS.format('text')}, ' ') as tokens from documents")
def tokens(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query(
    "x2_lemma_stream",
    rf"""with words as (select doc_id, lang, pos, lower(form) as form from (
            select doc_id, lang, unnest(range(len(ws))) as pos, unnest(ws) as form from (
              select doc_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as ws from documents))),
          lemmas as (select distinct lang, form, {v.STEM.format('form')} as lemma from words)
          select doc_id, pos, coalesce(lemma, form) as lemma from words left join lemmas using (lang, form)
          where coalesce(lemma, form) not in ('.', ',', '?', '!', '-', '_', '/')""",
)
def lemma_stream(spark, sf):
    from hayloft.operators.lexical import lemmatize_by_table

    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang", "text")
    forms = docs.select("lang", F.explode(text.split_lemmas(F.lower("text"))).alias("form")).distinct()
    lemma_table = forms.withColumn("lemma", F.regexp_replace("form", r"^(.{3,})s$", "$1"))
    return lemmatize_by_table(docs, lemma_table).select(F.col("item_id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "lemma")


@query(
    "x3_lemma_text",
    rf"select doc_id, array_to_string(list_transform({v.TOKENS.format('text')}, lambda t: {v.STEM.format('t')}), ' ') as lemmas, len({v.TOKENS.format('text')})::INT as n from documents",
)
def lemma_text(spark, sf):
    joined = v.table(spark, sf, "documents").select("doc_id", text.join_lemmas(text.plain_stem(text.tokens(F.col("text")))).alias("lemmas"))
    return joined.select("doc_id", "lemmas", F.size(text.split_lemmas(F.col("lemmas"))).alias("n"))


@query("x4_query_tokens", v.sql("select query_id, variant, token from qtokens", "qtokens"))
def query_tokens(spark, sf):
    from hayloft.operators import lexical

    return lexical.query_tokens(v.base_queries(spark, sf))


@query("x6_text_hashes", "select doc_id, sha256(text) as sha from documents")
def text_hashes(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", text.text_hash(F.col("text")).alias("sha"))


@query("x7_clean_texts", r"select conv_id, turn, regexp_replace('  ' || text || chr(10), '^\s+|\s+$', '', 'g') as clean, regexp_replace(text, '^\s+|\s+$', '', 'g') <> text as changed from conversations")
def clean_texts(spark, sf):
    turns = v.table(spark, sf, "conversations")
    padded = F.concat(F.lit("  "), "text", F.lit("\n"))
    return turns.select(
        "conv_id", "turn", text.strip_blank(padded).alias("clean"), (~text.strip_blank(F.col("text")).eqNullSafe(F.col("text"))).alias("changed")
    )


@query(
    "x10_media_times",
    v.sql(
        "select id, printf('%02d:%02d:%05.2f', floor(duration / 3600)::BIGINT, floor((duration % 3600) / 60)::BIGINT, duration % 60) as time from files",
        "files",
    ),
)
def media_times(spark, sf):
    return v.files(spark, sf).select("id", text.media_time(F.col("duration")).alias("time"))


@query(
    "x11_stream_kinds",
    r"""select page_id, regexp_matches(lower(report), 'stream.+?video') as film, regexp_matches(lower(report), 'div.+?p') as marked,
          case when regexp_matches(lower(report), 'stream.+?video') then 'video' when regexp_matches(lower(report), 'stream.+?audio') then 'audio' else 'other' end as kind
        from (select page_id, case page_id % 4 when 0 then 'Stream #0:0: Video: ' || url when 1 then 'stream #0:1(und): AUDIO: ' || url
                when 2 then 'Video before Stream' else '' end || ' ' || html as report from pages)""",
)
def stream_kinds(spark, sf):
    """The html of every page, after a line such as media tools print."""
    sort = F.col("page_id") % 4
    report = (
        F.when(sort == 0, F.concat(F.lit("Stream #0:0: Video: "), "url"))
        .when(sort == 1, F.concat(F.lit("stream #0:1(und): AUDIO: "), "url"))
        .when(sort == 2, "Video before Stream")
        .otherwise("")
    )
    report = F.concat(report, F.lit(" "), "html")
    return v.table(spark, sf, "pages").select(
        "page_id", text.has_stream(report, "video").alias("film"), report.rlike("(?i)div.+?p").alias("marked"), text.stream_kind(report).alias("kind")
    )


@query(
    "x12_real_words",
    v.sql(
        r"""select lang, word, n * 1e0 / sum(n) over (partition by lang) > 1e-6 and regexp_matches(word, '^\p{L}{2,}$') as is_real from word_counts""",
        "word_counts",
    ),
)
def real_words(spark, sf):
    counts = v.word_counts(spark, sf)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    freq = F.col("n") / F.col("total")
    return counts.join(totals, "lang").select(
        "lang", "word", ((freq > S.MIN_WORD_FREQUENCY) & text.is_word_shaped(F.col("word"))).alias("is_real")
    )
