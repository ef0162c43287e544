"""Change feed: normalization, create-ready detection as a stream, incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.operators import catalog
from hayloft.session import work_dir
from hayloft.streaming import feed
from hayloft.streaming.maintain import LiveTables
from workload import views as v
from workload.registry import query

_IGNORED = ("f7", "f8")
_NORMAL = """, parts as (
    select seq, at_us, op, path, false as ready from changes where op <> 'moved' and path not in ('/media/f7', '/media/f8')
    union all select seq, at_us, 'deleted', path, true from changes where op = 'moved' and path not in ('/media/f7', '/media/f8')
    union all select seq, at_us, 'created', dest_path, true from changes
      where op = 'moved' and split_part(dest_path, '/', 3) not in ('f7', 'f8') and (path in ('/media/f7', '/media/f8') or dest_path like '/media/%'))"""

# The detector as a walk over each path's events; every walk keeps what is known about its path.
_WALK = """, ordered as (select *, row_number() over (partition by path order by at_us, seq, op <> 'deleted') as n from parts),
  walk as (
    select path, 0::BIGINT as n, null::BIGINT as pend, null::BIGINT as pseq, false as opened, false as closed,
      null::BIGINT as out1, null::BIGINT as out1_at, null::VARCHAR as out2_op, null::BIGINT as out2, null::BIGINT as out2_at
    from (select distinct path from parts)
    union all
    select path, n,
      case when op = 'deleted' or (op = 'created' and ready) or (op = 'created' and was_open and was_closed) or op = 'closed' then null
           when op = 'created' then coalesce(p, at_us) else p end,
      case when op = 'deleted' or (op = 'created' and ready) or (op = 'created' and was_open and was_closed) or op = 'closed' then null
           when op = 'created' then coalesce(ps, seq) else ps end,
      case when op = 'deleted' or (op = 'created' and (ready or (was_open and was_closed))) or (op = 'closed' and p is not null) then false
           when op = 'opened' then true else was_open end,
      case when op = 'deleted' or (op = 'created' and (ready or (was_open and was_closed))) then false
           when op = 'closed' and p is null then true else was_closed end,
      case when expired then old_seq end, case when expired then old_pend + 1000000 end,
      case when op = 'deleted' then 'deleted'
           when (op = 'created' and (ready or (was_open and was_closed))) or (op = 'closed' and p is not null) then 'created' end,
      case when op = 'closed' then ps else seq end, at_us
    from (select o.*, w.opened as was_open, w.closed as was_closed, w.pend as old_pend, w.pseq as old_seq,
            (w.pend is not null and not w.opened and o.at_us >= w.pend + 1000000) as expired,
            case when w.pend is not null and not w.opened and o.at_us >= w.pend + 1000000 then null else w.pend end as p,
            case when w.pend is not null and not w.opened and o.at_us >= w.pend + 1000000 then null else w.pseq end as ps
          from walk w join ordered o on o.path = w.path and o.n = w.n + 1)),
  last as (select path, arg_max(struct_pack(p := pend, s := pseq, o := opened), n) as state from walk group by path),
  released as (
    select path, 'created' as op, out1 as seq, out1_at as at_us from walk where out1 is not null
    union all select path, out2_op, out2, out2_at from walk where out2_op is not null
    union all select path, 'created', state.s, state.p + 1000000 from last where state.p is not null and not state.o)"""


def _normalized(spark, sf):
    return feed.normalize(v.changes(spark, sf), _IGNORED, "/media")


@query("st2_normalized_changes", v.sql(_NORMAL + " select seq, op, path, ready from parts", "changes"))
def normalized_changes(spark, sf):
    return _normalized(spark, sf).select("seq", "op", "path", "ready")


@query("st3_ready_table", v.sql(_NORMAL + _WALK + " select path, op, seq, at_us as ready_us from released", "changes"))
def ready_table(spark, sf):
    return feed.ready_table(_normalized(spark, sf)).select("path", "op", "seq", F.unix_micros("ready_at").alias("ready_us"))


def _logged(spark, sf, pieces: int = 4):
    """The change feed as a log of Parquet files, oldest first, closed by a late mark that moves the watermark."""
    log = work_dir(spark, "change-log")
    changes = v.changes(spark, sf).select(*S.CHANGES.names)
    changes.repartitionByRange(pieces, "seq").sortWithinPartitions("seq").write.parquet(log)
    end = changes.agg(F.max("seq").alias("seq"), F.max("ts").alias("ts")).select(
        (F.col("seq") + 1).alias("seq"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("ts"),
        F.lit("opened").alias("op"),
        F.lit("/media/end").alias("path"),
        F.lit(None).cast("string").alias("dest_path"),
        F.lit(False).alias("is_directory"),
    )
    end.write.mode("append").parquet(log)
    return log


@query("st1_change_stream", v.sql("select seq, op, path, dest_path from changes", "changes"))
def change_stream(spark, sf):
    target, state = work_dir(spark, "changes"), work_dir(spark, "state")
    feed.run_to_end(feed.read_changes(spark, _logged(spark, sf)), target, state)
    return spark.read.parquet(target).where("path <> '/media/end'").select("seq", "op", "path", "dest_path")


@query("st3_ready_stream", v.sql(_NORMAL + _WALK + " select path, op, seq, at_us as ready_us from released", "changes"))
def ready_stream(spark, sf):
    """The detector as a stream; must release what the batch twin releases."""
    target, state = work_dir(spark, "released"), work_dir(spark, "state")
    changes = feed.read_changes(spark, _logged(spark, sf))
    feed.run_to_end(feed.ready_stream(feed.normalize(changes, _IGNORED, "/media")), target, state)
    return spark.read.parquet(target).select("path", "op", "seq", F.unix_micros("ready_at").alias("ready_us"))


@query("st4_last_operation", v.sql(_NORMAL + " select path, arg_max(op, seq * 2 + (op = 'created')::INT) as op from parts where op in ('created', 'deleted') group by path", "changes"))
def last_operation(spark, sf):
    """Final fate of every path: a delete that follows a create wins, whatever waits in between."""
    steps = _normalized(spark, sf).where("op in ('created', 'deleted')")
    placed = steps.withColumn("place", F.col("seq") * 2 + (F.col("op") == "created").cast("int"))
    return catalog.latest_per_key(placed, ["path"], "place").select("path", "op")


def _described(spark, sf):
    """Catalog rows of files named by the feed: f<n> is the document of that number."""
    files = v.files(spark, sf)
    return files.withColumn("name", F.concat(F.lit("f"), F.col("id").cast("string")))


@query("st5_replayed_after_load", v.sql(_NORMAL + " select path, op, count(*) as n from parts group by all", "changes"))
def replayed_after_load(spark, sf):
    """Events logged before the load finished are replayed from the checkpoint: two runs, each event once."""
    target, state = work_dir(spark, "replayed"), work_dir(spark, "state")
    log = work_dir(spark, "log")
    changes = v.changes(spark, sf).select(*S.CHANGES.names)
    half = changes.agg((F.max("seq") / 2).alias("half"))
    early = changes.join(F.broadcast(half), F.col("seq") <= F.col("half")).drop("half")
    late = changes.join(F.broadcast(half), F.col("seq") > F.col("half")).drop("half")
    for part in (early, late):
        part.write.mode("append").parquet(log)
        stream = feed.normalize(feed.read_changes(spark, log), _IGNORED, "/media")
        feed.run_to_end(stream.select("path", "op"), target, state)
    return spark.read.parquet(target).groupBy("path", "op").agg(F.count("*").alias("n"))


def _live(spark, sf):
    """Catalog of the files the feed never deletes, then the whole feed applied in micro-batches."""
    described = _described(spark, sf)
    english = described.where("lang = 'en'")
    live = LiveTables(spark, work_dir(spark, "live"), english.drop("lang"))

    def describe(names):
        return described.drop("lang").join(names, "name", "left_semi")

    stream = feed.ready_stream(feed.normalize(feed.read_changes(spark, _logged(spark, sf, 2)), _IGNORED, "/media"))
    feed.run_batches(stream, lambda batch, batch_id: live.apply(batch, batch_id, describe), work_dir(spark, "state"))
    return live


_FINAL = """, fate as (select path, arg_max(op, at_us * 2 + (op = 'created')::INT) as op from released group by path),
  live as (select f.* from files f left join fate t on t.path = '/media/f' || f.id where coalesce(t.op = 'created', f.lang = 'en'))"""


@query("st6_live_catalog", v.sql(_NORMAL + _WALK + _FINAL + " select id, 'f' || id as name, ftype from live", "changes", "files"))
def live_catalog(spark, sf):
    return _live(spark, sf).files().select("id", "name", "ftype")


@query(
    "st6_live_index",
    v.sql(
        _NORMAL + _WALK + _FINAL
        + f""", said as (select id as item_id, 'description' as field, description as text from live where description <> ''
             union all select id, 'ocr', ocr_text from live where is_ocr_analyzed and ocr_text <> ''
             union all select id, 'transcript', transcript from live where is_transcript_analyzed and transcript <> ''
             union all select id, 'caption', llm_description from live where is_llm_description_analyzed and llm_description <> ''),
           toks as (select item_id, field, unnest({v.TOKENS.format('text')}) as token from said)
           select field, variant, count(*) as n_postings, sum(tf)::BIGINT as n_tokens, count(distinct token) as n_words from (
             select field, variant, token, item_id, count(*) as tf from (
               select field, 'original' as variant, token, item_id from toks union all select field, 'lemma', {v.STEM.format('token')}, item_id from toks) group by all)
           group by all""",
        "changes", "files",
    ),
)
def live_index(spark, sf):
    postings = _live(spark, sf).index().postings
    return postings.groupBy("field", "variant").agg(
        F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"), F.count_distinct("token").alias("n_words")
    )


@query(
    "st6_live_vectors",
    v.sql(
        _NORMAL + _WALK + _FINAL + " select s.item_id, s.kind, s.text_sha from store s where s.kind not in ('C', 'V') and s.item_id in (select id from live)",
        "changes", "store",
    ),
)
def live_vectors(spark, sf):
    return _live(spark, sf).text_vectors().select("item_id", "kind", "text_sha")


@query(
    "st7_full_reconcile",
    v.sql(
        """select f.name, case when f.lang = 'en' and f.ftype <> 'audio' then 'kept' when f.lang = 'en' then 'new' else 'deleted' end as status
           from files f where f.lang = 'en' or f.ftype <> 'audio'""",
        "files",
    ),
)
def full_reconcile(spark, sf):
    """Daily repair: the stored catalog (no audio) against what lies in the directory (English files)."""
    files = v.files(spark, sf)
    return catalog.reconcile_by_digest(files.where("ftype <> 'audio'"), files.where("lang = 'en'"))
