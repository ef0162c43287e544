"""Media planning, OCR and transcript assembly, frame tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from hayloft.operators import media
from workload import views as v
from workload.registry import query


def _timed(spark, sf, *types):
    return v.files(spark, sf).where(F.col("ftype").isin(*types)).select(F.col("id").alias("item_id"), "duration")


@query(
    "d1_frame_plan",
    v.sql(
        """select id as item_id, i::INT as frame, round(duration * (2 * i + 1) / (2 * n), 6) as offset_s
           from (select id, duration, n, unnest(range(n)) as i
                 from (select id, duration, greatest(floor(duration / 3)::BIGINT, 1) as n from files where ftype = 'video'))""",
        "files",
    ),
)
def frame_plan(spark, sf):
    return media.frame_plan(_timed(spark, sf, "video")).withColumn("offset_s", F.round("offset_s", 6))


@query(
    "d2_segment_plan",
    v.sql(
        """select id as item_id, i::INT as part, i * 29.0e0 as start_s, least(duration, (i + 1) * 29.0e0) as end_s
           from (select id, duration, unnest(range(floor(duration)::BIGINT // 29 + 1)) as i from files where ftype <> 'image')
           where i = 0 or duration - i * 29 >= 0.5e0""",
        "files",
    ),
)
def segment_plan(spark, sf):
    return media.segment_plan(_timed(spark, sf, "audio", "video"))


@query(
    "d3_caption_choice",
    """with turns as (select conv_id as item_id, turn, text from conversations),
         two as (select item_id, max(case when turn = 0 then text end) as c0, max(case when turn = 1 then text end) as c1 from turns group by all)
       select item_id, case when length(c0) < 70 and c1 is not null and length(c1) > length(c0) then c1 else c0 end as caption from two""",
)
def caption_choice(spark, sf):
    """The first two turns of a conversation as first and second caption attempt."""
    attempts = v.table(spark, sf, "conversations").where("turn <= 1").select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("attempt"), F.col("text").alias("caption")
    )
    return media.captions_from_attempts(attempts)


@query(
    "d4_thumbnail_plan",
    v.sql(
        """select id as item_id, 0 as attempt, 1.0e0 as offset_s from files where ftype = 'video'
           union all select id, 1, duration / 2 from files where ftype = 'video'""",
        "files",
    ),
)
def thumbnail_plan(spark, sf):
    return media.thumbnail_plan(_timed(spark, sf, "video"))


def _frequencies(spark, sf):
    counts = v.word_counts(spark, sf)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("freq"))


@query(
    "a11_screenshot_flags",
    v.sql(
        r""", freq as (select lang, word from (select lang, word, n::DOUBLE / sum(n) over (partition by lang) as f from word_counts) where f > 1e-6),
              said as (select item_id, unnest(regexp_split_to_array(lower(text), '\s+')) as word from boxes where prob >= 0.1e0),
              known as (select item_id, lang, count(*) as n from said join freq using (word) where regexp_matches(word, '^\p{L}{2,}$') group by all)
            select b.item_id, coalesce(max(n) >= 3, false) as is_screenshot from (select distinct item_id from boxes) b left join known using (item_id) group by b.item_id""",
        "boxes", "word_counts",
    ),
)
def screenshot_flags(spark, sf):
    return media.screenshot_flags(v.boxes(spark, sf), _frequencies(spark, sf), min_words=3)


@query(
    "a12_ocr_text",
    v.sql(r"select item_id, regexp_replace(string_agg(text, ' ' order by pos), '^\s+|\s+$', '', 'g') as ocr_text from boxes where prob >= 0.1e0 group by item_id", "boxes"),
)
def ocr_text(spark, sf):
    return media.ocr_text(v.boxes(spark, sf))


@query(
    "a13_transcripts",
    r"""with segments as (select conv_id as item_id, turn as part, case when role <> 'system' and length(text) > 40 then text end as text from conversations),
          failed as (select item_id, min(case when text is null then part end) as failed_at from segments group by all)
        select s.item_id, case when any_value(failed_at) is null or any_value(failed_at) > 0 then
            regexp_replace(coalesce(string_agg(text, ' ' order by part) filter (where failed_at is null or part < failed_at), ''), '^\s+|\s+$', '', 'g') end as transcript
        from segments s join failed using (item_id) group by s.item_id""",
)
def transcripts(spark, sf):
    """Conversation turns as segments; system turns and very short ones stand for failures."""
    text = F.when((F.col("role") != "system") & (F.length("text") > 40), F.col("text"))
    segments = v.table(spark, sf, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("part"), text.alias("text"))
    return media.transcripts(segments)


# one row per frame run, found by comparing each frame with the one before
_RUNS = """, marked as (select *, token is distinct from lag(token) over (partition by utt order by t) as fresh from frames),
  grouped as (select *, sum(fresh::INT) over (partition by utt order by t) as run from marked),
  runs as (select utt, run, token, min(t) as start_t, max(t) as last_t from grouped where token <> 'error' group by all),
  timed as (select utt, token, start_t, case when start_t = last_t then start_t + 1 else last_t end as end_t from runs),
  collapsed as (select r.utt, row_number() over (partition by r.utt order by r.start_t) as pos, r.token, r.start_t, r.end_t,
      (select avg(f.prob) from frames f where f.utt = r.utt and f.t >= r.start_t and f.t < r.end_t) as mean_prob from timed r)"""


@query(
    "w2_collapsed_frames",
    v.sql(_RUNS + " select utt, pos, token, start_t, end_t, round(mean_prob + 1e-12, 9) as mean_prob from collapsed", "frames"),
)
def collapsed_frames(spark, sf):
    """Runs across stretches of two frames, so that borders are crossed often."""
    return media.collapse_frames(v.frames(spark, sf), "error", span=2).withColumn("mean_prob", F.round(F.col("mean_prob") + 1e-12, 9))


@query(
    "w3_utterances",
    v.sql(
        _RUNS
        + """, said as (select * from collapsed where token <> 'signup'),
             edges as (select utt, min(pos) as a, max(pos) as z from said where token <> 'view' group by utt)
             select s.utt, string_agg(case when token = 'view' then ' ' else token end, '' order by pos) as transcription,
               min(start_t) * 20 as first_start_ms, max(end_t) * 20 as last_end_ms, count(*) as n_tokens, round(avg(mean_prob) + 1e-12, 9) as mean_prob
             from said s join edges e on e.utt = s.utt and s.pos between a and z group by s.utt""",
        "frames",
    ),
)
def utterances(spark, sf):
    collapsed = media.collapse_frames(v.frames(spark, sf), "error")
    return media.utterances(collapsed, "view", special=("signup",)).withColumn("mean_prob", F.round(F.col("mean_prob") + 1e-12, 9))
