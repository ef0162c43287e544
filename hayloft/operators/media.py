"""Media planning, OCR and transcript assembly, collapse of per-frame tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.functions import text
from hayloft.session import broadcast_if_small


def frame_plan(videos: DataFrame, max_frames: int | None = None, spacing: float = S.SECONDS_PER_FRAME) -> DataFrame:
    """(item_id, frame, offset_s): evenly spaced frames, each in the middle of its share of the video."""
    n = F.greatest((F.col("duration") / spacing).cast("int"), F.lit(1))
    n = n if max_frames is None else F.least(F.lit(max_frames), n)
    return (
        videos.select("item_id", "duration", n.alias("n"))
        .withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("item_id", "frame", (F.col("duration") * (F.col("frame") * 2 + 1) / (F.col("n") * 2)).alias("offset_s"))
    )


def segment_plan(
    audio: DataFrame,
    seconds: int = S.SEGMENT_SECONDS,
    max_parts: int | None = None,
    min_seconds: float = S.MIN_SEGMENT_SECONDS,
) -> DataFrame:
    """(item_id, part, start_s, end_s): parts to transcribe; a too short rest is left out."""
    whole = F.floor(F.floor("duration") / seconds).cast("int") + 1
    whole = whole if max_parts is None else F.least(whole, F.lit(max_parts))
    return (
        audio.select("item_id", "duration", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part"))
        .where((F.col("part") == 0) | (F.col("duration") - F.col("part") * seconds >= min_seconds))
        .select(
            "item_id",
            "part",
            (F.col("part") * seconds).cast("double").alias("start_s"),
            F.least(F.col("duration"), ((F.col("part") + 1) * seconds).cast("double")).alias("end_s"),
        )
    )


def thumbnail_plan(videos: DataFrame) -> DataFrame:
    """(item_id, attempt, offset_s): one second in; the middle of the video should that fail."""
    attempts = F.array(F.lit(1.0), F.col("duration") / 2)
    return videos.select("item_id", F.posexplode(attempts).alias("attempt", "offset_s"))


def choose_caption(first: Column, second: Column, min_chars: int = S.MIN_CAPTION_CHARS) -> Column:
    """Mid-video caption when long enough, else the longer of it and the quarter-point caption."""
    retry_wins = (F.length(first) < min_chars) & second.isNotNull() & (F.length(second) > F.length(first))
    return F.when(retry_wins, second).otherwise(first)


def captions_from_attempts(attempts: DataFrame) -> DataFrame:
    """(item_id, attempt, caption) with attempts 0 and 1 -> (item_id, caption)."""
    per_item = attempts.groupBy("item_id").agg(
        F.max(F.when(F.col("attempt") == 0, F.col("caption"))).alias("c0"),
        F.max(F.when(F.col("attempt") == 1, F.col("caption"))).alias("c1"),
    )
    return per_item.select("item_id", choose_caption(F.col("c0"), F.col("c1")).alias("caption"))


def _joined(parts: Column, order: str, value: str) -> Column:
    in_order = F.sort_array(F.collect_list(F.struct(F.col(order), parts.alias(value))))
    return text.strip_blank(F.array_join(F.transform(in_order, lambda p: p[value]), " "))


def accepted_boxes(boxes: DataFrame, min_probability: float = S.MIN_BOX_PROBABILITY) -> DataFrame:
    return boxes.where(F.col("prob") >= min_probability)


def ocr_text(boxes: DataFrame) -> DataFrame:
    """(item_id, ocr_text): accepted boxes in reading order. One value per image, so a group is one file's text."""
    return accepted_boxes(boxes).groupBy("item_id").agg(_joined(F.col("text"), "pos", "text").alias("ocr_text"))


def screenshot_flags(
    boxes: DataFrame, word_freq: DataFrame, min_words: int = 1, min_frequency: float = S.MIN_WORD_FREQUENCY
) -> DataFrame:
    """(item_id, is_screenshot): some language knows at least ``min_words`` of the image's words.

    ``word_freq(lang, word, freq)``. Words are counted per image and word before the dictionary join,
    so the most frequent word of the collection does not make a hot join key larger than its images.
    """
    words = (
        accepted_boxes(boxes)
        .select("item_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
        .where(text.is_word_shaped(F.col("word")))
        .groupBy("item_id", "word")
        .agg(F.count("*").alias("n"))
    )
    real = word_freq.where(F.col("freq") > min_frequency).select("lang", "word")
    matched = (
        words.join(broadcast_if_small(real), "word")
        .groupBy("item_id", "lang")
        .agg(F.sum("n").alias("n"))
        .groupBy("item_id")
        .agg((F.max("n") >= min_words).alias("is_screenshot"))
    )
    return (
        boxes.select("item_id").distinct()
        .join(matched, "item_id", "left")
        .select("item_id", F.coalesce("is_screenshot", F.lit(False)).alias("is_screenshot"))
    )


def transcripts(segments: DataFrame) -> DataFrame:
    """(item_id, transcript): segment texts in order up to the first failed one (text null).

    A failing first segment gives null.
    """
    failed = segments.groupBy("item_id").agg(F.min(F.when(F.col("text").isNull(), F.col("part"))).alias("failed_at"))
    usable = F.when(F.col("failed_at").isNull() | (F.col("part") < F.col("failed_at")), F.col("text"))
    out = (
        segments.join(failed, "item_id")
        .groupBy("item_id")
        .agg(_joined_present(usable).alias("joined"), F.min("failed_at").alias("failed_at"))
    )
    return out.select("item_id", F.when(F.col("failed_at").isNull() | (F.col("failed_at") > 0), F.col("joined")).alias("transcript"))


def _joined_present(part_text: Column) -> Column:
    pieces = F.collect_list(F.when(part_text.isNotNull(), F.struct(F.col("part"), part_text.alias("text"))))
    return text.strip_blank(F.array_join(F.transform(F.sort_array(pieces), lambda p: p["text"]), " "))


# --- frame tokens of a speech model ---------------------------------------------------------------


def collapse_frames(frames: DataFrame, blank: str, span: int = 4096) -> DataFrame:
    """(utt, pos, token, start_t, end_t, mean_prob): runs of equal frame tokens, blanks left out.

    ``frames(utt, t, token, prob)`` with consecutive ``t``. A run of one frame ends one step after its
    start, a longer one at the index of its last frame; the probability is averaged over
    [start, end). Frames are cut into stretches of ``span`` steps, each worked on by itself, so that
    one recording with a third of all frames keeps many tasks busy. A run that crosses a border
    belongs to the stretch it starts in; that is settled on one summary row per stretch.
    """
    inside = Window.partitionBy("utt", "stretch").orderBy("t")
    fresh = (~F.col("token").eqNullSafe(F.lag("token").over(inside))).cast("int")
    local = (
        frames.withColumn("stretch", F.floor(F.col("t") / span))
        .withColumn("_new", fresh)
        .withColumn("run", F.sum("_new").over(inside))
        .groupBy("utt", "stretch", "run", "token")
        .agg(
            F.min("t").alias("start_t"),
            F.max("t").alias("last_t"),
            F.sum("prob").alias("_sum"),
            F.max_by("prob", "t").alias("_last_prob"),
        )
    )
    owned = local.join(_border_owners(local), ["utt", "stretch"])
    crosses = (F.col("run") == 1) & F.col("owner_stretch").isNotNull()
    runs = (
        owned.withColumn("stretch", F.when(crosses, F.col("owner_stretch")).otherwise(F.col("stretch")))
        .withColumn("run", F.when(crosses, F.col("owner_run")).otherwise(F.col("run")))
        .groupBy("utt", "stretch", "run", "token")
        .agg(
            F.min("start_t").alias("start_t"),
            F.max("last_t").alias("last_t"),
            F.sum("_sum").alias("_sum"),
            F.max_by("_last_prob", "last_t").alias("_last_prob"),
        )
        .where(F.col("token") != blank)
    )
    before = Window.partitionBy("utt").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = runs.groupBy("utt", "stretch").agg(F.count("*").alias("_n"))
    offsets = counts.select("utt", "stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("utt", "stretch").orderBy("start_t"))
    alone = F.col("start_t") == F.col("last_t")
    length = F.col("last_t") - F.col("start_t")
    return runs.join(offsets, ["utt", "stretch"]).select(
        "utt",
        (F.col("_before") + place).alias("pos"),
        "token",
        "start_t",
        F.when(alone, F.col("start_t") + 1).otherwise(F.col("last_t")).alias("end_t"),
        F.when(alone, F.col("_sum")).otherwise(F.try_divide(F.col("_sum") - F.col("_last_prob"), length)).alias("mean_prob"),
    )


def _border_owners(local: DataFrame) -> DataFrame:
    """(utt, stretch, owner_stretch, owner_run): the run that the stretch's first run continues, if any.

    A stretch that is one run from end to end passes the question on to the stretch before it.
    """
    ends = local.groupBy("utt", "stretch").agg(
        F.min_by("token", "run").alias("first"), F.max_by("token", "run").alias("last"), F.max("run").alias("n_runs")
    )
    along = Window.partitionBy("utt").orderBy("stretch")
    continues = F.col("first").eqNullSafe(F.lag("last").over(along)) & (F.lag("stretch").over(along) == F.col("stretch") - 1)
    marked = ends.withColumn("continues", F.coalesce(continues, F.lit(False)))
    starts_last_run = F.when(~F.col("continues") | (F.col("n_runs") > 1), F.struct("stretch", "n_runs"))
    owner = F.last(starts_last_run, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    owner = F.when(F.col("continues"), owner)
    return marked.select("utt", "stretch", owner["stretch"].alias("owner_stretch"), owner["n_runs"].alias("owner_run"))


def utterances(collapsed: DataFrame, silence: str, special: tuple[str, ...] = (), ms: int = S.MS_PER_FRAME_STEP) -> DataFrame:
    """(utt, transcription, first_start_ms, last_end_ms, n_tokens, mean_prob) from collapsed tokens.

    Silence becomes a blank, special tokens are dropped, blanks at both ends are trimmed together
    with their times. One row per utterance holds that utterance's text only.
    """
    spoken = collapsed.where(~F.col("token").isin(*special)) if special else collapsed
    quiet = F.col("token") == silence
    edges = spoken.groupBy("utt").agg(
        F.min(F.when(~quiet, F.col("pos"))).alias("_from"), F.max(F.when(~quiet, F.col("pos"))).alias("_to")
    )
    kept = spoken.join(edges, "utt").where(F.col("pos").between(F.col("_from"), F.col("_to")))
    piece = F.when(quiet, " ").otherwise(F.col("token"))
    in_order = F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return kept.groupBy("utt").agg(
        F.array_join(F.transform(in_order, lambda p: p["piece"]), "").alias("transcription"),
        (F.min("start_t") * ms).alias("first_start_ms"),
        (F.max("end_t") * ms).alias("last_end_ms"),
        F.count("*").alias("n_tokens"),
        F.avg("mean_prob").alias("mean_prob"),
    )
