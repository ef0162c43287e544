"""Catalog queries: filters, look-ups, reconciliation, default order, pages, API rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayloft.operators import digests
from hayloft.operators.fusion import spread_rank
from hayloft.session import broadcast_if_small

AUDIBLE = ("audio", "video")
VISIBLE = ("image", "video")


# --- look-ups and filters -------------------------------------------------------------------------


def by_id(files: DataFrame, file_id: int) -> DataFrame:
    return files.where(F.col("id") == file_id)


def by_name(files: DataFrame, name: str) -> DataFrame:
    return files.where(F.col("name") == name)


def having(files: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Files whose ``key`` occurs in ``wanted``: the batch form of a look-up."""
    return files.join(broadcast_if_small(wanted.select(key)), key, "left_semi")


def of_type(files: DataFrame, *types: str) -> DataFrame:
    return files.where(F.col("ftype").isin(*types))


def _not_set(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def pending_ocr(files: DataFrame) -> DataFrame:
    return of_type(files, "image").where(_not_set("is_ocr_analyzed"))


def pending_transcripts(files: DataFrame) -> DataFrame:
    return of_type(files, *AUDIBLE).where(_not_set("is_transcript_analyzed"))


def retranscribable(files: DataFrame) -> DataFrame:
    """Transcripts made by machine: a manually corrected one is never overwritten."""
    return of_type(files, *AUDIBLE).where(_not_set("is_transcript_fixed"))


def pending_captions(files: DataFrame, regenerate_all: bool = False) -> DataFrame:
    visible = of_type(files, *VISIBLE)
    return visible if regenerate_all else visible.where(_not_set("is_llm_description_analyzed"))


def passes_markers(only_screenshot: Column, no_screenshots: Column, file_type: Column, ftype: Column, is_screenshot: Column) -> Column:
    """Does a file satisfy a query's type and screenshot markers?"""
    shot = F.coalesce(is_screenshot, F.lit(False))
    return (
        (file_type.isNull() | (ftype == file_type))
        & (~only_screenshot | shot)
        & (~no_screenshots | ~shot)
    )


# --- reconciliation -------------------------------------------------------------------------------


def reconcile(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, status): new on disk, deleted from disk, or kept. One join instead of three set operations."""
    left = stored.select("name", F.lit(True).alias("stored"))
    right = actual.select("name", F.lit(True).alias("present"))
    status = F.when(F.col("stored").isNull(), "new").when(F.col("present").isNull(), "deleted").otherwise("kept")
    return left.join(right, "name", "full_outer").select("name", status.alias("status"))


def reconcile_by_digest(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """The rows of ``reconcile`` where little is expected to have changed: only names in differing buckets are joined."""
    parts = digests.compare(stored.select("name"), actual.select("name"), ["name"])
    return parts.same.select("name", F.lit("kept").alias("status")).unionByName(reconcile(parts.left, parts.right))


def new_names(stored: DataFrame, actual: DataFrame) -> DataFrame:
    return actual.select("name").join(stored.select("name"), "name", "left_anti")


def deleted_names(stored: DataFrame, actual: DataFrame) -> DataFrame:
    return stored.select("name").join(actual.select("name"), "name", "left_anti")


def dense_numbers(df: DataFrame, key: str, column: str, start: int = 0, cells: int = 4096) -> DataFrame:
    """Consecutive numbers for unique keys: the same on every run and retry, and not from one big sort.

    Rows are numbered inside hash cells of the key; a cell starts where the cells before it end.
    """
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(cells)))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # over at most `cells` rows
    sizes = dealt.groupBy("_cell").agg(F.count("*").alias("_n"))
    starts = sizes.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1
    return (
        dealt.join(F.broadcast(starts), "_cell")
        .withColumn(column, (F.lit(start) + F.col("_start") + place).cast("long"))
        .drop("_cell", "_start")
    )


def apply_scan(stored: DataFrame, scan: DataFrame, next_id: int) -> DataFrame:
    """Catalog after a scan: deleted names leave, new media files enter with default values.

    ``scan(name, added_at, ftype)`` is a classified scan. Ids of new files continue at ``next_id``.
    """
    kept = stored.join(scan.select("name"), "name", "left_semi")
    come = scan.where(F.col("ftype") != "other").join(stored.select("name"), "name", "left_anti")
    numbered = dense_numbers(come, "name", "id", next_id)
    defaults = {
        "description": F.lit(""),
        **{
            c: F.lit(False)
            for c in ("is_transcript_analyzed", "is_transcript_fixed", "is_ocr_analyzed", "is_screenshot",
                      "is_llm_description_analyzed", "embedding_generation_failed")
        },
    }
    cells = []
    for field in stored.schema:
        source = F.col(field.name) if field.name in numbered.columns else defaults.get(field.name, F.lit(None))
        cells.append(source.cast(field.dataType).alias(field.name))
    return kept.select(*stored.columns).unionByName(numbered.select(*cells))


def changed_types(files: DataFrame, scan: DataFrame) -> DataFrame:
    """(id, name, old_type, ftype) of files whose media type is no longer what the catalog says."""
    found = scan.select("name", F.col("ftype").alias("found"))
    actual = F.coalesce("found", F.lit("other"))
    return (
        files.join(found, "name", "left")
        .where(~F.col("ftype").eqNullSafe(actual))
        .select("id", "name", F.col("ftype").alias("old_type"), actual.alias("ftype"))
    )


def restore_descriptions(files: DataFrame, dump: DataFrame) -> DataFrame:
    """Descriptions by name from a dump; files the dump does not know keep theirs."""
    saved = dump.select("name", F.col("description").alias("saved"))
    return (
        files.join(saved, "name", "left")
        .withColumn("description", F.coalesce("saved", "description"))
        .select(*files.columns)
    )


def orphans(artifact_names: DataFrame, files: DataFrame) -> DataFrame:
    """Stored vectors or thumbnails whose file left the catalog."""
    return artifact_names.select("name").distinct().join(files.select("name"), "name", "left_anti")


# --- order and pages ------------------------------------------------------------------------------


def default_order(files: DataFrame) -> DataFrame:
    """Newest first, larger id first among equals."""
    return files.orderBy(F.col("added_at").desc(), F.col("id").desc())


def page(files: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One page in the default order; a limit of None or -1 means everything after ``offset``."""
    rows = default_order(files).offset(offset)
    return rows if limit is None or limit < 0 else rows.limit(limit)


def default_positions(files: DataFrame) -> DataFrame:
    """(id, position): 0-based place of every file in the default order.

    All files form one list, so the place is counted (files per instant and id range), not numbered
    by one task that sorts the whole catalog.
    """
    instant = F.unix_micros(F.col("added_at").cast("timestamp"))
    rows = files.select(
        F.lit(0).alias("_list"),
        instant.cast("double").alias("score"),
        (-F.col("id")).alias("item_id"),
        "id",
    )
    return spread_rank(rows, ("_list",)).select("id", (F.col("rank") - 1).alias("position"))


def position_of(files: DataFrame, file_id: int) -> DataFrame:
    """Place of one file in the default order as a count; an unknown id has place 0."""
    mine = by_id(files, file_id).select("added_at").scalar()  # ids are unique: one value or none
    newer = (F.col("added_at") > mine) | ((F.col("added_at") == mine) & (F.col("id") > file_id))
    return files.where(newer).agg(F.count("*").alias("position"))


def latest_per_key(log: DataFrame, keys: Iterable[str], order: str = "seq") -> DataFrame:
    """Last write wins: the entry with the greatest ``order`` per key.

    The row-number limit is applied in every map task first, so a key with a third of all entries
    sends one row per task to its reducer.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def api_rows(files: DataFrame) -> DataFrame:
    """Catalog rows as clients see them: texts only once analysed, time as text."""
    shown = lambda flag, text: F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(text))
    return files.select(
        "id",
        "name",
        "description",
        F.col("added_at").cast("string").alias("added_at"),
        F.col("ftype").alias("file_type"),
        "is_screenshot",
        "ocr_text",
        shown("is_transcript_analyzed", "transcript").alias("transcript"),
        F.when(F.col("transcript").isNotNull(), F.col("is_transcript_fixed")).alias("is_transcript_fixed"),
        shown("is_llm_description_analyzed", "llm_description").alias("llm_description"),
    )


def hydrate(results: DataFrame, files: DataFrame) -> DataFrame:
    """Attach file rows to results; results whose file is gone disappear."""
    return results.join(files.withColumnRenamed("id", "item_id"), "item_id")
