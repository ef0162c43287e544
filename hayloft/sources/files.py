"""Directory scan and media types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.functions.text import stream_kind

# --- fixed values -----------------------------------------------------------
EXTENSIONS = {
    "image": ("jpg", "jpeg", "jpe", "png", "gif", "bmp", "tif", "tiff", "webp", "ico", "pbm", "pgm", "ppm", "heic", "avif"),
    "video": ("mp4", "m4v", "mov", "qt", "mkv", "webm", "avi", "mpg", "mpeg", "mpe", "ogv", "3gp", "flv", "wmv"),
    "audio": ("mp3", "mp2", "m4a", "wav", "flac", "ogg", "oga", "opus", "aac", "aif", "aiff", "aifc", "au", "snd", "wma"),
}
# leading bytes as hex; a RIFF container names its content after the size
IMAGE_SIGNATURES = ("FFD8FF", "89504E470D0A1A0A", "47494638", "424D", "49492A00", "4D4D002A", "00000100")
# --- end of fixed values ----------------------------------------------------


def scan_directory(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(name, path, added_at, length) of the regular files directly in a directory.

    Without ``content`` the file bytes are not read. The source offers no creation time, so the
    modification time stands for it.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    columns = [
        file_name(F.col("path")).alias("name"),
        "path",
        F.col("modificationTime").cast("timestamp_ntz").alias("added_at"),
        "length",
    ]
    return rows.select(*columns, "content") if content else rows.select(*columns)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def type_by_name(name: Column) -> Column:
    """Media type promised by the extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    promised = F
    for ftype, extensions in EXTENSIONS.items():
        promised = promised.when(extension.isin(*extensions), ftype)
    return promised.otherwise("other")


def looks_like_image(content: Column) -> Column:
    """Do the leading bytes belong to a known picture format?"""
    head = F.hex(F.substring(content, 1, 16))
    known = F.lit(False)
    for signature in IMAGE_SIGNATURES:
        known = known | head.startswith(signature)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    iso_media = F.substring(head, 9, 8) == "66747970"  # heic, avif
    netpbm = head.rlike("^5[0]3[1-6]")
    return known | webp | iso_media | netpbm


def classify(scan: DataFrame) -> DataFrame:
    """Scan with ``ftype``. Pictures are checked by their bytes when ``content`` is there; sound and
    film by a probe report (column ``probe``) when there is one, a null report meaning unreadable.
    """
    promised = type_by_name(F.col("name"))
    ftype = promised
    if "content" in scan.columns:
        ftype = F.when((promised == "image") & ~F.coalesce(looks_like_image(F.col("content")), F.lit(False)), "other").otherwise(ftype)
    if "probe" in scan.columns:
        ftype = F.when(promised.isin("audio", "video"), F.coalesce(stream_kind(F.col("probe")), F.lit("other"))).otherwise(ftype)
    return scan.withColumn("ftype", ftype)


def media_files(scan: DataFrame) -> DataFrame:
    """Classified scan without files that are no media."""
    return classify(scan).where("ftype <> 'other'")
