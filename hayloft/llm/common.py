"""What the operators of this subpackage share: words, scratch tables and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.session import work_dir

# Words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
GAP = "[ \\t-\\r]+"
# Python tasks work on slices of about so many bytes of text, whatever the Arrow batch holds.
SLICE_BYTES = 3_000_000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: computed once, safe against lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keeping_ids(df: DataFrame, ids: DataFrame, key: str, limit: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one long column of that name).

    Up to ``limit`` ids of eight bytes are broadcast; more are joined by a shuffle.
    """
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        yield from (batch.slice(a, b - a) for a, b in spans(batch.column(column), limit))
    release()


def release() -> None:
    """Workers are used again by later stages; what this one has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spans(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    if not len(text):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, end
        start = end


def split_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column, with A-Z in lower case if asked, and the row of each."""
    # a copy: kernels on lists made from a slice lose its offset
    whole = text.take(pa.array(np.arange(len(text))))
    whole = pc.fill_null(whole, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    flat = pc.list_flatten(lists)
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the place of each value among them."""
    encoded = values.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)


def hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.cast(pa.large_binary()).to_pylist()), U64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (in place), one to one."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def gram_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; the runs overlap and cross rows, callers drop those that do."""
    count = len(word_hash) - size + 1
    if count <= 0:
        return np.empty(0, U64)
    total = np.zeros(count, U64)
    factor = 0x9E3779B97F4A7C15
    for k in range(size):
        total += word_hash[k : k + count] * U64(factor)
        factor = (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1
    return mixed(total)
