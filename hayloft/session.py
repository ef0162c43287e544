"""Session settings, scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Beyond this many rows a lookup side is shuffled instead of broadcast.
BROADCAST_ROWS = 500_000


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-JVM session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hayloft")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hayloft-"))
        .getOrCreate()
    )


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for state that must outlive a task: streaming checkpoints, staged tables.

    It lies in the shared folder named by ``spark.checkpoint.dir``, else in the warehouse; executors
    reach both.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, its partitions and their order kept."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose row count was checked; otherwise Spark shuffles it."""
    return F.broadcast(df) if fits(df, max_rows) else df


def pinned(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A small table fetched once, so that a plan reading it many times does not derive it many times.

    Spark knows the exact size of the result and broadcasts it by its own threshold. A table with
    more than ``max_rows`` rows stays as it is; no more than one row beyond is ever fetched.
    """
    head = df.limit(max_rows + 1).toArrow()
    return df if head.num_rows > max_rows else df.sparkSession.createDataFrame(head, schema=df.schema)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few large splits to all cores before per-row work that dwarfs the scan.

    A no-op for inputs with at least as many splits as the session has cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
