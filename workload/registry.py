"""Registered queries: a Spark callable and, where SQL can say the same, the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# sums of doubles agree to this many digits whatever the order of addition
DIGITS = 6


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named columns (``score`` by default) rounded for comparison.

    Nine-digit scores often end on 500, where engines round either way; both sides add a trifle first.
    """
    return df.withColumns({c: F.round(F.col(c) + 3e-10, DIGITS) for c in columns or ("score",)})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
