"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; the component is its smallest id.

    Rounds of large and small stars: each vertex hands its neighbours to the smallest among them, first
    the larger neighbours, then the smaller ones. Rounds end when every vertex points at a root. A row
    is a pair of ids, so a centre with many links is spread by the joins and its minimum is
    pre-aggregated. Links of an id with itself and repeated links are harmless.
    """
    edges = _downward(links)
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        loose = edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not loose and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _downward(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return _downward(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _downward(moved.unionByName(least.withColumnRenamed("low", "b")))
