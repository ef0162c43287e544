"""Comparison by digests against plain set operations, and the plan of an unchanged table."""

import random

import pytest
from pyspark.sql import functions as F

from hayloft.operators import catalog, digests, enrich, vectors
from tests.rows import catalog_rows
from tests.test_edits import frame


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pairs(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


@pytest.mark.parametrize("roots, leaves", [(1, 1), (4, 4), (64, 64), (4096, 4096)])
def test_only_differing_buckets_are_left_over(spark, roots, leaves):
    rng = random.Random(roots)
    left = {f"k{i}": rng.choice(["x", "y", "", None]) for i in range(500)}
    right = dict(left)
    for key in rng.sample(sorted(left), 9):
        right[key] = "changed"
    for key in rng.sample(sorted(left), 5):
        del right[key]
    right |= {"new1": None, "new2": ""}
    parts = digests.compare(pairs(spark, list(left.items())), pairs(spark, list(right.items())), ["key"], ["value"], roots, leaves)
    same, ours, theirs = ({tuple(r) for r in part.collect()} for part in parts)
    assert same | ours == set(left.items()) and not same & ours
    assert same <= set(right.items()) and theirs == set(right.items()) - same
    assert set(left.items()) - set(right.items()) <= ours
    if roots * leaves > 10_000:
        assert len(same) > 400 and len(ours) < 40


def test_nulls_and_empty_tables(spark):
    some, none = pairs(spark, [("a", None), ("b", "")]), pairs(spark, [])
    swapped = pairs(spark, [("a", ""), ("b", None)])
    assert digests.compare(some, some, ["key"], ["value"]).left.count() == 0
    assert digests.compare(some, swapped, ["key"], ["value"]).same.count() == 0
    assert [p.count() for p in digests.compare(some, none, ["key"], ["value"])] == [0, 2, 0]
    assert [p.count() for p in digests.compare(none, some, ["key"], ["value"])] == [0, 0, 2]
    assert [p.count() for p in digests.compare(none, none, ["key"], ["value"])] == [0, 0, 0]


def test_reconcile_of_an_unchanged_catalog_joins_nothing(spark):
    names = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("name"))
    unchanged = catalog.reconcile_by_digest(names, names.repartition(3))
    assert "Join" not in plan(unchanged) and unchanged.where("status = 'kept'").count() == 3000
    later = names.where("name <> 'f7'").unionByName(spark.createDataFrame([("g",)], "name string"))
    changed = catalog.reconcile_by_digest(names, later)
    assert sorted(map(tuple, changed.collect())) == sorted(map(tuple, catalog.reconcile(names, later).collect()))


def test_work_list_of_a_current_store_joins_nothing(spark):
    files = frame(spark, catalog_rows(60))
    wanted = vectors.wanted_embeddings(files)
    texts = enrich.embed_texts(wanted.where("text is not null"))
    pixels = wanted.where("text is null").select(
        "item_id", "kind", F.explode(F.array(F.lit(0), F.lit(1))).alias("frame"), F.array(F.lit(1.0).cast("float")).alias("vec"), F.lit(None).cast("string").alias("text_sha")
    )
    store = texts.unionByName(pixels)
    current = vectors.work_list(files, store)
    assert "Join" not in plan(current) and {r.action for r in current.collect()} == {"keep"} and current.count() == wanted.count()
    edited = files.withColumn("description", F.when(F.col("id") == 4, "another").otherwise(F.col("description"))).where("id <> 8")
    rest = {(r.item_id, r.kind, r.action) for r in vectors.work_list(edited, store).collect() if r.action != "keep"}
    assert (4, "D", "stale") in rest and {a for i, _, a in rest if i == 8} == {"drop"} and {i for i, _, _ in rest} == {4, 8}
