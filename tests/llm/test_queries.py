"""The registered queries on the smallest tables, and the pipeline against its stages' rules."""

import pytest

import corpus_pipeline
from hayloft.llm.queries import ORACLES, QUERIES
from tests import oracle
from tests.llm import plain


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert oracle.compare(df, oracle.connect(sf), ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_jaccard_query_equals_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op8_jaccard_join"](spark, sf).collect()), key=repr)
    assert got == plain.groups([tuple(r) for r in rows])


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            left = {i for i, _, c in plain.groups([(r[0], r[1]) for r in before.select("doc_id", "text").collect()]) if i == c}
            assert {r[0] for r in docs.select("doc_id").collect()} == left and docs.count() == len(left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).orderBy("start").collect()
    assert len(last) == docs.count()
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(last, last[1:]))


@pytest.mark.parametrize("rows", [None, []])
def test_stages_on_awkward_rows(spark, sf, tmp_path, rows):
    docs = plain.frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "token_ids":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert rows is None or docs.count() == 0
