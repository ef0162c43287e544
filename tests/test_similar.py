"""Similar items on rows made here."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hayloft.operators import vectors
from hayloft.plans import similar
from tests.rows import catalog_rows
from workload import vector_cases


def test_products_with_every_query_of_the_label(spark, tmp_path):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(30, 4)).astype(np.float32)
    label = [None if i == 7 else i % 2 for i in range(30)]
    pq.write_table(pa.table({"vec_id": range(30), "embedding": vecs.tolist(), "label": pa.array(label, pa.int32())}, schema=pa.schema({"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()})), tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"item_id": pa.array([2, 3, 7, 99]), "text": ["a"] * 4}), tmp_path / "benchmark.parquet")
    got = {(r.vec_id, r.query_id) for r in vector_cases.dot_products(spark, str(tmp_path)).collect()}
    assert got == {(i, q) for i in range(30) for q in (2, 3) if label[i] == label[q]}


def test_list_of_a_single_text_is_not_cut(spark):
    rows = [r | {"transcript": None, "ocr_text": None, "description": "a cat"} for r in catalog_rows(12)]
    rows[0]["ocr_text"] = "a dog"
    schema = "id long, name string, added_at timestamp_ntz, description string, ftype string, is_transcript_analyzed boolean, transcript string, is_transcript_fixed boolean, is_ocr_analyzed boolean, is_screenshot boolean, ocr_text string, is_llm_description_analyzed boolean, llm_description string, embedding_generation_failed boolean"
    files = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {t}" for c, t in zip(rows[0], _types(schema, rows[0]))))
    rng = np.random.default_rng(2)
    cells = [(i, kind, 0, vec.tolist()) for kind, ids in (("D", range(0, 4)), ("O", range(4, 8)), ("T", range(8, 12))) for i, vec in zip(ids, rng.normal(size=(4, 64)))]
    store = spark.createDataFrame(cells, "item_id long, kind string, frame int, vec array<double>")
    seeds = files.where("id < 2").select(F.col("id").alias("seed_id"))
    found = similar.similar_metadata(files, store, seeds, 3).collect()
    # three kinds hold three items each; seed 1 has one text, seed 0 two
    near = {s: [r for r in found if r.seed_id == s and r.item_id != s] for s in (0, 1)}
    assert len(near[0]) <= 3 < 8 <= len(near[1]) <= 9
    assert sorted(r["rank"] for r in near[1]) == list(range(2, len(near[1]) + 2))


def test_lists_of_a_block_while_the_vectors_pass(monkeypatch):
    monkeypatch.setattr(vectors, "CELLS", 500)
    monkeypatch.setattr(vectors, "HELD", 400)
    rng = np.random.default_rng(3)
    items = np.repeat(np.arange(300), rng.integers(1, 4, 300))
    stored = rng.integers(-2, 3, (len(items), 6)).astype(float)  # many equal scores
    ids, asked = np.array([5, 9, 7, 9]), rng.integers(-2, 3, (4, 6)).astype(float)
    for k in (1, 7, 1000):
        block, most = vectors._Block(("V", 0), k), 0
        block.ask(ids[:3], asked[:3])
        block.ask(ids[3:], asked[3:])
        rows = []
        for lo in range(0, len(items), 50):
            rows += block.meet(items[lo : lo + 50], stored[lo : lo + 50])
            most = max(most, block.held)
        rows += block.ended()
        got = {q: [] for q in (5, 7, 9)}
        for batch in rows:
            for r in batch.to_pylist():
                got[r["query_id"]].append((-r["score"], r["item_id"]))
        for q, found in got.items():
            best = {}
            for i, score in zip(items, (stored @ asked[ids == q].T).max(axis=1)):
                best[i] = max(best.get(i, -np.inf), score)
            assert found == sorted((-score, i) for i, score in best.items())[:k]
        assert most <= 3 * k + 200 + 500


def test_products_are_made_a_bounded_number_at_a_time(monkeypatch):
    monkeypatch.setattr(vectors, "CELLS", 1000)
    rng = np.random.default_rng(4)
    matrix, queries = rng.normal(size=(100, 3)), rng.normal(size=(50, 3))
    found = list(vectors._reduce_block(np.arange(100), matrix, np.arange(50), queries, "D", None))
    assert max(b.num_rows for b in found) <= 1000 and sum(b.num_rows for b in found) == 5000


def _types(schema: str, row: dict) -> list[str]:
    named = dict(c.split(" ") for c in schema.split(", "))
    return [named[c] for c in row]


def test_lists_of_a_seed_are_dealt_once(spark):
    schema = "id long, description string, ocr_text string, transcript string"
    files = spark.createDataFrame([(i, f"cat {i % 3}", "dog" if i % 2 else None, f"bird {i}") for i in range(12)], schema)
    rng = np.random.default_rng(5)
    cells = [(i, kind, vec.tolist()) for kind in "DOT" for i, vec in zip(range(12), rng.normal(size=(12, 64)))]
    store = spark.createDataFrame(cells, "item_id long, kind string, vec array<double>")
    found = similar.similar_metadata(files, store, files.select(F.col("id").alias("seed_id")), 4)
    assert found.where("item_id = seed_id and rank = 1").count() == 12
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in physical.splitlines() if "Exchange hashpartitioning" in x and "item_id" in x]
