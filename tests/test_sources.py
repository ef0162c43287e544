import datetime as dt

import pytest
from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.operators import catalog, enrich, lexical, vectors
from hayloft.plans import indexing, search
from hayloft.sources import files as file_source
from hayloft.sources import tables
from tests.rows import catalog_rows
from tests.test_edits import frame

PNG = bytes.fromhex("89504e470d0a1a0a") + b"rest"


def directory(tmp_path):
    root = tmp_path / "media"
    (root / "sub").mkdir(parents=True)
    for name, data in {"a.png": PNG, "b.png": b"not a picture", "c.mp3": b"ID3", "d.txt": b"x", "e.webp": b"RIFF1234WEBPVP8", "sub/f.png": PNG}.items():
        (root / name).write_bytes(data)
    return str(root)


def test_scan_skips_directories_and_checks_bytes(spark, tmp_path):
    scan = file_source.scan_directory(spark, directory(tmp_path), content=True)
    got = {r.name: r.ftype for r in file_source.classify(scan).collect()}
    assert got == {"a.png": "image", "b.png": "other", "c.mp3": "audio", "d.txt": "other", "e.webp": "image"}
    assert "content" not in file_source.scan_directory(spark, directory(tmp_path / "again")).columns


def test_probe_report_decides_film_and_sound(spark):
    rows = [("a.mp4", "Stream #0: Video"), ("b.mp4", "Stream #0: Audio"), ("c.mp3", None), ("d.jpg", None)]
    got = {r.name: r.ftype for r in file_source.classify(spark.createDataFrame(rows, "name string, probe string")).collect()}
    assert got == {"a.mp4": "video", "b.mp4": "audio", "c.mp3": "other", "d.jpg": "image"}


def test_versions(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path), "t")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(spark.range(3)) == 1
    first = table.read()
    assert table.write(first.where("id < 2")) == 2
    assert table.read().count() == 2 and first.count() == 3


def test_registry_keeps_names_and_paths_unique(spark):
    registry = spark.createDataFrame([(1, "a", "/a", "en", False)], S.DIRECTORIES)
    wanted = spark.createDataFrame([(2, "a", "/x", "en", False), (3, "b", "/a", "pl", True), (4, "c", "/c", "en", True)], S.DIRECTORIES)
    after = tables.register(registry, wanted)
    assert sorted(r.name for r in after.collect()) == ["a", "c"]
    assert tables.directory(after, "c").first().fs_path == "/c"
    assert tables.unregister(after, "a").count() == 1


def test_catalog_by_directory_reads_one_partition(spark, tmp_path):
    files = frame(spark, catalog_rows(10)).withColumn("corpus", F.when(F.col("id") < 4, "x").otherwise("y"))
    tables.write_catalog(files, str(tmp_path))
    one = tables.read_catalog(spark, str(tmp_path), "x")
    assert one.count() == 4
    assert "PartitionFilters: [isnotnull(corpus" in one._jdf.queryExecution().executedPlan().toString()


def test_token_filter_reaches_the_postings_scan(spark, tmp_path):
    tables.write_index(lexical.build_index(lexical.indexable_texts(frame(spark, catalog_rows(10)))), str(tmp_path))
    postings = tables.read_index(spark, str(tmp_path)).postings.where("field = 'description' and token = 'cat'")
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,cat)" in plan and "EqualTo(field,description)" in plan


def test_stored_statistics_score_alike(spark, tmp_path):
    index = lexical.build_index(lexical.indexable_texts(frame(spark, catalog_rows(30))))
    tables.write_index(index, str(tmp_path))
    tokens = lexical.query_tokens(spark.createDataFrame([(1, "a cat runs"), (2, "t1 dogs")], "query_id long, query_text string"))
    fresh = lexical.bm25_fields(lexical.match(index, tokens))
    stored = lexical.bm25_fields(lexical.match(tables.read_index(spark, str(tmp_path)), tokens))
    assert fresh.count() > 0 and fresh.exceptAll(stored).count() == 0


def test_counting_an_item_needs_no_second_shuffle(spark):
    plan = lexical.build_index(lexical.indexable_texts(frame(spark, catalog_rows(30)))).postings._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning") == 1


def test_dense_numbers(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(500)], "name string")
    a = catalog.dense_numbers(names, "name", "id", 7, cells=16)
    assert sorted(r.id for r in a.collect()) == list(range(7, 507))
    b = catalog.dense_numbers(names.repartition(5), "name", "id", 7, cells=16)
    assert a.exceptAll(b).count() == 0


def test_default_positions_with_ties(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3)) for i in range(60)]
    files = spark.createDataFrame(rows, "id long, added_at timestamp_ntz")
    want = {i: p for p, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]), reverse=True))}
    assert {r.id: r.position for r in catalog.default_positions(files).collect()} == want
    assert catalog.position_of(files, 5).first().position == want[5]
    assert catalog.position_of(files, 999).first().position == 0


def test_model_failure_is_a_row(spark):
    def factory():
        return lambda content: {"ok": "text"}[content]

    work = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, content string")
    got = {r.id: (r.text, r.error is not None) for r in enrich.run_model(work, "content", factory).collect()}
    assert got == {1: ("text", False), 2: (None, True)}


def test_model_gets_batches_and_a_bad_value_fails_alone(spark):
    class Model:
        def many(self, values):
            return [self(v) + f"/{len(values)}" for v in values]

        def __call__(self, value):
            return {"bad": None}.get(value, value).upper()

    rows = [(i, f"v{i}") for i in range(10)] + [(10, "bad"), (11, "v11")]
    work = spark.createDataFrame(rows, "id long, content string").coalesce(1)
    got = {r.id: (r.text, r.error is not None) for r in enrich.run_model(work, "content", Model, 5).collect()}
    want = {i: (f"V{i}/5", False) for i in range(10)} | {10: (None, True), 11: ("V11", False)}
    assert got == want

    class Short(Model):
        def many(self, values):
            return values[:1]

    assert {r.id: r.text for r in enrich.run_model(work.where("id < 3"), "content", Short, 5).collect()} == {0: "V0", 1: "V1", 2: "V2"}
    assert enrich.run_model(work.limit(0), "content", Model).count() == 0


def test_prefixes_by_mode(spark):
    seen = lambda: lambda texts: [[float(len(t))] for t in texts]
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    affixes = {"query": "query: "}
    assert [r[0] for r in df.select(enrich.embed_column(F.col("t"), seen, "query", affixes)).collect()] == [[10.0], None]
    assert df.select(enrich.embed_column(F.col("t"), seen, "passage", affixes)).first()[0] == [3.0]


def test_initialize_then_search(spark, tmp_path):
    root = str(tmp_path / "tables")
    empty = frame(spark, [])
    store = spark.createDataFrame([], S.VECTORS).drop("text_sha").withColumn("text_sha", F.lit(None).cast("string"))

    def reader():
        return lambda content: "a cat on a sofa" if content.startswith(b"\x89PNG") else ""

    corpus = indexing.initialize(spark, directory(tmp_path), root, empty, store, {"ocr": reader})
    files = {r.name: r for r in corpus.files.collect()}
    assert set(files) == {"a.png", "c.mp3", "e.webp"}
    assert files["a.png"].is_screenshot and not files["e.webp"].is_screenshot and files["e.webp"].is_ocr_analyzed
    queries = spark.createDataFrame([(1, "cat"), (2, "@image"), (3, "c.mp3"), (4, "@audio cat")], "query_id long, raw string")
    vecs = enrich.embed_queries(search.parse_queries(queries)).where("vec is not null")
    found = search.search(corpus, queries, vecs, vecs, search.confidence_profile("en"), list_bound=3).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.item_id, r.total))
    a, c = files["a.png"].id, files["c.mp3"].id
    assert by_query[1] == [(a, 1)] and by_query[3] == [(c, 1)]
    assert len(by_query[2]) == 2 and 4 not in by_query
    work = vectors.work_list(corpus.files, corpus.vectors).where("kind = 'O'").collect()
    assert [w.action for w in work] == ["keep"]
