"""BM25, vectors, ranks and fusion against small programs written from the formulas."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.operators import fusion, lexical, vectors
from hayloft.plans import search


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["cat", "cats", "dog", "house", "a", "bus", "été"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(n)]


def brute_bm25(docs, query, k1=1.5, b=0.75):
    scores = Counter()
    for variant, weight in (("original", 1.5), ("lemma", 1.0)):
        stem = (lambda t: t[:-1] if len(t) > 3 and t.endswith("s") else t) if variant == "lemma" else (lambda t: t)
        toks = {i: [stem(t) for t in text.split()] for i, text in docs}
        avg = sum(map(len, toks.values())) / len(toks)
        for token in {stem(t) for t in query.split()}:
            df = sum(token in t for t in toks.values())
            if not df:
                continue
            idf = math.log((len(toks) - df + 0.5) / (df + 0.5) + 1)
            for i, t in toks.items():
                tf = t.count(token)
                if tf:
                    scores[i] += weight * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return scores


@pytest.mark.parametrize("seed", [1, 2])
def test_bm25(spark, seed):
    docs = corpus(seed)
    texts = spark.createDataFrame([(i, "description", t) for i, t in docs], "item_id long, field string, text string")
    queries = spark.createDataFrame([(1, "cats bus cats"), (2, "été zebra"), (3, "???")], "query_id long, query_text string")
    matched = lexical.match(lexical.build_index(texts), lexical.query_tokens(queries))
    got = {(r.query_id, r.item_id): r.score for r in lexical.bm25_fields(matched).collect()}
    want = {(q, i): s for q, text in ((1, "cats bus cats"), (2, "été zebra")) for i, s in brute_bm25(docs, text).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_postings_are_counted_without_a_table_of_all(spark):
    """F34 and others: grouping all postings of a task took memory and spilled."""
    texts = spark.createDataFrame([(i, "description", t) for i, t in corpus(4)], "item_id long, field string, text string")
    index = lexical.build_index(texts)
    assert "HashAggregate" not in index.postings._jdf.queryExecution().executedPlan().toString()
    got = {(r.variant, r.token, r.item_id): (r.tf, r.dl) for r in index.postings.collect()}
    want = {}
    for i, t in corpus(4):
        for variant, words in (("original", t.split()), ("lemma", [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in t.split()])):
            want.update({(variant, w, i): (n, len(words)) for w, n in Counter(words).items()})
    assert got == want


def test_postings_of_repeated_and_null_items(spark):
    """Texts of one item, field and length are added up; other lengths stay apart."""
    rows = [(1, "d", "a b a cats"), (1, "d", "a b x y"), (1, "d", "a q"), (1, "e", "a a"), (2, "d", "cat cat"), (None, "d", "z z"), (None, "d", "z y"), (3, "d", "...")]
    index = lexical.build_index(spark.createDataFrame(rows, "item_id long, field string, text string"))
    want = Counter()
    for i, f, t in rows:
        words = [] if t == "..." else t.split()
        for w in words:
            want["original", f, w, i, len(words)] += 1
            want["lemma", f, w[:-1] if w == "cats" else w, i, len(words)] += 1
    got = [((r.variant, r.field, r.token, r.item_id, r.dl), r.tf) for r in index.postings.collect()]
    assert len(got) == len(want) and dict(got) == dict(want)


def test_exact_match_of_empty_field(spark):
    texts = spark.createDataFrame([(1, "description", "cat dog")], "item_id long, field string, text string")
    queries = spark.createDataFrame([(1, "cat")], "query_id long, query_text string")
    matched = lexical.match(lexical.build_index(texts), lexical.query_tokens(queries))
    rows = {r.field: r.exact_match for r in lexical.exact_match_scores(matched).collect()}
    assert rows["ocr"] == 2.0 * 2.5  # missing in both variants
    assert set(rows) == {"description", "ocr", "transcript"}
    assert {r.field for r in lexical.exact_match_scores(matched, skip_empty_fields=True).collect()} == {"description"}


def test_empty_index_has_no_results(spark):
    texts = spark.createDataFrame([], "item_id long, field string, text string")
    queries = spark.createDataFrame([(1, "cat")], "query_id long, query_text string")
    assert lexical.bm25_fields(lexical.match(lexical.build_index(texts), lexical.query_tokens(queries))).count() == 0


def results(spark, n=3000, seed=3):
    """Two lists, one of them with a third of all rows on one score."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2]), i, rng.choice([0.5, round(rng.uniform(-3, 90), 3)])) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, item_id long, score double")


def test_spread_rank_equals_window_rank(spark):
    df = results(spark)
    a = fusion.rank(df, list_bound=3000)
    b = fusion.spread_rank(df, id_span=16)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def crowded(spark, n=20_000):
    """Lists on very different scales: fused scores of ranks, large scores, one score a third of the time."""
    fused = F.round(1 / (60 + F.col("id")), 9)
    score = F.when(F.col("id") % 3 == 0, F.lit(0.25)).when(F.col("id") % 7 == 0, F.col("id") * 1e6).otherwise(fused)
    rows = spark.range(n).select(F.lit(1).alias("query_id"), F.col("id").alias("item_id"), score.cast("double").alias("score"))
    return rows.unionByName(spark.range(n // 4).select(F.lit(2).alias("query_id"), F.col("id").alias("item_id"), fused.cast("double").alias("score")))


def test_cells_have_equal_depth_on_any_scale(spark):
    df = crowded(spark)
    for cells in (16, 256):
        placed = fusion.with_cells(df, fusion.cell_borders(df, cells=cells), cells=cells)
        depth = placed.groupBy("query_id", "_cell").agg(F.count("*").alias("rows"), F.count_distinct("score").alias("scores"))
        lengths = {r.query_id: r.n for r in df.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
        for r in depth.collect():
            # one score cannot be cut by scores; ids cut it afterwards
            assert r.scores <= lengths[r.query_id] * (1 / cells + 2 / fusion._SKETCH) + 2, r
    a, b = fusion.rank(df, list_bound=20_000), fusion.spread_rank(df, id_span=64, cells=64)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_rank_limit_is_a_prefix(spark):
    df = results(spark)
    whole = fusion.rank(df, list_bound=3000).where("rank <= 7")
    assert whole.exceptAll(fusion.rank(df, limit=7)).count() == 0


def test_rank_of_unknown_length_plans_no_whole_list_window(spark):
    plan = fusion.rank(results(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "_span" in plan


def test_max_weighted_keeps_the_unweighted_score(spark):
    rows = [(1, 10, "a", 0.4), (1, 10, "b", 0.9), (1, 11, "b", 0.2), (1, 12, "a", 0.3), (1, 12, "b", 0.5)]
    df = spark.createDataFrame(rows, "query_id long, item_id long, list string, score double")
    got = {r.item_id: r.score for r in fusion.max_weighted(df, {"a": 0.7, "b": 0.3}, "list").collect()}
    assert got == {10: 0.4, 11: 0.2, 12: 0.3}
    with pytest.raises(ValueError):
        fusion.max_weighted(df, {"a": 0.7, "b": 0.7}, "list")


def test_max_weighted_with_negative_scores_and_missing_lists(spark):
    rows = [(1, 10, "a", -0.4), (1, 10, "b", -0.9), (1, 11, "b", -0.2)]
    df = spark.createDataFrame(rows, "query_id long, item_id long, list string, score double")
    got = {r.item_id: r.score for r in fusion.max_weighted(df, {"a": 0.5, "b": 0.5}, "list").collect()}
    assert got == {10: -0.4, 11: -0.2}


def test_single_list_passes_through(spark):
    df = results(spark).withColumn("retriever", F.lit("only"))
    assert fusion.reciprocal_rank(df, {"only": 1.0}).select("score").exceptAll(df.select("score")).count() == 0


def test_rank_fusion_ignores_rescaling(spark):
    a = results(spark, 200).withColumn("retriever", F.lit("a"))
    b = results(spark, 200, 5).withColumn("retriever", F.lit("b"))
    weights = {"a": 1.0, "b": 1.0}
    one = fusion.reciprocal_rank(a.unionByName(b), weights, list_bound=200)
    two = fusion.reciprocal_rank(a.withColumn("score", F.col("score") * 3 + 1).unionByName(b), weights, list_bound=200)
    assert one.exceptAll(two).count() == 0


def stored(spark, n=120, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, dims)).astype(np.float32)
    rows = [(i // 3, "V", i % 3, vecs[i].tolist()) for i in range(n)]
    return vecs, spark.createDataFrame(rows, "item_id long, kind string, frame int, vec array<float>")


@pytest.mark.parametrize("matrix_rows", [100, 4])
@pytest.mark.parametrize("k", [None, 5])
def test_similarity_paths_agree_with_numpy(spark, matrix_rows, k):
    vecs, store = stored(spark)
    queries = store.where("frame = 0").select(F.col("item_id").alias("query_id"), "kind", "vec")
    got = {(r.query_id, r.item_id): r.score for r in vectors.similarity(store, queries, k, matrix_rows=matrix_rows).collect()}
    full = vecs.astype(np.float64) @ vecs[::3].astype(np.float64).T
    best = np.round(full.reshape(40, 3, 40).max(axis=1), 9)
    want = {}
    for q in range(40):
        order = sorted(range(40), key=lambda i: (-best[i, q], i))[: k or 40]
        want |= {(q, i): best[i, q] for i in order}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_similarity_without_queries_or_vectors(spark):
    _, store = stored(spark)
    none = store.limit(0).select(F.col("item_id").alias("query_id"), "kind", "vec")
    assert vectors.similarity(store, none).count() == 0
    some = store.limit(1).select(F.col("item_id").alias("query_id"), "kind", "vec")
    assert vectors.similarity(store.limit(0), some).count() == 0


def test_pages_join_up_to_the_whole_list(spark):
    ordered = results(spark, 100).withColumn("order", F.col("item_id"))
    for bound in (100, None):
        whole = search.paged(ordered, 0, None, bound)
        pages = [search.paged(ordered, o, 40, bound) for o in (0, 40, 80)]
        union = pages[0].unionByName(pages[1]).unionByName(pages[2])
        assert whole.exceptAll(union).count() == 0 and union.count() == 100


def test_confidence_profiles():
    assert search.confidence_profile("en").clip == (0.24, 0.32)
    assert search.confidence_profile("pl", "cpu") == search.Confidence((0.94, 0.96), None)
    with pytest.raises(ValueError):
        search.confidence_profile("xx")


def test_every_mode_has_a_marker():
    assert set(search.MODE_LISTS) == {"hybrid", *S.SEARCH_MODES.values()}


def test_kinds_of_different_length(spark):
    import numpy as np

    from hayloft.operators import vectors

    rng = np.random.default_rng(0)
    sizes = {"D": 1024, "C": 512}
    stored = {(i, kind): rng.normal(size=n) for kind, n in sizes.items() for i in range(5)}
    asked = {(i, kind): rng.normal(size=n) for kind, n in sizes.items() for i in range(3)}
    table = spark.createDataFrame([(i, kind, vec.tolist()) for (i, kind), vec in stored.items()], "item_id long, kind string, vec array<double>")
    queries = spark.createDataFrame([(i, kind, vec.tolist()) for (i, kind), vec in asked.items()], "query_id long, kind string, vec array<double>")
    for rows in (100, 2):
        got = vectors.similarity(table, queries, matrix_rows=rows).collect()
        assert len(got) == 30
        assert all(abs(r["score"] - asked[r["query_id"], r["kind"]] @ stored[r["item_id"], r["kind"]]) < 1e-8 for r in got)


def test_inverted_sets_are_made_without_grouping_objects(spark):
    rows = [("description", "original", t, i, 1, 9) for t, ids in {"a": (5, 3, 3, 12, 250), "b": (7, None), "c": (None,)}.items() for i in ids]
    rows += [("ocr", "original", "a", i, 1, 9) for i in (5, -1)]
    postings = spark.createDataFrame(rows, "field string, variant string, token string, item_id long, tf long, dl long").repartition(3)
    for span in (10, 5_000):
        want = {}
        for field, _, token, item, *_ in rows:
            want.setdefault((field, token, None if item is None else item // span), set()).update([] if item is None else [item])
        sets = lexical.inverted_sets(postings, span)
        found = sets.collect()
        assert {(r.field, r.token, r.part): r["items"] for r in found} == {k: sorted(x) for k, x in want.items()} and len(found) == len(want)
        assert "Aggregate" not in sets._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


def test_a_page_of_lists_of_unknown_length_takes_one_pass(spark, monkeypatch):
    rows = [(q, i, s) for q, i, s in results(spark, 400).collect()] + [(1, None, 0.5), (1, 9_999, None), (1, 9_998, float("nan")), (None, 1, 1.0)]
    ordered = spark.createDataFrame(rows, "query_id long, item_id long, score double").repartition(3).withColumn("order", F.col("item_id"))
    whole = search.paged(ordered, 0, None, 1_000)
    for held in (1_000_000, 1):
        monkeypatch.setattr(search, "HELD_ROWS", held)
        for offset in (0, 30):
            page = search.paged(ordered, offset, 25, None)
            want = whole.where(f"query_id is not null and rank > {offset} and rank <= {offset + 25}")
            assert sorted(map(str, page.collect())) == sorted(map(str, want.collect()))
    assert exchanges(page) == 2  # the rows are dealt once above, their heads once by query


def test_sums_of_fields_are_dealt_once(spark):
    hits = [("ocr", "original", "a", 1, 0.5), ("ocr", "lemma", "a", 1, 0.5), ("caption", "original", "a", 2, 1.0), ("description", "original", "a", 1, 2.0)]
    weights = [(7, f, v, "a", 2.0) for f in S.TEXT_FIELDS for v in ("original", "lemma")]
    hits = spark.createDataFrame(hits, "field string, variant string, token string, item_id long, share double")
    weights = spark.createDataFrame(weights, "query_id long, field string, variant string, token string, weight double")
    scored = lexical.bm25_fields(lexical.Matched(None, hits, F.broadcast(weights), None, True))
    assert {(r.query_id, r.field, r.item_id, r.score) for r in scored.collect()} == {(7, "ocr", 1, 2.0), (7, "caption", 2, 2.0), (7, "description", 1, 4.0)}
    best = fusion.max_weighted(scored.where("field <> 'caption'"), S.FIELD_WEIGHTS, "field")
    assert [tuple(r) for r in best.collect()] == [(7, 1, 4.0)]
    assert best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_ranks_and_their_sums_are_dealt_once(spark):
    lists = results(spark, 300).withColumn("retriever", F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("clip")).repartition(2)
    fused = fusion.reciprocal_rank(lists, {"lexical": 1.0, "clip": 0.5}, list_bound=300)
    ranked = fusion.rank(lists, ("query_id", "retriever"), list_bound=300)
    part = F.when(F.col("retriever") == "lexical", 1.0).otherwise(0.5) / (60.0 + F.col("rank"))
    want = ranked.groupBy("query_id", "item_id").agg(F.round(F.sum(part), 9).alias("score"))
    assert {tuple(r) for r in fused.collect()} == {tuple(r) for r in want.collect()}
    assert fused._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
