"""Time the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Index and vectors are built once and stored, as they would be; searches read the stored tables.
Each job is run $BENCH_RUNS times (default 3) after one warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from hayloft.functions import text
from hayloft.operators import catalog, dictionary, enrich, lexical, vectors
from hayloft.plans import pages, search, similar
from hayloft.session import local_session, work_dir
from hayloft.sources import tables
from hayloft.streaming import feed
from workload import edit_cases, feed_cases, media_cases
from workload import views as v


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = local_session(cpus, 2 * cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    root = work_dir(spark, "bench")

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def build_index():
        tables.write_index(lexical.build_index(lexical.indexable_texts(v.files(spark, sf))), root)

    def build_vectors():
        tables.write_vectors(v.store(spark, sf), root)
        tables.write_item_vectors(tables.read_vectors(spark, root), root)

    timings: dict[str, list[float]] = {}

    def measure(name: str, job, times: int = runs, warm: bool = True) -> None:
        if only and name not in only and not name.startswith("build"):
            return
        if warm:
            job()
        for _ in range(times):
            start = time.perf_counter()
            job()
            timings.setdefault(name, []).append(time.perf_counter() - start)

    tables.write_catalog(v.files(spark, sf), root)
    measure("build_index", build_index, 1)
    measure("build_vectors", build_vectors, 1)

    files = tables.read_catalog(spark, root)
    corpus = search.Corpus(files, tables.read_index(spark, root), tables.read_vectors(spark, root), tables.read_item_vectors(spark, root))
    bound = files.count()
    base = v.base_queries(spark, sf)
    text_vectors, clip_vectors = v.query_vectors(spark, sf, base), v.clip_query_vectors(spark, sf)
    profile = search.confidence_profile("en")
    raw = base.select("query_id", F.col("query_text").alias("raw"))

    def lexical_batch():
        drain(lexical.bm25_fields(lexical.match(corpus.index, lexical.query_tokens(base))))

    def vector_batch():
        drain(vectors.search_kinds(corpus.vectors, text_vectors, ["D", "O", "T"]))

    def vector_top_k():
        drain(vectors.search_kinds(corpus.vectors, text_vectors, ["D", "O", "T"], k=100))

    def hybrid_page():
        drain(search.search(corpus, raw, text_vectors, clip_vectors, profile, limit=10, list_bound=bound))

    def hybrid_lists():
        parsed = base.select("query_id", "query_text", F.lit("hybrid").alias("metric"))
        drain(search.score_queries(corpus, parsed, text_vectors, clip_vectors, profile, list_bound=bound))

    def one_query():
        one = raw.where("query_id = 0")
        drain(pages.search_page(corpus, one, text_vectors.where("query_id = 0"), clip_vectors.where("query_id = 0"), profile, limit=10))

    asked_words = base.select(F.lit("en").alias("lang"), F.explode(text.tokens(F.col("query_text"))).alias("word")).distinct()
    seeds = files.select(F.col("id").alias("seed_id"))
    jobs = {
        "lexical_batch": lexical_batch,
        "vector_batch": vector_batch,
        "vector_top_k": vector_top_k,
        "hybrid_page": hybrid_page,
        "hybrid_lists": hybrid_lists,
        "one_hybrid_query": one_query,
        "similar_descriptions": lambda: drain(similar.similar_text(files, corpus.vectors, seeds, "D", k=100)),
        "neighbours": lambda: drain(similar.neighbours(corpus.vectors, "D", 10)),
        "reconcile": lambda: drain(catalog.reconcile(files.where("lang <> 'de'"), files.where("lang <> 'fr'"))),
        "file_positions": lambda: drain(catalog.default_positions(files)),
        "apply_edits": lambda: drain(edit_cases._edited(spark, sf)),
        "ready_table": lambda: drain(feed.ready_table(feed_cases._normalized(spark, sf))),
        "collapsed_frames": lambda: drain(media_cases.collapsed_frames(spark, sf)),
        "corrections": lambda: drain(dictionary.corrections(asked_words, v.dictionary(spark, sf))),
        "embed_texts": lambda: drain(enrich.embed_texts(vectors.wanted_embeddings(files))),
    }
    for name, job in jobs.items():
        measure(name, job)

    medians = {name: round(statistics.median(ts), 3) for name, ts in timings.items()}
    print(json.dumps({"metric": "total of median job times", "value": round(sum(medians.values()), 3), "unit": "sec", "queries": medians, "sf": sf}))


if __name__ == "__main__":
    main()
