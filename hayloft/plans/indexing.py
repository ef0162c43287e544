"""Initial load of a directory: scan, reconcile, enrich, index, embed, store."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.operators import catalog, enrich, lexical, vectors
from hayloft.plans.search import Corpus
from hayloft.sources import files as file_source
from hayloft.sources import tables

_WORK = {"ocr": catalog.pending_ocr, "transcript": catalog.pending_transcripts, "caption": catalog.pending_captions}


def reconciled_catalog(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """Catalog brought up to date with a classified scan."""
    next_id = (stored.agg(F.max("id")).first()[0] or 0) + 1
    return catalog.apply_scan(stored, scan, next_id)


def enriched(files: DataFrame, contents: DataFrame, models: Mapping[str, Callable]) -> DataFrame:
    """Run each supplied model over the files that still need it."""
    for target, factory in models.items():
        files = enrich.enrich(files, _WORK[target](files), contents, target, factory)
    return files


def refreshed_vectors(files: DataFrame, store: DataFrame, model_factory=enrich.HashingEmbedder) -> DataFrame:
    """Vector store after the embedding work list: only missing and stale texts are embedded.

    Pixel vectors are produced elsewhere; here they are kept or dropped.
    """
    work = vectors.work_list(files, store)
    todo = work.where("action in ('create', 'stale')").select("item_id", "kind")
    texts = vectors.wanted_embeddings(files).where("text is not null").join(todo, ["item_id", "kind"], "left_semi")
    kept = store.join(work.where("action = 'keep'").select("item_id", "kind"), ["item_id", "kind"], "left_semi")
    return kept.unionByName(enrich.embed_texts(texts, model_factory).select(*store.columns))


def initialize(
    spark: SparkSession,
    directory: str,
    root: str,
    stored: DataFrame,
    store: DataFrame,
    models: Mapping[str, Callable] | None = None,
    embedder=enrich.HashingEmbedder,
) -> Corpus:
    """Bring the tables under ``root`` in line with a directory and return them as a searchable corpus.

    Each stage is written before the next reads it, so a lost executor costs a stage at most and no
    model runs twice.
    """
    scan = file_source.media_files(file_source.scan_directory(spark, directory, content=True))
    tables.write_catalog(reconciled_catalog(stored, scan.drop("content")), root)
    if models:
        contents = scan.select("name", "content")
        tables.write_catalog(enriched(tables.read_catalog(spark, root), contents, models), root)
    files = tables.read_catalog(spark, root)
    tables.write_index(lexical.build_index(lexical.indexable_texts(files)), root)
    tables.write_vectors(refreshed_vectors(files, store, embedder), root)
    return Corpus(files, tables.read_index(spark, root), tables.read_vectors(spark, root))
