"""Model columns: batch inference by any callable, and enrichment jobs over a catalog work list."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.functions.text import TOKEN_PATTERN
from hayloft.operators import edits

Embedder = Callable[[Sequence[str]], Sequence[np.ndarray | None]]


class HashingEmbedder:
    """Offline stand-in for a text model: signed token counts in hashed buckets, unit length.

    Bucket and sign come from the token's MD5 (first eight hex digits modulo the size; ninth digit
    below 8 is +1). A text without tokens, or whose counts cancel out, has no vector.
    """

    def __init__(self, size: int = 64):
        self.size = size
        self._find = regex.compile(TOKEN_PATTERN).findall
        self._slot = lru_cache(maxsize=200_000)(self._hash)

    def _hash(self, token: str) -> tuple[int, float]:
        digest = hashlib.md5(token.encode()).hexdigest()
        return int(digest[:8], 16) % self.size, 1.0 if int(digest[8], 16) < 8 else -1.0

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for text in texts:
            counts = np.zeros(self.size)
            for token in self._find((text or "").lower()):
                bucket, sign = self._slot(token)
                counts[bucket] += sign
            norm = np.sqrt(np.dot(counts, counts))
            out.append((counts / norm).astype(np.float32) if norm else None)
        return out


def embed_column(
    text: Column,
    model_factory: Callable[[], Embedder] = HashingEmbedder,
    mode: str = "passage",
    affixes: dict[str, str] | None = None,
) -> Column:
    """Vector column of a text column; the model is built once per Python worker.

    ``affixes`` maps the modes ``query`` and ``passage`` to a prefix of the text.
    """
    prefix = (affixes or {}).get(mode, "")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for texts in batches:
            present = texts.notna().to_numpy()
            vectors: list = [None] * len(texts)
            made = model([prefix + t for t in texts[present]])
            for place, vector in zip(np.flatnonzero(present), made):
                vectors[place] = vector
            yield pd.Series(vectors, dtype=object)

    return embed(text)


def embed_texts(texts: DataFrame, model_factory: Callable[[], Embedder] = HashingEmbedder, affixes=None) -> DataFrame:
    """``(item_id, kind, text)`` -> vector store rows."""
    return texts.where("text is not null").select(
        "item_id",
        "kind",
        F.lit(0).alias("frame"),
        embed_column(F.col("text"), model_factory, "passage", affixes).alias("vec"),
        F.sha2("text", 256).alias("text_sha"),
    ).where("vec is not null")


def embed_queries(queries: DataFrame, text_col: str = "query_text", model_factory=HashingEmbedder, affixes=None) -> DataFrame:
    return queries.select("query_id", embed_column(F.col(text_col), model_factory, "query", affixes).alias("vec"))


MODEL_BATCH = 32


def _answers(model, values: Sequence, size: int) -> Iterator[tuple[str | None, str | None]]:
    """(text, error) of each value. A batch that fails, or whose answers do not fit, is asked again one by one."""
    many = getattr(model, "many", None)
    for lo in range(0, len(values), size):
        part = values[lo : lo + size]
        if many is not None:
            try:
                texts = list(many(part))
            except Exception:  # noqa: BLE001 - the single calls below name the row
                texts = []
            if len(texts) == len(part):
                yield from ((text, None) for text in texts)
                continue
        for value in part:
            try:
                yield model(value), None
            except Exception as failure:  # noqa: BLE001 - any model error belongs to its row
                yield None, f"{type(failure).__name__}: {failure}"


def run_model(
    work: DataFrame, content: str, model_factory: Callable[[], Callable[[object], str | None]], batch_size: int = MODEL_BATCH
) -> DataFrame:
    """(id, text, error) for each row of a work list; a failure is a row, not a failed job.

    A model with a method ``many`` gets up to ``batch_size`` values at once and returns a text or null for each;
    any other is called per row.
    """

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            found = list(_answers(model, batch["content"].tolist(), batch_size))
            texts, errors = [t for t, _ in found], [e for _, e in found]
            yield pd.DataFrame({"id": batch["id"], "text": pd.Series(texts, dtype=object), "error": pd.Series(errors, dtype=object)})

    return work.select("id", F.col(content).alias("content")).mapInPandas(infer, "id long, text string, error string")


# work list -> (text column, analysed flag) that its results go to
TARGETS = {
    "ocr": ("ocr_text", "is_ocr_analyzed"),
    "transcript": ("transcript", "is_transcript_analyzed"),
    "caption": ("llm_description", "is_llm_description_analyzed"),
}


def enrich(files: DataFrame, work: DataFrame, contents: DataFrame, target: str, model_factory) -> DataFrame:
    """Catalog after running a model over the pending files; ``contents(name, content)``."""
    text_column, flag = TARGETS[target]
    pending = work.select("id", "name").join(contents.select("name", "content"), "name", "left")
    produced = run_model(pending, "content", model_factory)
    if target == "ocr":
        produced = produced.withColumn("is_screenshot", F.coalesce(F.col("text") != "", F.lit(False)))
    return edits.merge_enrichment(files, produced, text_column, flag)
