"""Live tables: a stored base and layers of changes, merged when read.

A micro-batch writes one layer: the rows it changes in the catalog, the index and the vectors. As soon as
``FOLD`` layers of one level lie side by side they are folded into one of the next level, so a reader merges
at most ``FOLD - 1`` layers of each level, whatever the number of batches. ``compact`` folds all of them into a new
base. Texts are tokenized and embedded once, when they come; reading only merges rows.

A layer is announced in a log after its tables are written, and folding or compacting leaves the folded
ones in place: a batch that is run again sees the layers before it and overwrites its own. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.functions import text
from hayloft.operators import catalog, edits, enrich, lexical, vectors
from hayloft.sources.files import file_name
from hayloft.sources.tables import VersionedTable

Describe = Callable[[DataFrame], DataFrame]

FOLD = 8
_LOG = "first long, last long, level int"
_ORDER = {"files": ["name"], "postings": ["token"], "doc_stats": ["item_id"], "vectors": ["item_id", "kind"]}


class Layer(NamedTuple):
    """Changes of the micro-batches ``first`` to ``last``."""

    first: int
    last: int
    level: int

    @property
    def folder(self) -> str:
        return f"layer-{self.first}-{self.last}"


def cover(layers: list[Layer], after: int, before: int | None = None) -> list[Layer]:
    """The widest layers that hold every batch after ``after`` once, in order; only batches before ``before``."""
    chosen: list[Layer] = []
    for layer in sorted(layers, key=lambda x: (x.first, -x.last)):
        if layer.first > (chosen[-1].last if chosen else after) and (before is None or layer.last < before):
            chosen.append(layer)
    return chosen


def _last_vectors(changes: DataFrame) -> DataFrame:
    """All rows of the last change of each (item, kind)."""
    return changes.withColumn("_last", F.max("batch").over(Window.partitionBy("item_id", "kind"))).where("batch = _last").drop("_last")


def _summed(signed: DataFrame, keep_zero: bool) -> DataFrame:
    net = signed.groupBy(*[c for c in signed.columns if c != "sign"]).agg(F.sum("sign").cast("int").alias("sign"))
    return net if keep_zero else net.where("sign <> 0")


# What a table's changes become when layers are folded. A length whose changes cancel out stays with sign 0: it names a
# text that was touched, and its postings may have changed.
_FOLDED = {
    "files": lambda changes: catalog.latest_per_key(changes, ["name"], "batch"),
    "postings": lambda changes: _summed(changes, keep_zero=False),
    "doc_stats": lambda changes: _summed(changes, keep_zero=True),
    "vectors": _last_vectors,
}


class LiveTables:
    """Catalog, index and vectors kept current by a change feed.

    ``pixels`` turns catalog rows into store rows of their pictures and films; without it only text kinds are kept.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        base_files: DataFrame,
        embedder=enrich.HashingEmbedder,
        lemmatize=text.plain_stem,
        pixels: Callable[[DataFrame], DataFrame] | None = None,
        fold: int = FOLD,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.lemmatize, self.pixels, self.fold = embedder, lemmatize, pixels, fold
        self._first_files = base_files
        self.columns = base_files.columns

    # --- what is stored -------------------------------------------------------------------------------

    def base_until(self) -> int:
        """Last batch that the base holds, -1 before the first compaction."""
        try:
            found = self.spark.read.schema("last long").parquet(f"{self.root}/bases").agg(F.max("last")).first()[0]
        except AnalysisException:  # never compacted
            return -1
        return -1 if found is None else found

    def layers(self) -> list[Layer]:
        """Announced layers since the base, folded ones included."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.root}/log-{self.base_until()}")
            return [Layer(*row) for row in log.distinct().collect()]  # one row per batch since the base
        except AnalysisException:  # no batch yet
            return []

    def _base(self, table: str) -> DataFrame:
        """A table of the base; those of the first base are made and stored when first asked for."""
        until = self.base_until()
        stored = VersionedTable(self.spark, f"{self.root}/base-{until}", table)
        if stored.current_version() is None:
            if table == "files":
                stored.write(self._first_files)
            elif table == "vectors":
                stored.write(self._vectors_of(self._base("files")))
            else:
                index = lexical.build_index(lexical.indexable_texts(self._base("files")), self.lemmatize)
                stored.write(getattr(index, table))
        return stored.read()

    def _vectors_of(self, files: DataFrame) -> DataFrame:
        made = enrich.embed_texts(vectors.wanted_embeddings(files).where(F.col("text").isNotNull()), self.embedder)
        return made if self.pixels is None else made.unionByName(self.pixels(files).select(*made.columns))

    def _changes(self, table: str, layers: list[Layer]) -> DataFrame | None:
        """Rows of the given layers; none without layers."""
        if not layers:
            return None
        extra = {"files": "gone boolean, batch long", "vectors": "batch long"}.get(table, "sign integer")
        schema = self._base(table).schema
        for column in extra.split(", "):
            schema = schema.add(*column.split())
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{layer.folder}/{table}" for layer in layers])

    def _write(self, df: DataFrame, table: str, layer: Layer) -> None:
        df.sortWithinPartitions(*_ORDER[table]).write.mode("overwrite").parquet(f"{self.root}/{layer.folder}/{table}")

    def _once(self, df: DataFrame, table: str, layer: Layer) -> DataFrame:
        """``df`` stored beside the layer's tables: a micro-batch and its state are walked once, however often they are asked."""
        path = f"{self.root}/{layer.folder}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _announce(self, layer: Layer) -> None:
        self.spark.createDataFrame([tuple(layer)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log-{self.base_until()}")

    def _fold(self) -> None:
        """Fold the last layers of a level while there are enough of them."""
        while True:
            chosen = cover(self.layers(), self.base_until())
            level = chosen[-1].level if chosen else 0
            last = [layer for layer in chosen if layer.level == level]
            if len(last) < self.fold:
                return
            folded = Layer(last[0].first, last[-1].last, level + 1)
            for table, fold in _FOLDED.items():
                self._write(fold(self._changes(table, last)), table, folded)
            self._announce(folded)

    # --- current tables -------------------------------------------------------------------------------

    def files(self, before: int | None = None) -> DataFrame:
        """Current catalog: the last change of a name wins over the base."""
        base, changes = self._base("files"), self._changes("files", cover(self.layers(), self.base_until(), before))
        if changes is None:
            return base
        last = catalog.latest_per_key(changes, ["name"], "batch")
        untouched = base.join(changes.select("name").distinct(), "name", "left_anti")
        return untouched.select(*self.columns).unionByName(last.where("not gone").select(*self.columns))

    def index(self) -> lexical.LexicalIndex:
        """Current index: base postings plus signed changes."""
        base = lexical.LexicalIndex(self._base("postings"), self._base("doc_stats"))
        chosen = cover(self.layers(), self.base_until())
        if not chosen:
            return base
        return lexical.apply_delta(base, lexical.LexicalIndex(self._changes("postings", chosen), self._changes("doc_stats", chosen)))

    def vectors(self) -> DataFrame:
        """Current vectors: the last change of an (item, kind) wins over the base."""
        base, changes = self._base("vectors"), self._changes("vectors", cover(self.layers(), self.base_until()))
        if changes is None:
            return base
        kept = base.join(changes.select("item_id", "kind").distinct(), ["item_id", "kind"], "left_anti")
        return kept.select(*base.columns).unionByName(_last_vectors(changes).where("vec is not null").select(*base.columns))

    def text_vectors(self) -> DataFrame:
        return self.vectors().where(F.col("kind").isin(*S.KIND_TEXT_FIELD))

    # --- changes --------------------------------------------------------------------------------------

    def apply(self, batch: DataFrame, batch_id: int, describe: Describe) -> None:
        """One micro-batch of ``(path, op, seq, ready_at)``.

        ``describe(names)`` returns catalog rows (with ids) of the created files: scan, types and model
        texts. Later events of a path replace earlier ones, so a delete that overtook a create of the
        same file inside the batch ends as a delete. A batch that the base already holds changes nothing.
        """
        if batch_id <= self.base_until():
            return
        layer = Layer(batch_id, batch_id, 0)
        named = batch.withColumn("name", file_name(F.col("path")))
        last = self._once(catalog.latest_per_key(named, ["name"], "seq").select("name", "op"), "operations", layer)
        before = self.files(before=batch_id)
        old = self._once(before.join(last, "name", "left_semi"), "replaced", layer)
        new = describe(last.where("op = 'created'").select("name"))
        gone = old.join(last.where("op = 'deleted'").select("name"), "name", "left_semi")
        # a created name that cannot be described (vanished, no media) leaves the catalog as well
        gone = gone.unionByName(old.join(last.where("op = 'created'"), "name", "left_semi").join(new.select("name"), "name", "left_anti"))
        rows = new.select(*self.columns).withColumn("gone", F.lit(False)).unionByName(gone.select(*self.columns).withColumn("gone", F.lit(True)))
        self._write(rows.withColumn("batch", F.lit(batch_id).cast("long")), "files", layer)

        current = self._changes("files", [layer]).where("not gone").select(*self.columns)
        effects = edits.text_effects(old, current)
        delta = edits.index_delta(effects, self.lemmatize)
        self._write(delta.postings, "postings", layer)
        self._write(delta.doc_stats, "doc_stats", layer)

        changed = edits.vector_changes(old, current)
        made = enrich.embed_texts(changed.where("effect <> 'delete'").select("item_id", "kind", "text"), self.embedder)
        left = changed.where("effect <> 'add'").select("item_id", "kind")
        if self.pixels is not None:
            made = made.unionByName(self.pixels(current).select(*made.columns))
            left = left.unionByName(vectors.wanted_embeddings(old).where("text is null").select("item_id", "kind"))
        removed = left.join(made, ["item_id", "kind"], "left_anti").select(
            "item_id",
            "kind",
            F.lit(0).alias("frame"),
            F.lit(None).cast("array<float>").alias("vec"),
            F.lit(None).cast("string").alias("text_sha"),
        )
        self._write(made.unionByName(removed).withColumn("batch", F.lit(batch_id).cast("long")), "vectors", layer)
        self._announce(layer)
        self._fold()

    def compact(self) -> None:
        """Fold every layer into a new base of all tables; later batches start a new log beside it."""
        chosen = cover(self.layers(), self.base_until())
        if not chosen:
            return
        until, index = chosen[-1].last, self.index()
        current = {"files": self.files(), "postings": index.postings, "doc_stats": index.doc_stats, "vectors": self.vectors()}
        for table, rows in current.items():
            VersionedTable(self.spark, f"{self.root}/base-{until}", table).write(rows)
        self.spark.range(until, until + 1).toDF("last").coalesce(1).write.mode("append").parquet(f"{self.root}/bases")
