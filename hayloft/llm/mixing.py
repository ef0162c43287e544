"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a checksum of their id and laid end to end; that stream, repeated
up to ``repeats`` times, is cut into blocks of ``block`` words. Sources take slots of the mix in the order
of the golden-ratio sequence: with ``F`` the first Fibonacci number that is no smaller than the number of
slots and ``G`` the one before it, slot ``i`` has the point ``i * G mod F``, and a point belongs to the
source in whose share of the cumulative quotas it falls. Points are distinct, so each source gets exactly
its quota, and any stretch of slots holds the sources in nearly their shares. The slots of a source are
ranked, and the slot of rank ``r`` is joined with block ``r``.

Ranks and stream positions are sums over cells first and over rows inside a cell then, so a source with a
third of all rows is spread over thousands of tasks. Texts are read once, only sizes are shuffled.

Targets: all words are shared by weight; a source stops at ``repeats`` times its size, and what it cannot
take is shared again among the others by weight, until none is above.

Defined cases: null texts have no words and are never taken; the null source is a source like others; a
missing or non-positive weight gives target 0; repeated rows are documents of their own; an empty table
gives an empty mix; equal checksums are ordered by id and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayloft.llm.common import stored, words

BLOCK = 256
REPEATS = 3
CELLS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words of each document."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(totals: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``target`` for ``totals(source, source_size, weight)``, a row for each source."""
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    limit = repeats * F.col("source_size")
    by_limit = Window.orderBy(F.when(F.col("weight") > 0, limit / F.col("weight")).asc_nulls_last(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    # sources fill up in the order of limit / weight; the level is the share of a unit of weight
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight"
    ).over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levelled = totals.withColumn("weight", weight).withColumn("level", F.when(F.col("weight") > 0, level))
    share = F.coalesce(F.col("weight") * F.max("level").over(everything), F.lit(0.0))
    return levelled.withColumn("target", F.least(limit.cast("double"), share)).drop("level")


def laid_out(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``, the words before a document in its source's shuffled stream."""
    checksum = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sizes.withColumn("key", checksum).withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    cells = keyed.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    return joined.select("doc_id", "source", "size", (F.col("base") + F.col("within")).alias("start"))


def fibonacci(least: int) -> tuple[int, int]:
    """The first Fibonacci number from ``least`` on and the one before it."""
    before, now = 1, 1
    while now < least:
        before, now = now, before + now
    return before, now


def schedule(quotas: DataFrame) -> DataFrame:
    """``(slot, number, rank)``: the source number of each slot and the slot's rank in that source.

    ``quotas(number, slots)`` has a row for each source.
    """
    spread = quotas.withColumn("low", F.sum("slots").over(Window.orderBy("number")) - F.col("slots")).where("slots > 0")
    total = quotas.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    before, modulus = fibonacci(total)
    stride = 65_536
    strips = spread.select("number", (F.col("low") + F.col("slots")).alias("end"), F.explode(F.sequence("low", F.col("low") + F.col("slots") - 1, F.lit(stride))).alias("first"))
    strips = strips.repartition("number", "first")
    points = strips.select("number", F.explode(F.sequence("first", F.least(F.col("first") + stride, "end") - 1)).alias("point"))
    # before * before = 1 or -1 mod modulus, so the point's slot is again a product
    inverse = before if before * before % modulus == 1 % modulus else modulus - before
    wide = lambda c: c.cast("decimal(19,0)")
    slot = (wide(F.col("point")) * wide(F.lit(inverse)) % wide(F.lit(modulus))).cast("long")
    slots = points.select("number", slot.alias("slot")).withColumn("cell", F.floor(F.col("slot") / F.lit(-(-modulus // CELLS))))
    counts = slots.groupBy("number", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("number", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("number", "cell").orderBy("slot"))
    ranked = slots.withColumn("within", inside).join(counts, ["number", "cell"])
    return ranked.select("slot", "number", (F.col("base") + F.col("within") - 1).alias("rank"))


def cycled(totals: DataFrame, *cycle: int) -> DataFrame:
    """Weights from a repeating list, dealt to the sources in the order of their names, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


class Mix:
    """The mix of ``docs(doc_id, text, source)``.

    ``weigh`` adds ``weight`` to the table of sources. ``sources`` has each source's size, weight,
    target and quota; ``documents`` each document's place; ``blocks`` the mix itself: for every slot
    the stretches of documents that fill it.
    """

    def __init__(self, docs: DataFrame, weigh, block: int = BLOCK, repeats: int = REPEATS):
        sizes = stored(sized(docs), "sizes")
        totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        quota = F.least(repeats * F.col("source_size"), F.floor(F.col("target") + 0.5))
        self.sources = stored(
            targets(weigh(totals), repeats).withColumn("number", number).withColumn("quota", quota).withColumn("slots", F.ceil(F.col("quota") / block)), "sources"
        )
        by_name = self.sources.select(F.col("source").alias("s"), "number", "source_size", "target", "quota")
        self.documents = stored(
            laid_out(sizes).join(by_name, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "documents"
        )
        self.blocks = self._blocks(block, repeats)

    def _blocks(self, block: int, repeats: int) -> DataFrame:
        placed = self.documents.where("size > 0 and start < quota")
        last = F.least(F.lit(repeats - 1), F.floor((F.col("quota") - 1 - F.col("start")) / F.col("source_size")))
        epochs = placed.select("doc_id", "number", "size", "start", "quota", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("epoch"))
        begin, end = F.col("begin"), F.col("end")
        epochs = epochs.withColumn("begin", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("end", F.least(begin + F.col("size"), "quota"))
        pieces = epochs.withColumn("rank", F.explode(F.sequence(F.floor(begin / block), F.floor((end - 1) / block))))
        first = F.greatest(begin, F.col("rank") * block)
        pieces = pieces.select(
            "number", "rank", "doc_id", "start", "epoch", (first - begin).alias("first_word"), (F.least(end, (F.col("rank") + 1) * block) - first).alias("n_words")
        )
        return schedule(self.sources.select("number", "slots")).join(pieces, ["number", "rank"])

    def taken(self) -> DataFrame:
        """``documents`` with ``taken``, the words of each that the mix takes, repeats counted, and the first and last slot that hold some."""
        # a stretch of words has one start in its source; documents without words have none
        sums = self.blocks.groupBy("number", "start").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
        at = [F.col("d.number") == F.col("t.number"), F.col("d.start") == F.col("t.start"), F.col("d.size") > 0]
        joined = self.documents.alias("d").join(sums.alias("t"), at, "left")
        return joined.select("d.*", F.coalesce("t.taken", F.lit(0)).alias("taken"), "t.first_slot", "t.last_slot")


def repeated(docs: DataFrame, mix: Mix) -> DataFrame:
    """Rows of ``docs`` as often as the mix begins to read them; those it does not take go."""
    copies = F.ceil(F.col("words") / (F.col("__size") * F.col("rows")))
    taken = mix.taken().groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    taken = taken.agg(F.sum("taken").alias("words"), F.count("*").alias("rows")).where("words > 0")
    taken = taken.select("__id", "__source", F.col("__size"), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("__copy"))
    same: Column = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.size(words(F.col("text"))) == F.col("__size"))
    return docs.join(taken, same).select(*(docs[c] for c in docs.columns))
