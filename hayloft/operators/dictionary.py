"""Word dictionaries: edit-distance neighbours, prefixes, correction and splitting of unknown words.

A dictionary is ``(lang, word, freq)``. Neighbours are found by equi-joins of distinct words, verified by
``levenshtein``; no word meets every other word.

* A dictionary word is cut into d + 1 pieces of nearly equal length. Of a word within distance d one piece is left whole
  (there are more pieces than edits), at a place that the edits left and right of it can have moved by no more than
  their number. So a word asks, for each length a neighbour can have and each piece, for a few of its own substrings:
  a number that depends on d, not on the word. Rows and bytes are linear in the length of the words.
* Both are joined by hashes, which sort and travel faster than texts; ``levenshtein`` drops what is equal by chance.
* Pieces of dictionary words shorter than ``PIECE_LETTERS`` x (d + 1) letters would be common to too many words. These words are found by
  equal deletion variants: two words within distance d share a string that arises from each by deleting at most d letters.
  A short word has few of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from hayloft.session import broadcast_if_small

# Letters of a piece from which on words are found by pieces. Pairs that share a shorter one grow with the square of the
# vocabulary and soon outnumber the variants of its words.
PIECE_LETTERS = 5


def _left_after(word: str, distance: int) -> set[str]:
    made, last = {word}, {(word, 0)}
    for _ in range(distance):
        # letters go from left to right, so that no set of letters is deleted in two orders
        last = {(rest[:i] + rest[i + 1 :], i) for rest, at in last for i in range(at, len(rest))}
        made.update(rest for rest, _ in last)
    return made


def deletion_variants(word: Column, distance: int) -> Column:
    """The word and everything left after deleting up to ``distance`` letters."""

    @F.arrow_udf(ArrayType(StringType()))
    def variants(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else list(_left_after(w, distance)) for w in words.to_pylist()], pa.list_(pa.string()))

    return variants(word)


def _by_variants(words: DataFrame, dictionary: DataFrame, distance: int) -> DataFrame:
    """Pairs (lang, word, candidate, freq) that share a deletion variant, and others whose keys are equal by chance."""

    def keyed(df: DataFrame, *columns) -> DataFrame:
        # named first: an inner explode would ask for the variants once more, to leave out words without any
        made = df.withColumn("_vs", deletion_variants(F.col("word"), distance)).select(*columns, F.explode_outer("_vs").alias("_v"))
        return made.withColumn("_key", F.xxhash64("_v")).drop("_v")

    right = keyed(dictionary, "lang", F.col("word").alias("candidate"), "freq")
    return keyed(words, "lang", "word").join(right, ["_key", "lang"]).drop("_key")


def pieces(length: Column, distance: int) -> Column:
    """(i, start, size) of the ``distance + 1`` pieces of a word of that length; the last ones are a letter longer."""
    n = distance + 1
    base, short = F.floor(length / n).cast("int"), n - length % n
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                (base * i + F.greatest(F.lit(0), F.lit(i) - short)).cast("int").alias("start"),
                (base + F.when(F.lit(i) >= short, 1).otherwise(0)).cast("int").alias("size"),
            )
            for i in range(n)
        ]
    )


def _by_pieces(words: DataFrame, dictionary: DataFrame, distance: int) -> DataFrame:
    """Pairs (lang, word, candidate, freq) where a piece of the candidate stands whole in the word, near its place, and chance ones."""
    key = lambda n, piece: F.xxhash64(n, "p.i", piece).alias("_key")
    right = dictionary.select("lang", F.col("word").alias("candidate"), "freq")
    right = right.select("*", F.explode(pieces(F.length("candidate"), distance)).alias("p"))
    right = right.select("lang", "candidate", "freq", key(F.length("candidate"), F.expr("substring(candidate, p.start + 1, p.size)")))

    lengths = F.explode(F.sequence(F.greatest(F.length("word") - distance, F.lit(distance + 1)), F.length("word") + distance)).alias("_n")
    asked = words.select("lang", "word", lengths).select("lang", "word", "_n", F.explode(pieces(F.col("_n"), distance)).alias("p"))
    # i edits at most stand before piece i, so that distance - i may follow; or else a piece further on is whole, too
    shift, i, start = F.length("word") - F.col("_n"), F.col("p.i"), F.col("p.start")
    low = F.greatest(start - i, start + shift - (distance - i), F.lit(0))
    high = F.least(start + i, start + shift + (distance - i), F.length("word") - F.col("p.size"))
    at = F.explode(F.sequence(low, high)).alias("_at")
    left = asked.where(high >= low).select("lang", "word", "_n", "p", at)
    # words are dealt by themselves, so equal keys of a word meet without an exchange
    left = left.select("lang", "word", key(F.col("_n"), F.expr("substring(word, _at + 1, p.size)"))).distinct()
    return left.join(right, ["_key", "lang"]).drop("_key")


def _dealt(words: DataFrame) -> DataFrame:
    """Words dealt to all cores: a small table, often in one partition, of which each row becomes hundreds."""
    return words.repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "lang", "word")


def near_words(words: DataFrame, dictionary: DataFrame, distance: int, piece_letters: int = PIECE_LETTERS) -> DataFrame:
    """(lang, word, candidate, freq, distance): dictionary words within ``distance`` of each word.

    ``words(lang, word)`` are distinct. A pair that meets several times comes once.
    """
    short = max(piece_letters, 1) * (distance + 1)  # shorter dictionary words are found by variants
    words, dictionary = _dealt(words), _dealt(dictionary)
    variants = _by_variants(words.where(F.length("word") < short + distance), dictionary.where(F.length("word") < short), distance)
    whole = _by_pieces(words.where(F.length("word") >= short - distance), dictionary.where(F.length("word") >= short), distance)
    # verified where pairs meet: what is too far never reaches the shuffle, a pair that meets again leaves it once
    longer = F.abs(F.length("word") - F.length("candidate"))
    apart = F.when(longer <= distance, F.levenshtein("word", "candidate", distance)).otherwise(-1)
    return variants.unionByName(whole).withColumn("distance", apart).where("distance >= 0").distinct()


def prefix_table(dictionary: DataFrame) -> DataFrame:
    """Distinct (lang, prefix, next_char, is_word): every prefix with the letters that may follow."""
    at = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("n")
    return (
        dictionary.select("lang", "word", at)
        .select(
            "lang",
            F.expr("substring(word, 1, n)").alias("prefix"),
            F.expr("substring(word, n + 1, 1)").alias("next_char"),
        )
        .distinct()
        .withColumn("is_word", F.col("next_char") == "")
    )


def longest_prefix(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(lang, word, is_known, prefix_length): length of the longest start shared with a dictionary word."""
    prefixes = prefix_table(dictionary).groupBy("lang", "prefix").agg(F.max("is_word").alias("is_word"))
    # the empty start is every word's and needs no look-up, unless the word itself is empty
    starts = words.select("lang", "word", F.explode(F.sequence(F.least(F.lit(1), F.length("word")), F.length("word"))).alias("n"))
    found = starts.withColumn("prefix", F.expr("substring(word, 1, n)")).join(
        broadcast_if_small(prefixes), ["lang", "prefix"], "left"
    )
    return found.groupBy("lang", "word").agg(
        F.max(F.coalesce(F.col("is_word") & (F.col("n") == F.length("word")), F.lit(False))).alias("is_known"),
        F.max(F.when(F.col("is_word").isNotNull(), F.col("n")).otherwise(0)).alias("prefix_length"),
    )


def next_characters(dictionary: DataFrame) -> DataFrame:
    """(lang, prefix, next_chars): sorted letters that continue a prefix; at most one per letter of the alphabet."""
    return (
        prefix_table(dictionary)
        .where("next_char <> ''")
        .groupBy("lang", "prefix")
        .agg(F.array_join(F.sort_array(F.collect_set("next_char")), "").alias("next_chars"))
    )


def unknown_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    return words.join(dictionary.select("lang", "word"), ["lang", "word"], "left_anti")


def _best(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def corrections(words: DataFrame, dictionary: DataFrame, long_word: int = 4) -> DataFrame:
    """(lang, word, candidate, distance, score): best dictionary word for each unknown word.

    Distance 1 always, distance 2 from ``long_word`` letters on. The greatest score over both
    distances wins, then the smaller distance, then the word. The score is the log frequency. All
    candidates take part: with the best score winning there is nothing a cap could save but work.
    """
    unknown = unknown_words(words, dictionary)
    near = near_words(unknown, dictionary, 2).where("distance = 1 or (distance = 2 and length(word) >= %d)" % long_word)
    scored = near.withColumn("score", F.round(F.ln("freq"), 9))
    best = _best(scored, ["lang", "word"], [F.col("score").desc(), F.col("distance"), F.col("candidate")])
    return best.select("lang", "word", "candidate", "distance", "score")


def splits(words: DataFrame, dictionary: DataFrame, first_min: int = 2, second_min: int = 3) -> DataFrame:
    """(lang, word, first, second, score): an unknown word as two words, each known or at distance 1.

    A part that is a dictionary word stays; otherwise its best neighbour at distance 1 stands in.
    The score is the sum of both log frequencies.
    """
    unknown = unknown_words(words, dictionary)
    cut = F.explode(F.sequence(F.lit(first_min), F.length("word") - second_min)).alias("cut")
    parts = unknown.where(F.length("word") >= first_min + second_min).select("lang", "word", cut)
    parts = parts.select(
        "lang",
        "word",
        "cut",
        F.expr("substring(word, 1, cut)").alias("first"),
        F.expr("substring(word, cut + 1, length(word))").alias("second"),
    )
    vocabulary = parts.select("lang", F.explode(F.array("first", "second")).alias("word")).distinct()
    known = dictionary.select("lang", "word", F.col("word").alias("stand_in"), F.ln("freq").alias("s"))
    exact = vocabulary.join(known, ["lang", "word"])
    near = near_words(vocabulary.join(known, ["lang", "word"], "left_anti"), dictionary, 1)
    near = _best(
        near.withColumn("s", F.ln("freq")), ["lang", "word"], [F.round("s", 9).desc(), F.col("candidate")]
    ).select("lang", "word", F.col("candidate").alias("stand_in"), "s")
    usable = exact.unionByName(near)

    def part(name: str) -> DataFrame:
        return usable.select("lang", F.col("word").alias(name), F.col("stand_in").alias(f"{name}_word"), F.col("s").alias(f"{name}_s"))

    both = parts.join(part("first"), ["lang", "first"]).join(part("second"), ["lang", "second"])
    scored = both.withColumn("score", F.round(F.col("first_s") + F.col("second_s"), 9))
    best = _best(scored, ["lang", "word"], [F.col("score").desc(), F.col("cut")])
    return best.select("lang", "word", F.col("first_word").alias("first"), F.col("second_word").alias("second"), "score")


def repaired(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(lang, word, replacement): correction or split, whichever scores higher; else the word itself."""
    c = corrections(words, dictionary).select("lang", "word", "candidate", F.col("score").alias("c_score"))
    s = splits(words, dictionary).select("lang", "word", F.concat_ws(" ", "first", "second").alias("pair"), F.col("score").alias("s_score"))
    split_wins = F.col("s_score").isNotNull() & (F.col("c_score").isNull() | (F.col("s_score") > F.col("c_score")))
    return (
        words.join(c, ["lang", "word"], "left")
        .join(s, ["lang", "word"], "left")
        .select("lang", "word", F.when(split_wins, F.col("pair")).otherwise(F.coalesce("candidate", "word")).alias("replacement"))
    )
