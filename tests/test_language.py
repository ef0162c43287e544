import random

from pyspark.sql import functions as F

from hayloft.operators import dictionary, quality


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def words(seed, n=60):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(n)})


def test_near_words_finds_all_pairs(spark):
    a, b = words(1), words(2)
    left = spark.createDataFrame([("x", w) for w in a], "lang string, word string")
    right = spark.createDataFrame([("x", w, 1.0) for w in b], "lang string, word string, freq double")
    for d in (1, 2):
        got = {(r.word, r.candidate): r.distance for r in dictionary.near_words(left, right, d).collect()}
        assert got == {(x, y): distance(x, y) for x in a for y in b if distance(x, y) <= d}


def test_near_words_by_pieces(spark):
    """Long words over few letters, so that pieces repeat in place and out of place; every length of piece."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(3, 22))) for _ in range(40)]

    def edited(w):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
        return w

    a, b = sorted({edited(w) for w in base * 4}), sorted({edited(w) for w in base} | {"", "a", "ab"})
    left = spark.createDataFrame([("x", w) for w in a] + [("y", b[5])], "lang string, word string")
    right = spark.createDataFrame([("x", w, 1.0) for w in b], "lang string, word string, freq double")
    for d, letters in ((1, 1), (2, 1), (2, 2), (3, 1), (2, 100)):
        rows = dictionary.near_words(left, right, d, letters).collect()
        assert len(rows) == len({(r.word, r.candidate) for r in rows})
        assert {(r.word, r.candidate): r.distance for r in rows} == {(x, y): distance(x, y) for x in a for y in b if distance(x, y) <= d}


def test_a_long_word_asks_for_a_number_of_pieces_that_does_not_grow(spark):
    words = spark.createDataFrame([("x", "ab" * n) for n in (10, 100, 1000)], "lang string, word string")
    known = spark.createDataFrame([("x", "ab" * n + "c", 1.0) for n in (10, 100, 1000)], "lang string, word string, freq double")
    pairs = dictionary.near_words(words, known, 2)
    assert sorted((len(r.word), r.distance) for r in pairs.collect()) == [(20, 1), (200, 1), (2000, 1)]
    cells = words.selectExpr("length(word) as n").select("n", dictionary.pieces(F.col("n"), 2).alias("p")).collect()
    assert all(len(r.p) == 3 and sum(x.size for x in r.p) == r.n and [x.start for x in r.p] == [0, r.p[0].size, r.p[0].size + r.p[1].size] for r in cells)


def test_prefixes(spark):
    known = spark.createDataFrame([("x", w, 1.0) for w in ("car", "cat", "dog")], "lang string, word string, freq double")
    asked = spark.createDataFrame([("x", w) for w in ("cat", "ca", "cow", "zoo")], "lang string, word string")
    got = {r.word: (r.is_known, r.prefix_length) for r in dictionary.longest_prefix(asked, known).collect()}
    assert got == {"cat": (True, 3), "ca": (False, 2), "cow": (False, 1), "zoo": (False, 0)}
    nexts = {r.prefix: r.next_chars for r in dictionary.next_characters(known).collect()}
    assert nexts[""] == "cd" and nexts["ca"] == "rt" and "cat" not in nexts


def test_word_edits_small_and_large_vocabulary(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(i, " ".join(rng.choices("a b c d été".split(), k=rng.randint(0, 12))), " ".join(rng.choices("a b c x".split(), k=rng.randint(0, 12)))) for i in range(80)]
    want = {i: distance(r.split(), h.split()) for i, r, h in pairs}
    df = spark.createDataFrame(pairs, "id long, ref string, hyp string")
    assert {r.id: r.edits for r in quality.word_errors(df).collect()} == want
    monkeypatch.setattr(quality, "_LETTERS", "ab")  # most pairs now exceed the letters
    assert {r.id: r.edits for r in quality.word_errors(df).collect()} == want


def test_rates_add_up_over_chunks(spark):
    df = spark.createDataFrame([(1, "a b c", "a x c"), (2, "d", "d e")], "id long, ref string, hyp string")
    rate = quality.error_rate(quality.word_errors(df)).first()
    assert (rate.edits, rate.n_ref, rate.rate) == (2, 4, 0.5)
    assert quality.error_rate(quality.character_errors(df)).first().rate == 3 / 6


def test_words_of_the_documents_are_counted_once(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from workload import language_cases

    texts = ["house horse mouse " * 5, "hause house", None, "horze"]
    pq.write_table(pa.table({"doc_id": pa.array(range(4)), "text": texts, "lang": ["en", "en", "en", None]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0]), "text": ["mause"]}), tmp_path / "benchmark.parquet")
    words, known = language_cases._words_and_dictionary(spark, str(tmp_path))
    assert "documents.parquet" not in words.unionByName(known.select("lang", "word"))._jdf.queryExecution().toString()
    found = {(r.word, r.candidate) for r in language_cases.near_words(spark, str(tmp_path)).collect()}
    assert found == {("hause", "house"), ("hause", "mouse"), ("mause", "mouse"), ("mause", "house"), ("hause", "horse")}


def test_pairs_that_are_too_far_apart_are_not_shuffled(spark):
    from hayloft.operators import dictionary

    words = spark.createDataFrame([("en", "hause")], "lang string, word string")
    known = spark.createDataFrame([("en", "house", 0.5)], "lang string, word string, freq double")
    near = dictionary.near_words(words, known, 2)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan.lower() and plan.lower().index("aggregate") < plan.lower().index("levenshtein")
    assert [r.distance for r in near.collect()] == [1]


def test_words_of_middle_length_meet_by_variants(spark):
    """Words of one stem share pieces of three letters with all others, but few of them lie near one another."""
    rng = random.Random(11)
    known = sorted({"pre" + "".join(rng.choice("abcdefghij") for _ in range(4)) + "ion" for _ in range(120)})
    asked = [("x", w[:4] + "z" + w[5:]) for w in known[:60]] + [(None, known[0]), ("x", None), ("x", "pre😀ion")]
    words = spark.createDataFrame(asked, "lang string, word string")
    table = spark.createDataFrame([("x", w, 1.0) for w in known] + [("x", "pré😀ion", 1.0)], "lang string, word string, freq double")
    met = dictionary._by_pieces(words, table.where("length(word) >= %d" % (3 * dictionary.PIECE_LETTERS)), 2).count()
    assert met == 0
    got = {(r.word, r.candidate): r.distance for r in dictionary.near_words(words, table, 2).collect()}
    right = [*known, "pré😀ion"]
    assert got == {(w, c): distance(w, c) for lang, w in asked if lang and w for c in right if distance(w, c) <= 2}


def test_deletion_variants(spark):
    df = spark.createDataFrame([("abcb",), ("",), (None,)], "word string")
    got = [r[0] and sorted(r[0]) for r in df.select(dictionary.deletion_variants(F.col("word"), 2)).collect()]
    assert got == [["ab", "abb", "abc", "abcb", "ac", "acb", "bb", "bc", "bcb", "cb"], [""], None]
