"""Removed passages against a plain table of all windows."""

import random

import pytest

from hayloft.llm import substrings
from tests.llm import plain




def expected(spark, rows, size=20):
    """Order among texts of one key is by Spark's hash of the text."""
    df = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "n long, i long, t string")
    tie = {r["n"]: r["h"] for r in df.selectExpr("n", "xxhash64(t) as h").collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, tie[k]))
    seen, out = {}, []
    for k in order:
        w = plain.words(rows[k][1])
        name = (rows[k][0], rows[k][1])
        gone = set()
        for a in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[a : a + size]), (name, a)) != (name, a):
                gone |= set(range(a, a + size))
        out.append((rows[k][0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def texts(seed, n, letters, passages):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            b = rng.randrange(a, len(p) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:b]
        out.append((k, " ".join(w)))
    return out + [(n + k, out[rng.randrange(n)][1]) for k in range(5)]


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    return [[f"p{rng.randrange(300)}" for _ in range(n)] for n in (19, 20, 21, 40, 70)] + [["x"] * 60, ["x", "y"] * 25]


@pytest.mark.parametrize("size, classes", [(20, 20_000), (20, 1), (20, 2), (8, 3), (25, 20_000)])
def test_equals_all_windows(spark, passages, monkeypatch, size, classes):
    monkeypatch.setattr(substrings, "GROUP_CLASSES", classes)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 3000)
    rows = texts(size + classes, 120, 400, passages) + [(None, " ".join(passages[3])), (None, None), (7, "other " + " ".join(passages[4])), (8, "")]
    rows += [rows[3], rows[3]]
    random.Random(1).shuffle(rows)
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size).collect()
    assert sorted(map(tuple, got), key=repr) == expected(spark, rows, size)


def test_small_batches_cut_no_group(spark, passages):
    rows = texts(3, 80, 50, passages)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == expected(spark, rows)


def test_awkward_rows(spark):
    rows = plain.documents()
    got = substrings.without_repeats(plain.frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(spark, rows)
    assert substrings.without_repeats(plain.frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.without_repeats(plain.frame(spark), size=5)
