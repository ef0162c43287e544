"""Codes by members that stay, against rounds over whole lists of Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from hayloft.llm import vector_code

SCHEMA = "vec_id long, embedding array<float>, label int, row long, entry int, part string"


def plain_codes(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    w = len(kept[0][1]) // 8
    cut = [[v[p * w : p * w + w] for _, v, _ in kept] for p in range(8)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            owner = [best(x, books[p])[1] for x in cut[p]]
            for e in range(len(books[p])):
                mine = [x for x, o in zip(cut[p], owner) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for j, (i, _, label) in enumerate(kept):
        found = [best(cut[p][j], books[p]) for p in range(8)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=repr), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vectors(n, seed, scale=1.0, copies=0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, scale) for _ in range(16)] for _ in range(5)]
    rows = [(k, [float(np.float32(c + rng.gauss(0, scale / 3))) for c in centers[k % 5]], [0, 1, None][k % 3], k, 9, "x") for k in range(n)]
    same = [(n + k, [float(np.float32(x)) for x in centers[0]], 2, 1, 1, "y") for k in range(copies)]
    bad = [(-1, None, 1, 0, 0, ""), (-2, [], 1, 0, 0, ""), (-3, [0.5] * 15 + [float("nan")], 1, 0, 0, ""), (-4, [float("-inf")] * 16, 1, 0, 0, ""), (-5, [None] + [0.1] * 15, 1, 0, 0, "")]
    return rows + same + bad + [(None, [0.25] * 16, None, 0, 0, "z"), rows[1], rows[1]] if n else bad


@pytest.mark.parametrize("rows", [vectors(300, 1), vectors(200, 2, copies=150), vectors(7, 3), vectors(0, 4), [], vectors(60, 5, scale=2.0**40)])
def test_codes_equal_plain_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_code, "OWNER_PARTS", 64)
    monkeypatch.setattr(vector_code, "CHUNK", 50)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if rows and rows[0][1] and max(map(abs, rows[0][1])) > 2**30:
        # distances beyond a long would stop the job: parts of equal vectors only
        df = df.select("vec_id", (df.embedding.getItem(0) * 0).alias("z"), "embedding", "label").selectExpr("vec_id", "transform(embedding, x -> cast(signum(x) * 3e8 as float)) as embedding", "label")
        rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    coded = vector_code.compress(df)
    want, digest = plain_codes(rows)
    assert sorted((tuple(r[c] for c in ("key", "label", "code", "error")) for r in coded.codes.collect()), key=repr) == want
    assert vector_code.digest(coded.books) == digest
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert {r["label"]: r["label_error"] for r in vector_code.with_label_error(coded.codes).collect()} == totals


def test_only_changed_parts_move(spark):
    rows = vectors(400, 7)
    written = []
    settle = vector_code.stored

    def noted(df, name):
        out = settle(df, name)
        written.append((name, out.count()))
        return out

    vector_code.stored = noted
    try:
        vector_code.compress(spark.createDataFrame(rows, SCHEMA))
    finally:
        vector_code.stored = settle
    assert [n for n, _ in written] == ["members"] + ["movers"] * 5
    assert written[0][1] == 403 * 8 and all(0 <= n < 403 * 4 for _, n in written[1:])


def test_nearest_is_exact_and_takes_the_lowest_of_equals():
    rng = np.random.default_rng(1)
    for scale in (10, 2**20, 2**29):
        part, book = rng.integers(-scale, scale, (200, 8)), rng.integers(-scale, scale, (16, 8))
        book[9] = book[3]
        entry, far = vector_code.nearest(part, book)
        for p, e, d in zip(part.tolist(), entry.tolist(), far.tolist()):
            assert (d, e) == min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(book.tolist()))
