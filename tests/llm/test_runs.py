"""Runs on the grammar against all periods tried word by word."""

import random
import zlib

import numpy as np
import pytest

from hayloft.llm import runs
from hayloft.llm.queries import QUERIES
from tests.llm import plain


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            a = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k + q - a >= max(least, 2 * q):
                found.setdefault((a, k + q - a), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(w, found):
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(w, i):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return w[:a] + [w[a + (k - a) % p] for k in range(a, n)]


def sequences():
    rng = random.Random(4)
    for n, letters in ((1, 1), (11, 1), (12, 1), (13, 1), (100, 1), (257, 1), (300, 2), (400, 2), (300, 3), (500, 30)):
        yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(60):
        out = []
        while len(out) < 150:
            block = [rng.randrange(4) for _ in range(rng.randrange(1, 15))]
            out += block * rng.randrange(1, 6) + block[: rng.randrange(len(block) + 1)]
        yield out
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    t = [0]
    while len(t) < 512:
        t = t + [1 - x for x in t]
    yield t
    yield [0, 1, 2] * 50 + [7] + [0, 1, 2] * 50
    yield ([5] * 11 + [6]) * 9


def test_runs_of_one_text():
    for w in sequences():
        got = runs.runs_of(np.array(w), np.array([len(w)]))
        assert [(a, b - a, q) for a, b, q in got.T.tolist()] == plain_runs(w), w


@pytest.mark.parametrize("least", [2, 3, 5, 12, 20])
def test_runs_of_texts_side_by_side(least, monkeypatch):
    monkeypatch.setattr(runs, "STEP", 50)
    texts = list(sequences()) * 2
    got = runs.runs_of(np.array(sum(texts, [])), np.cumsum([len(w) for w in texts]), least)
    want, at = [], 0
    for w in texts:
        want += [(at + a, at + a + n, q) for a, n, q in plain_runs(w, least)]
        at += len(w)
    assert list(map(tuple, got.T.tolist())) == want


def test_grammar_derives_the_texts():
    texts = list(sequences())
    ids = np.array(sum(texts, []))
    g = runs.grammar(ids, np.cumsum([len(w) for w in texts]))

    def derived(x):
        todo, out = [x], []
        while todo:
            y = todo.pop()
            if y < g.terminals:
                out.append(y)
            else:
                todo += [g.right[y], g.left[y]]
        return out

    assert [derived(r) for r in g.roots] == texts
    for x in range(g.terminals, len(g.size)):
        assert derived(x) == ids[g.place[x] : g.place[x] + g.size[x]].tolist()


def test_wrong_hashes_are_seen(monkeypatch):
    w = np.array([0, 1, 2, 3] * 6 + list(range(4, 40)))
    monkeypatch.setattr(runs, "BASES", ((0, 0), runs.BASES[0]))
    assert runs.runs_of(w, np.array([len(w)])).T.tolist() == [[0, 24, 4]]


def test_long_text_of_one_word():
    n = 300_000
    assert runs.runs_of(np.zeros(n, np.int64), np.array([n])).T.tolist() == [[0, n, 1]]


def test_operator_on_awkward_rows(spark):
    rows = plain.documents()
    rows += [(100, "a " * 40, "en", "a", 1, 1, 1.0, "", 1, 1, 1, "", "", ""), (101, "x  a\tb " + "a\nb " * 9 + "é", "en", "a", 1, 1, 1.0, "", 1, 1, 1, "", "", "")]
    got = runs.find(plain.frame(spark, rows)).collect()
    want = []
    for i, text, *_ in rows:
        w = plain.words(text)
        found = plain_runs(w) if len(w) < 2000 else None
        want.append((i, len(w), found, collapsed(w, found) if found is not None else None))
    seen = [(r["key"], r["n_words"], [tuple(x) for x in r["runs"]] if r["n_words"] < 2000 else None, r["collapsed"] if r["n_words"] < 2000 else None) for r in got]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert runs.find(plain.frame(spark, [])).count() == 0


def test_query_equals_plain_program(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = planted(plain.words(text), i)
        if len(w) > 1500:
            continue
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == plain.sha("".join(f"{a},{n},{q}\n" for a, n, q in found))
        assert r["collapsed_sha256"] == plain.sha(collapsed(w, found))
