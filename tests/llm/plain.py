"""Plain programs that the operators are compared with, and a small table of awkward documents."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, node string, start long, n long, cell long, lang_pred string, spans string, word string"


def words(text):
    return WORD.findall(text or "")


def documents():
    long_text = " ".join(f"word{k % 700} is{k % 13}" for k in range(9000))
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:j] + ["x"] + base[j + 1 :]) for j in (3, 4, 5)]
    texts = [None, "", " \t\n", "the one", "The One", " ".join(base), " ".join(base), *near, long_text, long_text + " end", "a b c d", "été Über ñandú"]
    texts += ["mail joe@example.org or +1 (555) 010-9999, 10.0.0.1 and 4111 1111 1111 1111", "1.2.3.400 4111 1111 1111 1112 +123", "tie", "tie"]
    texts += ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"]
    sources = ["b", None, "a", "", "b"]
    rows = [(k, t, ["en", None, "fr"][k % 3], sources[k % 5], len(t or ""), -1, -1.0, "x", 7, 7, 7, "zz", "zz", "zz") for k, t in enumerate(texts)]
    return rows + [(None, "no id here at all", None, None, 3, 1, 1.0, "x", 7, 7, 7, "zz", "zz", "zz"), rows[3], rows[3]]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def shingles(text, size=5):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(lowered)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(rows):
    """``(doc_id, size, smallest id reachable)`` by comparing all rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def base_counts(text):
    w = words(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def checksum(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
