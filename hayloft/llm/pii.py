"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field tags each word with a kind or none, from the shapes of the word
and its neighbours and from the tag before. It is trained by maximum likelihood on a small labelled
table and decoded by Viterbi over whole texts, many texts side by side in numpy. The table holds lines
around base spans and the same lines with the spans rewritten into forms that no pattern takes: other
separators, ``00`` for ``+``, "at" and "dot" spelled out. Runs of words of one kind that touch no base span
and pass the kind's check are added; base spans always stay.

Defined cases: null and empty texts hold nothing; without labelled words of a kind the field never says
that kind, and without a labelled table it adds nothing; repeated rows are found alike; an empty table
gives an empty result; further columns stay, and columns named like the results are replaced. Texts are
read whole, and time grows in proportion to their length; of equal Viterbi scores the lower tag wins.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import coded, slices, spans, split_words, stored

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1  # 0 is none

# fixed patterns
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

FEATURES = 4096  # shapes are hashed to so many
LINE_WORDS = 64  # words around which a training line is cut
LABELLED_LINES = 1500  # the labelled table is a sample of at most so many lines
ROUNDS, RATE, DECAY = 40, 0.5, 1e-4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Around each @ once: the local part ends there, the domain starts there, and neither holds another @."""
    found, begin, at = [], 0, text.find("@")
    while at >= 0:
        start = begin + len(text[begin:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
        begin = domain.end() if domain else at + 1
        at = text.find("@", begin)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by the patterns, in the order of kinds and places."""
    found = _emails(text)
    if DIGIT.search(text) is None:
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))


RUNS = [(re.compile("[A-ZÀ-Þ]+"), "A"), (re.compile("[^\\W\\d_A]+"), "a")]


def shape(word: str) -> int:
    """Number of a word's shape: letters by case, digits by count, marks as they are; runs count once.

    The whole word counts. "at" and "dot" have shapes of their own.
    """
    if word.isalpha():
        form = word if word in ("at", "dot") else "a" if word.islower() else "A" if word.isupper() else "Aa"
    else:
        form = re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 4 else "99", word)
        for pattern, letter in RUNS:
            form = pattern.sub(letter, form)
        digits = re.sub(r"[^0-9]", "", word)
        # numbers of a card's length, checked: the shape alone does not tell them from others
        form += f"/{luhn(digits)}" if 13 <= len(digits) <= 19 else ""
    return zlib.crc32(form.encode("utf-8", "surrogatepass")) % FEATURES


def rewritten(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with its base spans in forms that the patterns miss, and where they now stand.

    A checksum of the span chooses the form. Of spans that overlap the first stays.
    """
    parts: list[str] = []
    marked, done, length = [], 0, 0
    for kind, a, b in sorted(base_spans(text), key=lambda s: s[1:]):
        if a < done:
            continue
        old = text[a:b]
        turn = zlib.crc32(old.encode()) % 3
        if kind == 0:
            at, dot = ((" at ", " dot "), ("[at]", "."), (" @ ", "."))[turn]
            local, domain = old.split("@")
            new = local + at + domain.replace(".", dot)
        elif kind == 1:
            new = old.replace(".", ("-", "[.]", ",")[turn])
        elif kind == 2:
            new = ("./_"[turn]).join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", old)))
        else:
            new = ("00", "(00)", "00 ")[turn] + old[1:]
        parts += [text[done:a], new]
        length += a - done
        marked.append((kind, length, length + len(new)))
        length += len(new)
        done = b
    return "".join([*parts, text[done:]]), marked


def word_tags(text: str, marked: list[tuple[int, int, int]] | None = None) -> tuple[list[str], list[int]]:
    """Words of a text and the kind of the span that each one touches, 0 for none; base spans unless others are given."""
    marked = base_spans(text) if marked is None else marked
    words, tags = [], []
    for m in WORD.finditer(text):
        kind = next((k + 1 for k, a, b in marked if a < m.end() and m.start() < b), 0)
        words.append(m[0])
        tags.append(kind)
    return words, tags


def labelled_table(docs: DataFrame, lines: int = LABELLED_LINES) -> DataFrame:
    """``(shapes, tags)``: at most ``lines`` lines around base spans or other numbers, labelled by the spans.

    A sample by the checksum of the id, whatever the order of the rows. Texts are read whole. A line with spans
    comes a second time with the spans rewritten; both count.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for order, text in zip(batch.column("order").to_pylist(), batch.column("text").to_pylist()):
                if "@" not in text and DIGIT.search(text) is None:
                    continue
                words, tags = word_tags(text)
                # around the first span, or else the first number, which then is none of the kinds
                at = next((k for k, t in enumerate(tags) if t), None)
                if at is None:
                    at = next(k for k, w in enumerate(words) if "@" in w or DIGIT.search(w))
                begin = max(0, at - LINE_WORDS // 2)
                part = slice(begin, begin + LINE_WORDS)
                rows.append((order, list(map(shape, words[part])), tags[part]))
                if any(tags[part]):
                    words, tags = word_tags(*rewritten(" ".join(words[part])))
                    rows.append((order, list(map(shape, words)), tags))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                ["order", "shapes", "tags"],
            )

    keyed = docs.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id").alias("order"), "text")
    found = keyed.mapInArrow(cut, "order long, shapes array<int>, tags array<int>")
    # written, so that the best lines of all tasks meet in a task and not on the driver
    return stored(found.orderBy("order", "shapes", "tags").limit(lines), "pii-lines").select("shapes", "tags")


@dataclass(frozen=True)
class Field:
    """Weights of a word's shape, of the shapes before and after it, and of two tags in a row."""

    shapes: np.ndarray  # 3 x features x tags
    steps: np.ndarray  # tags x tags, from and to

    def emissions(self, here: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.shapes[0].take(here, axis=0) + self.shapes[1].take(before, axis=0) + self.shapes[2].take(after, axis=0)


EDGE = 0  # stands for a missing neighbour


def train(labelled: DataFrame) -> Field | None:
    """Maximum likelihood by gradient steps; the labelled table is small and comes to the driver."""
    rows = labelled.collect()
    if not rows:
        return None
    count, width = len(rows), max(len(r["shapes"]) for r in rows)
    here = np.zeros((count, width), np.int64)
    tags = np.zeros((count, width), np.int64)
    inside = np.zeros((count, width), bool)
    for k, r in enumerate(rows):
        n = len(r["shapes"])
        here[k, :n], tags[k, :n], inside[k, :n] = r["shapes"], r["tags"], True
    before = np.where(np.arange(width) > 0, np.roll(here, 1, axis=1), EDGE)
    after = np.where(np.roll(inside, -1, axis=1) & (np.arange(width) < width - 1), np.roll(here, -1, axis=1), EDGE)
    field = Field(np.zeros((3, FEATURES, TAGS)), np.zeros((TAGS, TAGS)))
    squares = [np.full_like(field.shapes, 1e-6), np.full_like(field.steps, 1e-6)]
    known = np.eye(TAGS)[tags] * inside[..., None]
    pairs = inside[:, 1:]
    known_steps = np.einsum("nti,ntj->ij", known[:, :-1] * pairs[..., None], known[:, 1:])
    for _ in range(ROUNDS):
        share, steps = _marginals(field, field.emissions(here, before, after), inside)
        error = (share - known)[inside]
        gradients = [np.stack([_summed(x[inside], error) for x in (here, before, after)]) + DECAY * count * field.shapes, steps - known_steps]
        for values, gradient, square in zip((field.shapes, field.steps), gradients, squares):
            square += gradient**2
            values -= RATE * gradient / np.sqrt(square)
    # a kind without labels is never said
    absent = [k for k in range(1, TAGS) if not (tags[inside] == k).any()]
    field.shapes[0][:, absent] = -1e6
    return Field(field.shapes.astype(np.float32), field.steps.astype(np.float32))


def _summed(feature: np.ndarray, error: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(feature, error[:, k], FEATURES) for k in range(TAGS)], axis=1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _marginals(field: Field, scores: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each tag at each word, and expected numbers of steps (forward and backward sums)."""
    width = scores.shape[1]
    forward, backward = scores.copy(), np.zeros_like(scores)
    for t in range(1, width):
        forward[:, t] += _log_sum(forward[:, t - 1, :, None] + field.steps, 1)
        forward[:, t] = np.where(inside[:, t, None], forward[:, t], forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        step = _log_sum(field.steps[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
    total = _log_sum(forward[:, -1], 1)
    share = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
    steps = np.zeros_like(field.steps)
    for t in range(width - 1):
        both = forward[:, t, :, None] + field.steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :] - total[:, None, None]
        steps += np.exp(both)[inside[:, t + 1]].sum(axis=0)
    return share, steps


def viterbi(field: Field, scores: np.ndarray, lengths: np.ndarray, cells: int = 1_000_000) -> np.ndarray:
    """Best tags of all words; ``scores`` has the words of all texts in a row."""
    starts = np.cumsum(lengths) - lengths
    tags = np.zeros(len(scores), np.int8)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin = 0
    while begin < len(order):
        width = int(lengths[order[begin]])
        some = order[begin : begin + max(1, cells // width)]
        begin += len(some)
        back = np.empty((width, TAGS, len(some)), np.int8)
        best = scores[starts[some]].T.copy()
        live = lengths[some]
        for t in range(1, width):
            alive = int(np.searchsorted(-live, -t))  # the first ones are the longest
            through = best[:, None, :alive] + field.steps[:, :, None]
            back[t, :, :alive] = through.argmax(axis=0)
            best[:, :alive] = through.max(axis=0) + scores[starts[some[:alive]] + t].T
        now = best.argmax(axis=0)
        lane = np.arange(len(some))
        for t in range(width - 1, -1, -1):
            alive = int(np.searchsorted(-live, -t))
            tags[starts[some[:alive]] + t] = now[:alive]
            if t:
                now[:alive] = back[t, now[:alive], lane[:alive]]
    return tags


SPELLED = re.compile(r" ?[(\[{] ?(at|dot) ?[)\]}] ?| (at|dot) | ?(@) ?")


def plausible(kind: int, text: str) -> bool:
    """What a span of a kind must hold, however it is written."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == 0:
        plain = SPELLED.sub(lambda m: "." if "dot" in m.groups() else "@", " ".join(text.split()))
        return _emails(plain) == [(0, 0, len(plain))]
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _added(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Plausible runs of words of one kind, without marks at their ends, that touch no base span."""
    found: list[tuple[int, int, int]] = []
    runs: list[list[int]] = []
    last = 0
    for m, tag in zip(WORD.finditer(text), tags):
        if tag and tag == last:
            runs[-1][2] = m.end()
        elif tag:
            runs.append([int(tag) - 1, m.start(), m.end()])
        last = tag
    for kind, a, b in runs:
        while a < b and not text[a].isalnum() and text[a] != "+":
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b and plausible(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in base):
            found.append((kind, a, b))
    return found


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with the number of base spans of each kind, their checksum and the list of all spans."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            rows = []
            for a, b in spans(whole, 12_000_000):
                rows += _found(field, whole.slice(a, b - a))
            names = [c.split()[0] for c in RESULT.split(", ")]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.withColumn("__pii", F.arrow_udf(run, RESULT)(F.col(text)))
    return out.withColumns({c.split()[0]: F.col(f"__pii.{c.split()[0]}") for c in RESULT.split(", ")}).drop("__pii")


def _found(field: Field | None, column: pa.Array) -> list[tuple]:
    texts = [t or "" for t in column.to_pylist()]
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if field is not None:
        raw, rows = split_words(column)
        distinct, place = coded(raw)
        shapes = np.fromiter(map(shape, distinct.to_pylist()), np.int64, len(distinct))
        here = shapes[place] if len(raw) else np.empty(0, np.int64)
        first = np.diff(rows, prepend=-1) != 0
        before = np.where(first, EDGE, np.roll(here, 1))
        after = np.where(np.roll(first, -1), EDGE, np.roll(here, -1))
        lengths = np.bincount(rows, minlength=len(texts)) if len(raw) else np.zeros(len(texts), np.int64)
        tags = viterbi(field, field.emissions(here, before, after), lengths)
        starts = np.cumsum(lengths) - lengths
        for k in np.unique(rows[np.flatnonzero(tags)]) if len(raw) else ():
            added[k] = _added(texts[k], tags[starts[k] : starts[k] + lengths[k]], base[k])
    out = []
    for own, more in zip(base, added):
        counts = [sum(k == kind for k, _, _ in own) for kind in range(len(KINDS))]
        out.append((*counts, hashlib.sha256(listed(own).encode()).hexdigest(), listed(own + more)))
    return out
