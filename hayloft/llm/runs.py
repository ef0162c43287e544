"""Periodic runs of words, found on a grammar instead of on the texts.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``max(least, 2 * q)`` words long, that
neither neighbour extends. Spark deals the documents; a task works on slices of texts:

1. Re-Pair in rounds gives the word ids of all texts of a slice one grammar: of the pairs that occur twice or more, those
   with no more frequent pair beside them become a nonterminal, until no pair occurs twice. What is left of a text
   is joined pairwise to one root. Copies, whether inside a text or across texts, are the same nonterminals.
2. For each nonterminal, once and wherever it stands, the runs that cross the border of its two halves: a period q left or
   right of the border is tried where the words around it allow it, and common extensions to both sides, by binary
   search over hashes of prefixes, tell the stretch.
3. The stretches are translated to all places the nonterminal derives. A run crosses the border of the smallest node
   that holds it, so it is found whole there; pieces of it, from nodes that hold a part only, lie inside it with the
   same period and go when intervals are merged.
4. The runs are compared word for word at last; a hash that was wrong makes the slice start again with other bases.

Cost is in proportion to the words times the depth of the grammar, memory to the words of a slice; a text longer than
a slice is a slice of its own.

Defined cases: a null text, or one without words, has no runs and an empty collapsed text. Texts shorter than ``least`` words have no run.
Rows with a null or repeated key, and repeated rows, each get a result. An empty table gives no rows. Columns other than
key and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayloft.llm.common import coded, slices, split_words

LEAST = 12
SLICE_BYTES = 4_000_000
# Periods tried at a time.
STEP = 2_000_000
# Two primes below 2**31, and bases of the prefix hashes: another pair for each attempt.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = ((911_382_323, 972_663_749), (1_644_921_317, 1_386_520_733), (744_281_003, 1_903_377_481))

RESULT = "key long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar(NamedTuple):
    """Rules of symbols from ``terminals`` on; ``place`` is where a symbol's first occurrence begins."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    place: np.ndarray
    levels: list[tuple[int, int]]  # symbols made in the same round; their halves are older
    roots: np.ndarray


def grammar(ids: np.ndarray, ends: np.ndarray) -> Grammar:
    """One grammar for consecutive texts: ``ids`` of their words, and where each text, none of them empty, ends."""
    terminals = int(ids.max()) + 1 if len(ids) else 0
    left, right, size, place = (np.zeros(terminals + len(ids), np.int64) for _ in range(4))
    size[:terminals] = 1
    symbols, at = ids.astype(np.int64), np.arange(len(ids))
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    levels, made = [], terminals

    def replace(chosen: np.ndarray, name: np.ndarray, count: int) -> None:
        """Put symbols ``made + name`` for the pairs that begin at ``chosen``."""
        nonlocal symbols, at, last, made
        new = made + name
        left[new], right[new], place[new] = symbols[chosen], symbols[chosen + 1], at[chosen]
        size[made : made + count] = size[left[made : made + count]] + size[right[made : made + count]]
        symbols[chosen] = new
        last[chosen] = last[chosen + 1]
        stay = np.ones(len(symbols), bool)
        stay[chosen + 1] = False
        symbols, at, last = symbols[stay], at[stay], last[stay]
        levels.append((made, made + count))
        made += count

    while len(symbols) > 1:
        inside = np.flatnonzero(~last[:-1])
        codes, distinct = pd.factorize(symbols[inside] << 32 | symbols[inside + 1])
        count = np.bincount(codes, minlength=len(distinct))
        if not len(count) or count.max() < 2:
            break
        # more frequent first; scrambled numbers, all different, between equals
        rank = np.where(count > 1, count << 32 | (np.arange(len(count)) * 2_654_435_761 & 0xFFFFFFFF), 0)
        strength = np.zeros(len(symbols) + 1, np.int64)
        strength[inside + 1] = rank[codes]
        here = strength[1:-1]
        peak = (here > 0) & (here >= strength[:-2]) & (here >= strength[2:])
        # equal neighbours are one symbol again and again: every second pair
        index = np.arange(len(here))
        begins = np.maximum.accumulate(np.where(here != strength[:-2], index, 0))
        chosen = np.flatnonzero(peak & (index - begins & 1 == 0))
        name, used = pd.factorize(symbols[chosen] << 32 | symbols[chosen + 1])
        replace(chosen, name, len(used))
    while not last.all():
        index = np.arange(len(symbols))
        begins = np.maximum.accumulate(np.where(np.append(True, last[:-1]), index, 0))
        chosen = np.flatnonzero((index - begins & 1 == 0) & ~last)
        replace(chosen, np.arange(len(chosen)), len(chosen))
    return Grammar(terminals, left[:made], right[:made], size[:made], place[:made], levels, symbols)


class Prefixes:
    """Hashes of all prefixes of a sequence: compares stretches that begin at i and j."""

    def __init__(self, ids: np.ndarray, bases: tuple[int, int]):
        self.tables = []
        for prime, base in zip(PRIMES, bases):
            power = np.ones(len(ids) + 1, np.int64)
            done, factor = 1, base
            while done < len(power):
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * factor % prime
                done, factor = done + more, factor * factor % prime
            total = np.zeros(len(ids) + 1, np.int64)
            # sums of 2**32 terms below 2**31 stay below 2**63
            np.cumsum((ids + 1) * power[:-1] % prime, out=total[1:])
            self.tables.append((prime, power, total % prime))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        same = np.ones(len(i), bool)
        for prime, power, total in self.tables:
            same &= (total[i + length] - total[i]) % prime * power[j - i] % prime == (total[j + length] - total[j]) % prime
        return same

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words from i and j on that are equal, ``most`` at most."""
        return self._extend(i, j, most, lambda far, step: (i + far, j + far))

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words before i and j that are equal, ``most`` at most."""
        return self._extend(i, j, most, lambda far, step: (i - far - step, j - far - step))

    def _extend(self, i, j, most, stretch) -> np.ndarray:
        far = np.zeros(len(i), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            open_ = np.flatnonzero(far + step <= most)
            a, b = stretch(far, step)
            far[open_] += step * self.equal(a[open_], b[open_], step)
        return far


def crossing(g: Grammar, ids: np.ndarray, prefixes: Prefixes, least: int) -> tuple[np.ndarray, ...]:
    """Runs of each nonterminal that cross its border: ``(symbol, start in it, length, period)``, sorted."""
    symbols = np.flatnonzero(g.size >= least)
    symbols = symbols[symbols >= g.terminals]
    low, whole = g.place[symbols], g.size[symbols]
    border, high = low + g.size[g.left[symbols]], low + whole
    # one of the two extensions of a run has so many words
    gram = (-(-least // 2) + 1) // 2
    padded = np.concatenate([-1 - np.arange(gram), ids, -1 - gram - np.arange(gram)])
    grams = np.zeros(len(ids) + gram + 1, np.int64)
    for k in range(gram):
        grams = grams * 1_000_003 + padded[k : k + len(grams)]
    found = []
    for right in (True, False):
        tries = np.minimum(g.size[(g.right if right else g.left)[symbols]], whole // 2)
        ends = np.cumsum(tries)
        start = 0
        while start < len(symbols):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + STEP, side="right")))
            which = np.repeat(np.arange(start, end), tries[start:end])
            period = np.arange(before, ends[end - 1]) - np.repeat(np.append(before, ends[start : end - 1]), tries[start:end]) + 1
            middle = border[which]
            # the word on the other side of the border belongs to the run, too
            fits = ids[middle - 1] == ids[middle + period - 1] if right else ids[middle - period] == ids[middle]
            which, period, middle = which[fits], period[fits], middle[fits]
            i = middle if right else middle - period
            near = (grams[i + gram] == grams[i + period + gram]) | (grams[i] == grams[i + period])
            which, period, i = which[near], period[near], i[near]
            ahead = prefixes.forward(i, i + period, high[which] - i - period)
            behind = prefixes.backward(i, i + period, i - low[which])
            length = ahead + behind + period
            ok = (length >= np.maximum(least, 2 * period)) & ((behind if right else ahead) > 0)
            found.append(np.stack([symbols[which[ok]], (i - behind - low[which])[ok], length[ok], period[ok]]))
            start = end
    runs = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1], runs[0]))]
    # the same stretch with multiples of its period
    first = np.ones(runs.shape[1], bool)
    first[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(0)
    return tuple(runs[:, first])


def translated(g: Grammar, symbol: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Runs of nonterminals at all places these derive: rows of start, end, period."""
    count = np.bincount(symbol, minlength=len(g.size))
    first = np.cumsum(count) - count
    holds = count > 0
    for a, b in g.levels:
        holds[a:b] |= holds[g.left[a:b]] | holds[g.right[a:b]]
    node = g.roots[holds[g.roots]]
    at = (np.cumsum(g.size[g.roots]) - g.size[g.roots])[holds[g.roots]]
    out = [np.zeros((3, 0), np.int64)]
    while len(node):
        n = count[node]
        run = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        begin = np.repeat(at, n) + start[run]
        out.append(np.stack([begin, begin + length[run], period[run]]))
        half = np.concatenate([g.left[node], g.right[node]])
        at = np.concatenate([at, at + g.size[g.left[node]]])
        node, at = half[holds[half]], at[holds[half]]
    return np.concatenate(out, 1)


def merged(pieces: np.ndarray) -> np.ndarray:
    """Longest intervals of each period, sorted by start and period."""
    start, end, period = pieces[:, np.lexsort((-pieces[1], pieces[0], pieces[2]))]
    if len(start):
        group = np.cumsum(np.append(0, period[1:] != period[:-1]))
        reach = group * (end.max() + 1) + end
        before = np.append(-1, np.maximum.accumulate(reach)[:-1])
        longest = reach > np.maximum(before, group * (end.max() + 1))
        start, end, period = start[longest], end[longest], period[longest]
    order = np.lexsort((period, start))
    return np.stack([start[order], end[order], period[order]])


def runs_of(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of consecutive texts (none empty), at places of the whole sequence: rows of start, end, period."""
    g = grammar(ids, ends)
    for bases in BASES:
        runs = merged(translated(g, *crossing(g, ids, Prefixes(ids, bases), least)))
        if all(np.array_equal(ids[a : b - q], ids[a + q : b]) for a, b, q in runs.T.tolist()):
            return runs
    raise ArithmeticError("hashes of unequal words agree for all bases")


def _sliced(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            flat, rows = split_words(batch.column("text"))
            sizes = np.bincount(rows, minlength=batch.num_rows)
            ids = coded(flat)[1].astype(np.int64)
            stops = np.cumsum(sizes)
            start, end, period = runs_of(ids, stops[sizes > 0], least)
            # words after a run's first period go
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, end, -1)
            stay = np.cumsum(cover)[:-1] == 0
            left = np.append(0, np.cumsum(np.bincount(rows[stay], minlength=batch.num_rows)))
            kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(stay)).cast(pa.string()))
            row = np.searchsorted(stops, start, side="right")
            place = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            columns = [start - (stops - sizes)[row], end - start, period]
            found = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), found), pc.binary_join(kept, " ")],
                names=["key", "n_words", "runs", "collapsed"],
            )

    return work


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(key, n_words, runs, collapsed)`` of every row: its runs by start and period, and the words that no run repeats."""
    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(_sliced(least), RESULT)


def longest(runs: Column) -> Column:
    """The run with the greatest length, of equals the first one, then the shortest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))


def listed(runs: Column) -> Column:
    """``start,length,period`` of each run on a line of its own."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
