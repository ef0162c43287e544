"""Conversations as training windows of limited length.

A turn is written as ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed. Backslashes in texts
are doubled and ``<|`` becomes ``<\\|``, so no text can pass for a marker, and reading undoes both.

Prefix sums of turn tokens choose the windows: turns that lie within one stretch form a window, and a turn
across a border has one of its own. A stretch has ``budget`` tokens less those of the system turn and
``history`` (never less than half of what the system turn leaves). A window repeats the system turn and
as many last turns before it as fit into ``history`` and into what its own turns leave of the budget, so it
is longer than the budget only if one turn with the system turn is; then it repeats nothing else. Only assistant texts of a window's own turns are under its loss mask, so every target
is learned once. The prefix sums are made in cells of 1,024 turn numbers, so a long conversation is spread.

Defined cases: null text is empty, null role is an empty role; turns are in the order of turn, role
and text, nulls first; repeated rows are turns of their own; the first turn with role ``system`` is the
system turn; null ids form one conversation; an empty table gives an empty result; other columns are
ignored. A turn counts its words and four for its markers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayloft.llm.common import words

BUDGET, HISTORY = 1024, 256
MARKERS = 4
CELL = 1024

TURN = re.compile(r"<\|((?:[^\\|]|\\.)*)\|>\n((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """Text of a window and its loss mask for ``(role, text, learned)`` turns."""
    parts, mask, length = [], [], 0
    for role, text, learned in turns:
        head = f"<|{escape(role).replace('|', chr(92) + '|') if '|' in role else escape(role)}|>\n"
        body = escape(text)
        if learned:
            mask.append((length + len(head), length + len(head) + len(body)))
        parts += [head, body, "<|end|>\n"]
        length += len(head) + len(body) + 8
    return "".join(parts), mask


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window."""
    found, at = [], 0
    while at < len(text):
        match = TURN.match(text, at)
        if match is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return found


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with ``begin`` and ``end``, the tokens of the conversation before and through them, and ``charge``, those of its system turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    size = F.size(words(F.col("text"))).cast("long") + MARKERS
    cell = F.coalesce(F.floor(F.col("turn") / CELL), F.lit(-(2**62)))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), size.alias("size"), cell.alias("cell"))
    cells = turns.groupBy("conv_id", "cell").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("conv_id").alias("c"), F.col("cell").alias("k"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("conv_id", "cell").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    # one row per cell, not per turn, meets the system turn of its conversation
    system = turns.where("role = 'system'").groupBy(F.col("conv_id").alias("s")).agg(F.min_by("size", F.struct("turn", "role", "text")).alias("charge"))
    cells = cells.join(system, F.col("c").eqNullSafe(F.col("s")), "left").drop("s")
    placed = turns.withColumn("within", inside).join(cells, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("k")))
    end = F.col("base") + F.col("within")
    return placed.select("conv_id", "role", "text", (end - F.col("size")).alias("begin"), end.alias("end"), F.coalesce("charge", F.lit(0)).alias("charge"))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, masks, repeats = [], [], []
        for system, rows in zip(batch.column("system").to_pylist(), batch.column("turns").to_pylist()):
            first = [r for r in rows if not r["own"]]
            if system and all(r["begin"] != system["begin"] for r in rows):
                first = [system, *first]
            own = [r for r in rows if r["own"]]
            text, mask = render([(r["role"], r["text"], False) for r in first] + [(r["role"], r["text"], r["role"] == "assistant") for r in own])
            texts.append(text)
            masks.append([{"begin": a, "end": b} for a, b in mask])
            repeats.append(len(first))
        loss = pa.array(masks, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("window"), pa.array(texts, pa.string()), pa.array(repeats, pa.int32()), loss], ["conv_id", "window", "text", "n_repeated", "loss"])


SCHEMA = "conv_id long, window long, text string, n_repeated int, loss array<struct<begin:long,end:long>>"


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``conversations(conv_id, turn, role, text)``.

    ``window`` is the number of tokens before the window's own turns, ``n_repeated`` the number of turns
    it repeats first, ``loss`` the code point ranges of ``text`` to learn.
    """
    turns = _turns(conversations)
    left = F.lit(budget) - F.col("charge")
    stretch = F.greatest(left - history, F.floor(left / 2), F.lit(1))
    number = F.floor(F.col("begin") / stretch)
    across = number != F.floor((F.col("end") - 1) / stretch)
    turns = turns.withColumn("span", 2 * number + across.cast("long"))
    span = Window.partitionBy("conv_id", "span")
    turns = turns.withColumn("window", F.min("begin").over(span)).withColumn("next", F.max("end").over(span))
    turn = ["begin", "role", "text", "end"]
    own = turns.select("conv_id", "window", F.struct(*turn, F.lit(True).alias("own")).alias("turn"))
    repeated = turns.where(F.col("next") - F.col("begin") <= history).select("conv_id", F.col("next").alias("window"), F.struct(*turn, F.lit(False).alias("own")).alias("turn"))
    grouped = own.unionByName(repeated).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = grouped.where(F.exists("turns", lambda t: t["own"])).withColumn("next", F.array_max(F.transform("turns", lambda t: t["end"])))
    system = turns.where("role = 'system'").groupBy(F.col("conv_id").alias("c")).agg(F.min_by(F.struct(*turn), F.col("begin")).alias("system"))
    joined = grouped.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    with_system = joined.select("conv_id", "window", "next", F.when(F.col("system.begin") < F.col("window"), F.col("system")).alias("system"), "turns")
    # the tokens that the system turn and the window's own turns leave, for the last turns before it
    charged = F.coalesce(F.col("system.end") - F.col("system.begin"), F.lit(0)) + F.col("next") - F.col("window")
    kept = F.filter("turns", lambda t: t["own"] | (F.col("window") - t["begin"] <= F.lit(budget) - charged))
    with_system = with_system.select("conv_id", "window", "system", kept.alias("turns"))
    return with_system.mapInArrow(_assemble, SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state = None

    def row(s):
        return [s["conv_id"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"]]

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if state is None or state["conv_id"] != r["conv_id"]:
                if state is not None:
                    done.append(row(state))
                state = {"conv_id": r["conv_id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            for role, text in parse(r["text"])[r["n_repeated"] :]:
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in r["loss"]:
                learned = unescape(r["text"][span["begin"] : span["end"]])
                state["chars"] += len(learned)
                state["loss"].update(learned.encode("utf-8", "surrogatepass"))
            state["formatted"] += len(r["text"])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 6, types)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(state), types)], names)


def digests(written: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read in order: a checksum needs its text as one stream."""
    ordered = written.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
