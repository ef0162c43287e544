"""Change feed: source, normalization, create-ready detection, incremental maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from hayloft import schemas as S
from hayloft.session import checkpointed

RELEASED = "path string, op string, seq long, ready_at timestamp"
_WAIT_US = int(S.CREATE_WAIT_SECONDS * 1_000_000)


def read_changes(spark: SparkSession, path: str, file_format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a change log ``(seq, ts, op, path, dest_path, is_directory)``; directories are left out."""
    reader = spark.readStream.schema(S.CHANGES).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).where("not coalesce(is_directory, false)")


def new_files(spark: SparkSession, directory: str) -> DataFrame:
    """Stream of files as they appear in a directory, without their bytes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(directory).drop("content")


def normalize(changes: DataFrame, ignored: Iterable[str] = (), directory: str | None = None) -> DataFrame:
    """(seq, ts, op, path, ready): moves become a delete and a create, ignored names vanish.

    A move out of the directory is only a delete, a move from an ignored name only a create. Creates
    that come from a move are ``ready``: nobody is still writing such a file. Stateless, so it works
    on a stream as on a table.
    """
    ignored = list(ignored)
    name = lambda p: F.regexp_extract(p, r"([^/]*)$", 1)
    is_ignored = lambda p: name(p).isin(*ignored) if ignored else F.lit(False)
    old, new = F.col("path"), F.col("dest_path")
    moved = F.col("op") == "moved"
    stays = F.lit(True) if directory is None else (F.regexp_extract(new, r"^(.*)/[^/]*$", 1) == directory.rstrip("/"))
    row = lambda op, path, ready: F.struct(F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), path.alias("path"), F.lit(ready).alias("ready"))
    nothing = F.struct(F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("ready"))
    target = F.coalesce(new, F.lit("")) != ""
    parts = F.when(
        moved,
        F.array(
            F.when(target & ~is_ignored(old), row("deleted", old, True)).otherwise(nothing),
            F.when(target & ~is_ignored(new) & (is_ignored(old) | stays), row("created", new, True)).otherwise(nothing),
        ),
    ).otherwise(F.array(F.when(~is_ignored(old), row(F.col("op"), old, False)).otherwise(nothing)))
    return (
        changes.select("seq", "ts", F.explode(parts).alias("part"))
        .where("part.op is not null")
        .select("seq", "ts", "part.*")
    )


# --- create-ready detection -----------------------------------------------------------------------


@dataclass(frozen=True)
class Watch:
    """What is known about one path between events; times in microseconds."""

    pending_at: int | None = None
    pending_seq: int | None = None
    opened: bool = False
    closed: bool = False

    def deadline(self) -> int | None:
        return None if self.pending_at is None or self.opened else self.pending_at + _WAIT_US


def expire(watch: Watch, now: int) -> tuple[Watch, tuple | None]:
    """Release a create that nobody opened within the waiting time."""
    due = watch.deadline()
    if due is None or now < due:
        return watch, None
    return replace(watch, pending_at=None, pending_seq=None), ("created", watch.pending_seq, due)


def advance(watch: Watch, op: str, at: int, seq: int, ready: bool, legacy: bool = False) -> tuple[Watch, list[tuple]]:
    """Next state and the releases (op, seq, time) caused by one event.

    A created file that was opened is released when it is closed, whichever event came first. One
    that is not opened within a second was moved in and is released then. ``legacy`` ignores opens:
    the first of close and one second releases. A delete forgets the path.
    """
    watch, out = expire(watch, at)
    releases = [out] if out else []
    if op == "deleted":
        return Watch(), [*releases, ("deleted", seq, at)]
    if op == "created" and ready:
        return Watch(), [*releases, ("created", seq, at)]
    if op == "created":
        if watch.opened and watch.closed:
            return Watch(), [*releases, ("created", seq, at)]
        if watch.pending_at is None:
            watch = replace(watch, pending_at=at, pending_seq=seq)
    elif op == "opened" and not legacy:
        watch = replace(watch, opened=True)
    elif op == "closed":
        if watch.pending_at is not None:
            releases.append(("created", watch.pending_seq, at))
            watch = replace(watch, pending_at=None, pending_seq=None, opened=False)
        else:
            watch = replace(watch, closed=True)
    return watch, releases


def _release_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "op", "seq", "ready_at"])
    return frame.astype({"seq": "int64"}).assign(ready_at=pd.to_datetime(frame["ready_at"], unit="us"))


_STATE = "pending_at long, pending_seq long, opened boolean, closed boolean"  # -1: nothing pending


def _to_state(watch: Watch) -> tuple:
    pending = (-1, -1) if watch.pending_at is None else (watch.pending_at, watch.pending_seq)
    return (*pending, watch.opened, watch.closed)


def _from_state(stored: tuple) -> Watch:
    at, seq, opened, closed = stored
    pending = (None, None) if seq == -1 else (int(at), int(seq))
    return Watch(*pending, bool(opened), bool(closed))


def ready_stream(normalized: DataFrame, delay: str = "5 seconds", legacy: bool = False) -> DataFrame:
    """(path, op, seq, ready_at) as a stream: creates once their file is complete, deletes at once.

    State is one small row per path. Events of a path inside a micro-batch are put in order; events
    older than the watermark are dropped and repaired by the periodic reconciliation.
    """

    def track(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        watch = _from_state(state.get) if state.exists else Watch()
        rows: list[tuple] = []
        if state.hasTimedOut:
            due = watch.deadline()
            if due is not None:
                watch, out = expire(watch, due)
                rows.append((key[0], *out))
        else:
            events = pd.concat(list(batches))
            times = events["ts"].astype("datetime64[us]").astype("int64")
            # a file moved onto itself is deleted first
            rank = events["op"] != "deleted"
            for at, seq, _, op, ready in sorted(zip(times, events["seq"], rank, events["op"], events["ready"])):
                watch, releases = advance(watch, op, at, seq, ready, legacy)
                rows += [(key[0], *r) for r in releases]
        if watch == Watch():
            state.remove()
        else:
            state.update(_to_state(watch))
            due = watch.deadline()
            if due is not None:
                state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield _release_frame(rows)

    return (
        normalized.withWatermark("ts", delay)
        .groupBy("path")
        .applyInPandasWithState(track, RELEASED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


# --- the detector over a complete log, one path's events in many tasks ------------------------------

_EVENT = ["path", "at", "seq", "last", "op", "ready"]
_OUTCOME = "pending boolean, opened boolean, closed boolean, until long, to_at long, to_seq long, to_opened boolean, to_closed boolean"
_SUMMARY = f"piece int, first string, last string, outcomes array<struct<{_OUTCOME}>>"
_JOINT = "piece int, in_at long, in_seq long, in_opened boolean, in_closed boolean, ends boolean"
_CARRIED = -2  # number that stands for the create pending when a stretch begins, whichever it is
_NEVER = 2**62


@dataclass(frozen=True)
class Start:
    """A class of states before a stretch that all end alike; ``pending`` is none where any state will do.

    A create that waits unopened belongs to the class with the smallest ``until`` not before its time.
    """

    pending: bool | None = None
    opened: bool = False
    closed: bool = False
    until: int = _NEVER

    def holds(self, watch: Watch) -> bool:
        if self.pending is None:
            return True
        same = (self.pending, self.opened, self.closed) == (watch.pending_at is not None, watch.opened, watch.closed)
        return same and (watch.pending_at is None or watch.pending_at <= self.until)


class Stretch:
    """What consecutive events of one path make of every state the path may have before them.

    The states a path may be in are advanced side by side, equal ones as one: any delete leaves one.
    Only the time of a create that waits unopened can matter beyond its class, and only against events
    of its first second, so a class is cut where such an event comes after the wait: at most once for each
    event of that second.
    """

    def __init__(self, fresh: bool, legacy: bool = False):
        self.legacy, self.begin = legacy, None
        self.live: dict[Watch, list[Start]] = {Watch(): [Start()]}
        if not fresh:
            flags = [(o, c) for o in (False, True) for c in (False, True)]
            self.live = {Watch(None, None, o, c): [Start(False, o, c)] for o, c in flags}
            self.live |= {Watch(_NEVER, _CARRIED, o, c): [Start(True, o, c)] for o, c in flags}

    def add(self, op: str, at: int, seq: int, ready: bool) -> None:
        self.begin = at if self.begin is None else self.begin
        after: dict[Watch, list[Start]] = {}
        for watch, starts in self.live.items():
            waits = watch.pending_seq == _CARRIED and not watch.opened
            if waits:  # creates of this class that waited long enough were released before this event
                expired = [replace(s, until=at - _WAIT_US) for s in starts]
                gone = replace(watch, pending_at=None, pending_seq=None)
                after.setdefault(advance(gone, op, at, seq, ready, self.legacy)[0], []).extend(expired)
                if at - _WAIT_US >= self.begin:  # no create can be later than the stretch
                    continue
            after.setdefault(advance(watch, op, at, seq, ready, self.legacy)[0], []).extend(starts)
        if len(after) == 1:
            after = {watch: [Start()] for watch in after}
        self.live = after

    def outcomes(self) -> list[tuple[Start, Watch]]:
        pairs = [(start, watch) for watch, starts in self.live.items() for start in starts]
        pairs.sort(key=lambda pair: (bool(pair[0].pending), pair[0].opened, pair[0].closed, pair[0].until))
        # of neighbours that end alike the last stands for all
        same = lambda a, b: a[1] == b[1] and replace(a[0], until=0) == replace(b[0], until=0)
        return [pair for pair, following in zip(pairs, [*pairs[1:], None]) if following is None or not same(pair, following)]

    def step(self, before: Watch) -> Watch:
        return after_stretch(self.outcomes(), before)


def after_stretch(outcomes: Iterable[tuple[Start, Watch]], before: Watch) -> Watch:
    """State after a stretch with these outcomes, those of a class in the order of ``until``."""
    watch = next(watch for start, watch in outcomes if start.holds(before))
    return replace(watch, pending_at=before.pending_at, pending_seq=before.pending_seq) if watch.pending_seq == _CARRIED else watch


def _summarize(legacy: bool):
    """One row per piece: its first and last path, and what it makes of the last path's state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = first = last = stretch = None
        for events in batches:
            for number, path, at, seq, op, ready in events.itertuples(index=False):
                if stretch is None:
                    piece, first, last, stretch = number, path, path, Stretch(False, legacy)
                elif path != last:
                    last, stretch = path, Stretch(True, legacy)
                stretch.add(op, at, seq, ready)
        if stretch is not None:
            outcomes = [
                dict(zip(("pending", "opened", "closed", "until", "to_at", "to_seq", "to_opened", "to_closed"),
                         (s.pending, s.opened, s.closed, s.until, *_to_state(w))))
                for s, w in stretch.outcomes()
            ]
            yield pd.DataFrame({"piece": [piece], "first": [first], "last": [last], "outcomes": [outcomes]})

    return run


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the summaries in the order of the pieces: the state each piece begins with, and whether its last path ends in it."""
    rows = [r for batch in batches for r in batch.itertuples(index=False)]
    watch, path, joints = Watch(), None, []
    for i, row in enumerate(rows):
        before = watch if i and row.first == path else Watch()
        ends = i + 1 == len(rows) or rows[i + 1].first != row.last
        joints.append((row.piece, *_to_state(before), ends))
        outcomes = [
            (Start(o["pending"], o["opened"], o["closed"], o["until"]), _from_state((o["to_at"], o["to_seq"], o["to_opened"], o["to_closed"])))
            for o in row.outcomes
        ]
        watch, path = after_stretch(outcomes, before), row.last
    if joints:
        yield pd.DataFrame(joints, columns=[c.split()[0] for c in _JOINT.split(", ")])


def _walk(legacy: bool):
    """Releases of a piece's events, from the state it begins with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, watch, ends, begun = None, Watch(), True, False

        def finish() -> list[tuple]:
            due = watch.deadline()
            return [(path, *expire(watch, due)[1])] if due is not None else []

        for events in batches:
            rows: list[tuple] = []
            for p, at, seq, op, ready, *joint in events.itertuples(index=False):
                if not begun:
                    path, watch, ends, begun = p, _from_state(tuple(joint[:4])), joint[4], True
                elif p != path:
                    rows += finish()
                    path, watch = p, Watch()
                watch, releases = advance(watch, op, at, seq, ready, legacy)
                rows += [(p, *r) for r in releases]
            if rows:
                yield _release_frame(rows)
        if ends and (rows := finish()):
            yield _release_frame(rows)

    return run


def ready_table(normalized: DataFrame, legacy: bool = False, pieces: int | None = None) -> DataFrame:
    """Batch twin of ``ready_stream`` over a complete log.

    The log is cut into ``pieces`` of about equal length in the order of path and time, wherever that
    falls, so a path with a third of all events lies in a third of the pieces. Each piece tells what it
    makes of every state its path may come with; one row per piece is then enough to know the state
    each begins with, and all pieces are walked side by side. Nothing is held in memory but one batch.
    """
    events = normalized.select(
        "path", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "op", "ready", (F.col("op") != "deleted").alias("last")
    )
    ranged = events.repartitionByRange(*([pieces] if pieces else []), *_EVENT).sortWithinPartitions(*_EVENT).drop("last")
    # both passes must see the same pieces, so they are stored as they are
    stored = checkpointed(ranged.withColumn("piece", F.spark_partition_id()))
    summaries = stored.select("piece", "path", "at", "seq", "op", "ready").mapInPandas(_summarize(legacy), _SUMMARY)
    joints = summaries.repartition(1).sortWithinPartitions("piece").mapInPandas(_link, _JOINT)
    begun = stored.join(F.broadcast(joints), "piece")  # one row per piece
    return begun.select("path", "at", "seq", "op", "ready", "in_at", "in_seq", "in_opened", "in_closed", "ends").mapInPandas(_walk(legacy), RELEASED)


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process everything available into a Parquet table and stop; restartable from its checkpoint."""
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


SinkStep = Callable[[DataFrame, int], None]


def run_batches(stream: DataFrame, step: SinkStep, checkpoint: str) -> None:
    """Feed every micro-batch to an idempotent step; events before a load are replayed from the checkpoint."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
