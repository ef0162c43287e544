"""The change feed: detector rules, stream against batch, incremental tables against a rebuild."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hayloft import schemas as S
from hayloft.operators import lexical
from hayloft.streaming import feed
from hayloft.streaming.maintain import Layer, LiveTables, cover
from tests.rows import catalog_rows
from tests.test_edits import frame

START = dt.datetime(2024, 1, 1)


def log(spark, events):
    rows = [(i, START + dt.timedelta(seconds=t), op, path, dest, False) for i, (t, op, path, dest) in enumerate(events)]
    return spark.createDataFrame(rows, S.CHANGES)


def released(df):
    return sorted((r.path, r.op, round((r.ready_at - START).total_seconds(), 3)) for r in df.collect())


def run(spark, events, **options):
    return released(feed.ready_table(feed.normalize(log(spark, events)), **options))


def test_copy_is_released_on_close(spark):
    assert run(spark, [(0, "created", "a", None), (0.1, "opened", "a", None), (5, "closed", "a", None)]) == [("a", "created", 5.0)]


def test_move_into_the_directory_is_released_after_a_second(spark):
    assert run(spark, [(0, "created", "a", None)]) == [("a", "created", 1.0)]


def test_events_out_of_order(spark):
    assert run(spark, [(0, "opened", "a", None), (1, "closed", "a", None), (2, "created", "a", None)]) == [("a", "created", 2.0)]


def test_never_closed_is_never_released(spark):
    assert run(spark, [(0, "created", "a", None), (0.5, "opened", "a", None)]) == []
    assert run(spark, [(0, "created", "a", None), (0.5, "opened", "a", None)], legacy=True) == [("a", "created", 1.0)]


def test_delete_cancels_a_pending_create(spark):
    assert run(spark, [(0, "created", "a", None), (0.5, "deleted", "a", None)]) == [("a", "deleted", 0.5)]


def test_moves_and_ignored_names(spark):
    events = [(0, "moved", "/d/a", "/d/b"), (1, "moved", "/d/x", "/d/c"), (2, "moved", "/d/e", "/d/x"), (3, "moved", "/d/f", "/else/f"), (4, "created", "/d/x", None)]
    rows = feed.normalize(log(spark, events), ["x"], "/d").collect()
    assert sorted((r.seq, r.op, r.path, r.ready) for r in rows) == [
        (0, "created", "/d/b", True), (0, "deleted", "/d/a", True), (1, "created", "/d/c", True), (2, "deleted", "/d/e", True), (3, "deleted", "/d/f", True),
    ]


def random_events(seed, n=240, paths=12):
    rng = random.Random(seed)
    t, out = 1.0, []
    for _ in range(n):
        t += rng.choice([0.01, 0.2, 0.9, 1.5])
        op = rng.choice(["created", "opened", "closed", "deleted", "moved"])
        out.append((round(t, 2), op, f"/d/f{rng.randrange(paths)}", f"/d/f{rng.randrange(paths)}" if op == "moved" else None))
    return out


def streamed(spark, events, tmp, pieces):
    """The events as a stream of several micro-batches, then a late event that moves the watermark."""
    end = max(e[0] for e in events) + 3600
    df = log(spark, [*events, (end, "opened", "/d/end", None)])
    n = len(events)
    for i in range(pieces):
        part = df.where((F.col("seq") >= n * i // pieces) & (F.col("seq") < n * (i + 1) // pieces + (i == pieces - 1)))
        part.coalesce(1).write.mode("append").parquet(f"{tmp}/log")
    return feed.normalize(feed.read_changes(spark, f"{tmp}/log", files_per_trigger=1))


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    events = random_events(4)
    stream = feed.ready_stream(streamed(spark, events, tmp_path, 6), delay="10 minutes")
    feed.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert released(spark.read.parquet(f"{tmp_path}/out")) == run(spark, events)


def plainly(events, legacy=False):
    """Releases by one walk over each path's events; ``events`` are (at, op, ready), numbered as they come."""
    watch, out = feed.Watch(), []
    for seq, (at, op, ready) in enumerate(events):
        watch, releases = feed.advance(watch, op, at, seq, ready, legacy)
        out += releases
    return watch, out


def one_path(rng, n, ops):
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([0, 10_000, 300_000, 400_000, 1_000_000, 1_500_000])
        out.append((at, rng.choice(ops), rng.random() < 0.2))
    return out


def test_a_stretch_knows_the_state_after_it_for_every_state_before():
    rng = random.Random(2)
    for trial in range(600):
        legacy = trial % 3 == 0
        ops = [["created"], ["created", "created", "created", "opened", "closed"], ["created", "opened", "closed", "deleted", "modified"]][trial % 5 % 3]
        events = one_path(rng, rng.randrange(2, 40), ops)
        if trial % 2:
            events = [(at, op, False) for at, op, _ in events]
        cut = rng.randrange(1, len(events))
        before, _ = plainly(events[:cut], legacy)
        stretch = feed.Stretch(False, legacy)
        for seq, (at, op, ready) in list(enumerate(events))[cut:]:
            stretch.add(op, at, seq, ready)
        assert stretch.step(before) == plainly(events, legacy)[0], (trial, events, cut)


def test_one_path_in_many_pieces(spark):
    rng = random.Random(5)
    for ops in (["created", "opened", "closed", "deleted"], ["created", "created", "opened", "closed"], ["created"]):
        hot = [(at / 1e6, op, "/d/hot", None) for at, op, _ in one_path(rng, 400, ops)]
        rest = [(t, op, path, None) for t, op, path, _ in random_events(3, 200, 20) if op != "moved"]
        events = feed.normalize(log(spark, hot + rest))
        whole = released(feed.ready_table(events, pieces=1))
        assert whole and released(feed.ready_table(events, pieces=9)) == whole
        assert released(feed.ready_table(events, True, 9)) == released(feed.ready_table(events, True, 1))
        seen = [("/d/hot", op, round(at / 1e6, 3)) for op, _, at in plainly([(round(t * 1e6), op, False) for t, op, _, _ in hot])[1]]
        end = plainly([(round(t * 1e6), op, False) for t, op, _, _ in hot])[0].deadline()
        assert [r for r in whole if r[0] == "/d/hot"] == sorted(seen + ([("/d/hot", "created", round(end / 1e6, 3))] if end is not None else []))


def test_the_log_is_cut_evenly_and_an_empty_log_releases_nothing(spark):
    hot = [(i * 0.4, "created", "/d/hot", None) for i in range(3000)]
    events = feed.normalize(log(spark, hot))
    plan = feed.ready_table(events, pieces=6)
    sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id().alias("piece")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    assert released(feed.ready_table(events.where("false"), pieces=4)) == []


def test_live_tables_equal_a_rebuild_and_survive_a_replay(spark, tmp_path):
    everything = frame(spark, catalog_rows(12))
    live = LiveTables(spark, f"{tmp_path}/live", everything.where("id % 2 = 0"))
    seen = []

    def step(batch, batch_id):
        batch.persist()
        live.apply(batch, batch_id, lambda names: everything.join(names, "name", "left_semi"))
        if batch_id == 1:  # the same batch again, as after a crash before the commit
            live.apply(batch, batch_id, lambda names: everything.join(names, "name", "left_semi"))
        seen.append(batch_id)
        batch.unpersist()

    events = random_events(9, 120)
    feed.run_batches(feed.ready_stream(streamed(spark, events, tmp_path, 3), delay="10 minutes"), step, f"{tmp_path}/state")
    assert len(seen) >= 3
    fate = {f"f{i}": i % 2 == 0 for i in range(12)}
    for path, op, at in sorted(run(spark, events), key=lambda r: (r[2], r[1] == "created")):
        fate[path.rsplit("/", 1)[1]] = op == "created"
    assert {r.name for r in live.files().collect()} == {name for name, there in fate.items() if there}
    rebuilt = lexical.build_index(lexical.indexable_texts(live.files()))
    for a, b in zip(rebuilt[:2], live.index()[:2]):
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_a_micro_batch_is_walked_once(spark, tmp_path):
    everything = frame(spark, catalog_rows(8))
    live = LiveTables(spark, f"{tmp_path}/live", everything.where("id < 4"))
    walked = spark.sparkContext.accumulator(0)

    def walk(frames):
        for rows in frames:
            walked.add(len(rows))
            yield rows

    events = [("/d/f1", "deleted", 1, None), ("/d/f2", "created", 2, None), ("/d/f6", "created", 3, None), ("/d/f6", "deleted", 4, None), ("/d/f7", "created", 5, None)]
    schema = "path string, op string, seq long, ready_at timestamp"
    batch = spark.createDataFrame(events, schema).mapInPandas(walk, schema)
    live.apply(batch, 0, lambda names: everything.join(names, "name", "left_semi"))
    assert walked.value == len(events)
    assert {r.name for r in live.files().collect()} == {"f0", "f2", "f3", "f7"}


def test_cover_takes_the_widest_layers_once():
    single = [Layer(i, i, 0) for i in range(7)]
    wide = [Layer(0, 1, 1), Layer(2, 3, 1), Layer(0, 3, 2), Layer(4, 5, 1)]
    assert cover(single + wide, -1) == [Layer(0, 3, 2), Layer(4, 5, 1), Layer(6, 6, 0)]
    assert cover(single + wide, -1, before=3) == [Layer(0, 1, 1), Layer(2, 2, 0)]
    assert cover(single + wide, 1) == [Layer(2, 3, 1), Layer(4, 5, 1), Layer(6, 6, 0)]
    assert cover([], -1) == []


def counted(df):
    return sorted(map(repr, df.collect()))


def test_folded_layers_compaction_and_pixels_equal_a_rebuild(spark, tmp_path):
    def pixels(files):
        rows = files.where("ftype <> 'audio'").select(
            F.col("id").alias("item_id"), F.when(F.col("ftype") == "image", "C").otherwise("V").alias("kind"),
            F.lit(0).alias("frame"), F.array(F.col("id").cast("float"), F.length("description").cast("float")).alias("vec"), F.lit(None).cast("string").alias("text_sha"),
        )
        return rows

    everything = frame(spark, catalog_rows(9))
    live = LiveTables(spark, f"{tmp_path}/live", everything.where("id < 6"), pixels=pixels, fold=2)
    fate = {r["name"]: r for r in everything.where("id < 6").collect()}
    # the text of a file changes to another of the same length and back: lengths cancel out, postings do not
    steps = [
        {"f1": "a dog", "f7": None}, {"f1": "a cow", "f2": "gone"}, {"f1": "a cat", "f2": None, "f8": None},
        {"f4": "gone", "f7": "gone"}, {"f4": None, "f1": "a dog"},
    ]
    rows = {r["name"]: r for r in everything.collect()}
    for batch_id, step in enumerate(steps):
        new = {n: {**rows[n].asDict(), **({"description": t} if t else {})} for n, t in step.items() if t != "gone"}
        batch = spark.createDataFrame(
            [(f"/d/{n}", "deleted" if t == "gone" else "created", batch_id * 10 + i) for i, (n, t) in enumerate(step.items())], "path string, op string, seq long"
        )
        described = spark.createDataFrame([tuple(r[c] for c in everything.columns) for r in new.values()], everything.schema)
        for _ in range(1 + batch_id % 2):  # every other batch runs twice
            live.apply(batch, batch_id, lambda names: described.join(names, "name", "left_semi"))
        fate = {n: r for n, r in {**fate, **new}.items() if step.get(n) != "gone"}
        if batch_id == 3:
            assert cover(live.layers(), -1) == [Layer(0, 3, 2)]
            live.compact()
            assert live.base_until() == 3 and not live.layers()
            live.apply(batch, batch_id, lambda names: described.limit(0))  # already in the base
            assert not live.layers()
        now = spark.createDataFrame([tuple(r[c] for c in everything.columns) for r in fate.values()], everything.schema)
        assert counted(live.files().select(*now.columns)) == counted(now)
        if batch_id not in (2, 4):  # folded layers, then a compacted base and a new layer
            continue
        rebuilt = lexical.build_index(lexical.indexable_texts(now))
        for a, b in zip(rebuilt[:2], live.index()[:2]):
            assert counted(a) == counted(b.select(*a.columns))
        fresh = LiveTables(spark, f"{tmp_path}/fresh-{batch_id}", now, pixels=pixels).vectors()
        assert counted(fresh) == counted(live.vectors().select(*fresh.columns))
    assert len(cover(live.layers(), live.base_until())) == 1
    text = live.index().postings._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in text and "Generate" not in text  # nothing is tokenized when read
