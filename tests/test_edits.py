"""Edits against a program that applies them one by one; incremental results against rebuilds."""

import random

from hayloft.operators import edits, lexical
from tests.rows import catalog_rows


def by_hand(files, log):
    state = {f["id"]: dict(f) for f in files}
    for seq, item, op, value in sorted(log):
        f = state.get(item)
        if f is None:
            continue
        if op == "description" and f["description"] != value.strip():
            f["description"] = value.strip()
        if op == "transcript" and f["transcript"] != value.strip():
            f["transcript"], f["is_transcript_fixed"] = value.strip(), True
        if op == "ocr" and f["ocr_text"] != value.strip():
            f["ocr_text"] = value.strip()
        if op == "screenshot" and f["ftype"] == "image" and f["is_screenshot"] != (value == "true"):
            f["is_screenshot"], f["ocr_text"] = value == "true", ""
    return state


def random_log(seed, n=300):
    rng = random.Random(seed)
    log = []
    for seq in range(n):
        op = rng.choice(["description", "transcript", "ocr", "screenshot"])
        value = rng.choice(["true", "false"]) if op == "screenshot" else rng.choice(["", " cat ", "dogs run\n", "t1", "o2"])
        log.append((seq, rng.randint(0, 25), op, value))
    return log


def test_edits_equal_sequential_application(spark):
    files = catalog_rows(20)
    columns = ("description", "transcript", "is_transcript_fixed", "ocr_text", "is_screenshot")
    for seed in (1, 2, 3):
        log = random_log(seed)
        df = edits.apply_edits(frame(spark, files), spark.createDataFrame(log, "seq long, item_id long, op string, value string"))
        want = by_hand(files, log)
        for r in df.collect():
            assert [r[c] for c in columns] == [want[r.id][c] for c in columns], (seed, r.id)


def frame(spark, rows):
    from hayloft.schemas import FILES

    return spark.createDataFrame([tuple(r.get(n) for n in FILES.names) for r in rows], FILES)


def test_incremental_index_equals_rebuild(spark):
    before = frame(spark, catalog_rows(20))
    after = edits.apply_edits(before, spark.createDataFrame(random_log(7), "seq long, item_id long, op string, value string"))
    rebuilt = lexical.build_index(lexical.indexable_texts(after))
    delta = edits.index_delta(edits.text_effects(before, after))
    live = lexical.apply_delta(lexical.build_index(lexical.indexable_texts(before)), delta)
    for a, b in zip(rebuilt[:2], live[:2]):
        b = b.select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_missing_and_empty_text_are_the_same(spark):
    rows = catalog_rows(1)
    old, new = dict(rows[0], transcript=None, is_transcript_analyzed=True), dict(rows[0], transcript="", is_transcript_analyzed=True)
    effects = edits.text_effects(frame(spark, [old]), frame(spark, [new])).where("field = 'transcript'")
    assert effects.count() == 0


def test_failed_enrichment_keeps_the_text_and_sets_the_flag(spark):
    files = frame(spark, [dict(catalog_rows(1)[0], transcript="old", is_transcript_analyzed=False)])
    produced = spark.createDataFrame([(0, None)], "id long, text string")
    row = edits.merge_enrichment(files, produced, "transcript", "is_transcript_analyzed").first()
    assert row.transcript == "old" and row.is_transcript_analyzed
