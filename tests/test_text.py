import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hayloft.functions import scoring, text
from hayloft.plans import search


def column(spark, values, expr, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {schema}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aÉß ñ'-_9.,\n@#ſ中", max_size=30), min_size=1, max_size=20))
def test_tokens_follow_python_word_characters(spark, values):
    assert column(spark, values, text.tokens) == [re.findall(r"[\w'-]+", v.lower()) for v in values]


def test_markers(spark):
    raw = ["cat @lex dog", "@sem @dlex", "a @video @image b", "@!ss @ss x", "@unknown y  z ", "plain"]
    rows = spark.createDataFrame(list(enumerate(raw)), "query_id long, raw string")
    got = {r.query_id: r for r in search.parse_queries(rows).collect()}
    assert (got[0].query_text, got[0].metric) == ("cat  dog", "combined_lexical")
    assert (got[1].query_text, got[1].metric) == ("", "description_lexical")
    assert got[2].file_type == "image" and got[2].metric == "hybrid"
    assert got[3].only_screenshot and got[3].no_screenshots
    assert got[4].query_text == "y  z" and got[4].file_type is None
    assert not got[5].only_screenshot and got[5].query_text == "plain"


def test_range_confidence(spark):
    got = column(spark, [0.40, 0.475, 0.55, 0.70, 0.71], lambda c: scoring.range_confidence(c, 0.55, 0.70), "double")
    assert [round(x, 9) for x in got] == [0.0, 0.0, 0.25, 0.75, 1.0]


def test_media_time(spark):
    assert column(spark, [0.0, 61.5, 3725.25], text.media_time, "double") == ["00:00:00.00", "00:01:01.50", "01:02:05.25"]


def test_stream_kind(spark):
    reports = ["Stream #0:0: Video: h264 Stream #0:1: Audio", "stream #0: AUDIO: mp3", "nothing", "Audio before stream"]
    assert column(spark, reports, text.stream_kind) == ["video", "audio", "other", "other"]


def test_zero_vector_keeps_its_values(spark):
    assert column(spark, [[0.0, 0.0], [3.0, 4.0]], scoring.l2_normalize, "array<double>") == [[0.0, 0.0], [0.6, 0.8]]


def test_white_space_of_every_kind(spark):
    from hayloft.functions import text

    row = spark.createDataFrame([(" @lex cat　",)], "q string").select(
        text.markers(F.col("q")).alias("m"), text.without_markers(F.col("q")).alias("w"), text.split_lemmas(F.lit("a　b ")).alias("l")
    ).first()
    assert (row["m"], row["w"], row["l"]) == (["lex"], "cat", ["a", "b"])
