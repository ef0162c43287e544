"""Text columns: tokens, lemmas, query markers, clean-up, media timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hayloft import schemas as S

# --- fixed values -----------------------------------------------------------
# Word characters are spelled out: \w is ASCII-only in Java and would split accented words.
TOKEN_PATTERN = r"[\p{L}\p{N}_'-]+"
MARKER_PATTERN = r"(?U)@(\S+)"
DROPPED_LEMMAS = (".", ",", "?", "!", "-", "_", "/")
# --- end of fixed values ----------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, underscore, apostrophe and hyphen."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def strip_blank(text: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_lemmas(text: Column) -> Column:
    """Blank-separated lemma string -> array; a blank string has no lemmas."""
    return F.filter(F.split(strip_blank(text), r"(?U)\s+"), lambda t: t != "")


def join_lemmas(lemmas: Column) -> Column:
    return F.array_join(lemmas, " ")


def keep_lemma(lemma: Column) -> Column:
    """Single punctuation marks are no lemmas."""
    return ~lemma.isin(*DROPPED_LEMMAS)


def plain_stem(toks: Column) -> Column:
    """Stand-in lemmatizer over a token array: a final s goes from words of four letters on."""
    return F.transform(toks, lambda t: F.when(t.endswith("s") & (F.char_length(t) > 3), F.substring(t, F.lit(1), F.char_length(t) - 1)).otherwise(t))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def markers(raw: Column) -> Column:
    """All @-markers of a raw query, in order, without the @."""
    return F.regexp_extract_all(raw, F.lit(MARKER_PATTERN), F.lit(1))


def without_markers(raw: Column) -> Column:
    return strip_blank(F.regexp_replace(raw, MARKER_PATTERN, ""))


def last_of(found: Column, allowed) -> Column:
    """Last array element that belongs to ``allowed``, or null."""
    return F.try_element_at(F.filter(found, lambda m: m.isin(*allowed)), F.lit(-1))


def metric_of(found: Column) -> Column:
    """Search mode named by the last known mode marker; hybrid without one."""
    mode = last_of(found, tuple(S.SEARCH_MODES))
    named = reduce(lambda acc, kv: acc.when(mode == kv[0], kv[1]), S.SEARCH_MODES.items(), F)
    return F.coalesce(named, F.lit("hybrid"))


def media_time(seconds: Column) -> Column:
    """Seconds -> HH:MM:SS.ss as media tools expect it."""
    return F.format_string(
        "%02d:%02d:%05.2f",
        F.floor(seconds / 3600).cast("long"),
        F.floor(F.pmod(seconds, F.lit(3600.0)) / 60).cast("long"),
        F.pmod(seconds, F.lit(60.0)),
    )


def has_stream(report: Column, stream: str) -> Column:
    """Does a probe report (one line or many) announce a stream of this sort?"""
    return report.rlike(f"(?i)stream.+?{stream}")


def stream_kind(report: Column) -> Column:
    return (
        F.when(has_stream(report, "video"), "video")
        .when(has_stream(report, "audio"), "audio")
        .otherwise("other")
    )


def is_word_shaped(word: Column) -> Column:
    """Two letters or more, nothing but letters."""
    return word.rlike(r"^\p{L}{2,}$")
