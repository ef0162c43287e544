"""Table schemas and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
FILE_TYPES = ("image", "video", "audio", "other")
TEXT_FIELDS = ("description", "ocr", "transcript", "caption")
VARIANT_WEIGHTS = {"original": 1.5, "lemma": 1.0}
BM25_K1 = 1.5
BM25_B = 0.75
EXACT_MATCH_EXTRA_TOKENS = 50
MISSING_TOKEN_SCORE = 2.0
FIELD_WEIGHTS = {"description": 0.5, "ocr": 0.3, "transcript": 0.2}
TEXT_KIND_WEIGHTS = {"D": 0.5, "O": 0.3, "T": 0.2}
CLIP_KIND_WEIGHTS = {"C": 0.5, "V": 0.5}
CAPTION_WEIGHTS = {"lexical": 0.9, "semantic": 1.0}
HYBRID_WEIGHTS = {"lexical": 1.0, "semantic": 1.0, "clip": 1.0}
RRF_K = 60
SECONDS_PER_FRAME = 3.0
SEGMENT_SECONDS = 29
MIN_SEGMENT_SECONDS = 0.5
MIN_BOX_PROBABILITY = 0.1
MIN_WORD_FREQUENCY = 1e-6
MIN_CAPTION_CHARS = 70
MS_PER_FRAME_STEP = 20
CREATE_WAIT_SECONDS = 1.0
# (language, profile, retriever) -> (low, high) score range of the confidence curve
CONFIDENCE_RANGES = {
    ("en", "any", "semantic"): (0.55, 0.70),
    ("pl", "gpu", "semantic"): (0.15, 0.45),
    ("pl", "cpu", "semantic"): (0.94, 0.96),
    ("en", "any", "clip"): (0.24, 0.32),
}
# search-mode marker -> metric name; no marker means hybrid
SEARCH_MODES = {
    "lex": "combined_lexical",
    "sem": "combined_semantic",
    "dlex": "description_lexical",
    "dsem": "description_semantic",
    "olex": "ocr_lexical",
    "osem": "ocr_semantic",
    "tlex": "transcript_lexical",
    "tsem": "transcript_semantic",
    "clip": "clip",
    "llm": "caption",
}
TYPE_MARKERS = ("image", "video", "audio")
# --- end of fixed values ----------------------------------------------------

# embedding kind -> the catalog text it is computed from; C and V come from pixels
KIND_TEXT_FIELD = {"D": "description", "O": "ocr", "T": "transcript", "L": "caption"}

FILES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("added_at", T.TimestampNTZType()),
        T.StructField("description", T.StringType()),
        T.StructField("ftype", T.StringType()),
        T.StructField("is_transcript_analyzed", T.BooleanType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("is_transcript_fixed", T.BooleanType()),
        T.StructField("is_ocr_analyzed", T.BooleanType()),
        T.StructField("is_screenshot", T.BooleanType()),
        T.StructField("ocr_text", T.StringType()),
        T.StructField("is_llm_description_analyzed", T.BooleanType()),
        T.StructField("llm_description", T.StringType()),
        T.StructField("embedding_generation_failed", T.BooleanType()),
        T.StructField("lemmatized_description", T.StringType()),
        T.StructField("lemmatized_ocr_text", T.StringType()),
        T.StructField("lemmatized_transcript", T.StringType()),
        T.StructField("lemmatized_llm_description", T.StringType()),
    ]
)

DIRECTORIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("fs_path", T.StringType(), False),
        T.StructField("primary_language", T.StringType()),
        T.StructField("should_generate_llm_descriptions", T.BooleanType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("item_id", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("frame", T.IntegerType(), False),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("text_sha", T.StringType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("dest_path", T.StringType()),
        T.StructField("is_directory", T.BooleanType()),
    ]
)

# stored tables of the index, in partitions by bucket
POSTINGS = "field string, variant string, token string, item_id long, tf long, dl long, bucket int"
TOKEN_STATS = "field string, variant string, token string, df long, max_tf long, min_dl long, bucket int"
