"""Conversation rendering: prompt strings and chat-message lists, one row per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IMAGE_TURN = "<image>\n"


def _pieces(turns: DataFrame, sep: str, sep2: str, style: str):
    """Text of each turn. Turn i ends with the first or the second separator in alternation."""
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    numbered = turns.withColumn("i", i)
    closing = F.when(F.col("i") % 2 == 0, sep).otherwise(sep2)
    message = F.col("text")
    present = F.coalesce(message != "", F.lit(False))
    if style == "role":
        piece = F.when(present, F.concat("role", F.lit(": "), message, closing)).otherwise(F.concat("role", F.lit(":")))
    elif style == "plain":
        piece = F.when(present, F.concat(message, closing)).otherwise("")
    elif style == "alignment":
        shown = F.when(F.col("i") % 2 == 0, IMAGE_TURN).otherwise(message)
        piece = F.when(present, F.concat(shown, closing)).otherwise("")
    elif style == "instruct":
        tag = F.when(F.col("i") % 2 == 0, "[INST]").otherwise("[/INST]")
        spoken = F.when(F.col("i") == 0, F.concat(message, F.lit(" "))).otherwise(F.concat(tag, F.lit(" "), message, closing))
        piece = F.when(present, spoken).otherwise(tag)
    else:
        raise ValueError(f"unknown style: {style}")
    return numbered.withColumn("piece", piece)


def prompts(turns: DataFrame, system: str = "", sep: str = "\n\n", sep2: str = "</s>", style: str = "role") -> DataFrame:
    """(conv_id, prompt) from ``turns(conv_id, turn, role, text)``.

    Styles: ``role`` (``role: text``, an open turn is just ``role:``), ``plain``, ``alignment`` (even
    turns are an image mark) and ``instruct``.
    """
    lead = {"role": system + sep if system else "", "instruct": system or "[INST] "}.get(style, "")
    in_order = F.sort_array(F.collect_list(F.struct("i", "piece")))
    return (
        _pieces(turns, sep, sep2, style)
        .groupBy("conv_id")
        .agg(F.concat(F.lit(lead), F.array_join(F.transform(in_order, lambda p: p["piece"]), "")).alias("prompt"))
    )


def chat_messages(turns: DataFrame, system: str = "") -> DataFrame:
    """(conv_id, messages): a system message, then user and assistant in alternation.

    An assistant turn without text is left out.
    """
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    role = F.when(F.col("i") % 2 == 0, "user").otherwise("assistant")
    spoken = turns.withColumn("i", i).where((F.col("i") % 2 == 0) | F.col("text").isNotNull())
    in_order = F.sort_array(F.collect_list(F.struct("i", role.alias("role"), F.col("text").alias("content"))))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    rest = F.transform(in_order, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return spoken.groupBy("conv_id").agg(F.concat(first, rest).alias("messages"))
