"""Multi-party perspective rotation of dialogues (operator 5).

For every participant of a conversation, the dialogue is rendered with that
speaker as assistant and all others as named users: a header per turn, the text,
an end mark. The loss mask covers the text and end mark of the assistant's turns.
A system turn is context for everyone: it is rendered as system and has no
perspective of its own (unless the conversation has no other role).

A rendering is returned as its segments, one row per turn and perspective, with
each segment's place in the rendering. So a conversation of any length or number
of speakers is never gathered; concatenating segments by turn_index gives the
rendering. Places are sums over blocks of TURNS_A_BLOCK turn numbers and then
within a block.

Turns are ordered by turn number (null first), then role and text. Equal rows
are counted and take consecutive places. Null texts are empty, null roles are the
speaker "unknown"; a null conv_id is one conversation, other than that of a text
"null". Texts of any length are kept whole; extra columns aren't looked at. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURNS_A_BLOCK = 256
END = "<|end|>\n"
SYSTEM = "system"


def header(role, perspective):
    """Column: what introduces a turn of ``role`` in the rendering for ``perspective``."""
    name = (
        F.when(role == perspective, F.lit("assistant")).when(role == SYSTEM, F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), role))
    )
    return F.concat(F.lit("<|"), name, F.lit("|>\n"))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn_index, role, segment, start, mask_start, mask_end.

    Lengths and places count code points; mask_start = mask_end where nothing is learned.
    """
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
        .withColumn("key", key)
        .withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-(2**62))) / TURNS_A_BLOCK))
    )
    people = rows.select("key", "role").distinct()
    speakers = people.where(F.col("role") != SYSTEM)
    only = people.join(speakers.select("key").distinct(), "key", "left_anti")
    speakers = speakers.union(only).withColumnRenamed("role", "perspective")
    shown = header(F.col("role"), F.col("perspective"))
    mine = F.col("role") == F.col("perspective")
    sized = rows.join(speakers, "key").withColumns(
        {"segment": F.concat(shown, F.col("text"), F.lit(END)), "head": F.char_length(shown).cast("long"), "mine": mine}
    )
    sized = sized.withColumn("size", F.char_length("segment").cast("long"))
    # sums of whole blocks, then within each block
    group = ["key", "perspective"]
    before = W.partitionBy(group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sized.groupBy(*group, "block").agg(F.sum(F.col("size") * F.col("n")).alias("chars"), F.sum("n").alias("turns"))
    starts = blocks.select(
        *group,
        "block",
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
    )
    within = (
        W.partitionBy(*group, "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, -1)
    )
    placed = sized.withColumn("chars_in", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))).withColumn(
        "turns_in", F.coalesce(F.sum("n").over(within), F.lit(0))
    )
    copy = F.col("copy")
    start = F.col("chars_before") + F.col("chars_in") + copy * F.col("size")
    return (
        placed.join(starts, [*group, "block"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("start", start)
        .select(
            "conv_id",
            "perspective",
            (F.col("turns_before") + F.col("turns_in") + copy).alias("turn_index"),
            "role",
            "segment",
            "start",
            F.when(F.col("mine"), F.col("start") + F.col("head")).otherwise(F.col("start")).alias("mask_start"),
            F.when(F.col("mine"), F.col("start") + F.col("size")).otherwise(F.col("start")).alias("mask_end"),
        )
    )
