"""Multi-party perspective rotation for chat data (operator 8), in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and every other speaker as a user with a name; system turns stay system turns and are no
participants. The training mask marks what the assistant says: content and end mark, not the header.

A conversation is rendered whole. Where ``most_turns`` is given, longer ones come in pieces of so many
turns, counted by rank and not by turn number; pieces without anything to train on are left out. The rank
comes from buckets of turn numbers, whose sizes are summed up, so that a conversation that holds much of the
table is sorted by many tasks. Offsets count characters from the start of the piece's text.

Defined results: a null text is an empty turn; a null speaker is called ``unknown``; a null turn comes
first; equal turn numbers are ordered by speaker and text, repeated rows are rendered as often as they
come; rows with a null conversation are one conversation; a conversation of system turns only has no
participant and no rows; an empty table gives an empty result; other columns are ignored. Turns of one
number, and those without, are sorted by one task, as are the bucket sizes of one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxlake.llm.shared import only

#: Turn numbers of a bucket.
BUCKET = 256
SYSTEM = "system"
#: Marks of the rendered form. Fixed values.
HEAD, TAIL = "<|{}|>\n", "<|end|>\n"


def _segments() -> Column:
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(mine, "assistant").otherwise("user")
    name = F.when(role == "user", F.concat("speaker", F.lit(": "))).otherwise("")
    head = F.concat(F.lit(HEAD.split("{}")[0]), role, F.lit(HEAD.split("{}")[1]), name)
    return F.struct(
        F.col("place"), head.alias("head"), F.concat("text", F.lit(TAIL)).alias("body"), mine.alias("train")
    )


def _masks(segments: Column) -> Column:
    """[start, end) of every trained body; a segment knows where it ends, so a dialogue of any length takes one pass."""
    return F.transform(
        F.filter(segments, lambda x: x["segment"]["train"]),
        lambda x: F.struct((x["end"] - F.length(x["segment"]["body"])).cast("int").alias("start"), x["end"].cast("int").alias("end")),
    )


def ranked(turns: DataFrame) -> DataFrame:
    """``turns`` with ``rank``: the place of each row in its conversation, from 0."""
    bucketed = turns.withColumn("bucket", F.floor(F.col("turn") / BUCKET))  # null for null turns, which come first
    sizes = bucketed.groupBy("conv_id", "bucket").agg(F.count("*").alias("held"))
    in_buckets = Window.partitionBy("conv_id").orderBy(F.col("bucket").asc_nulls_first())
    before = sizes.select(
        F.col("conv_id").alias("of_id"), F.col("bucket").alias("of_bucket"), (F.sum("held").over(in_buckets) - F.col("held")).alias("before")
    )
    inside = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    return (
        bucketed.withColumn("place", F.row_number().over(inside) - 1)
        .join(before, F.col("conv_id").eqNullSafe(F.col("of_id")) & F.col("bucket").eqNullSafe(F.col("of_bucket")))
        .select("conv_id", "speaker", "text", (F.col("before") + F.col("place")).alias("rank"))
    )


def rotated(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    most_turns: int | None = None,
) -> DataFrame:
    """(conv_id, perspective, piece, n_turns, text, mask) for every participant.

    mask is an array of struct<start, end> over the characters of text. ``piece`` is 0 unless ``most_turns``
    cuts the conversation.
    """
    turns = only(conversations, conversation, turn, speaker, text).select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    piece = F.floor(F.col("rank") / most_turns).cast("long") if most_turns else F.lit(0).cast("long")
    placed = ranked(turns).select("conv_id", "speaker", "text", piece.alias("piece"), F.col("rank").alias("place"))
    # who speaks in a piece has something to train on there
    people = (
        placed.where(F.col("speaker") != SYSTEM)
        .select(F.col("conv_id").alias("of"), F.col("piece").alias("of_piece"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    seen = placed.join(people, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("of_piece")))
    one = ["conv_id", "perspective", "piece"]
    shown = seen.select(*one, _segments().alias("segment"))
    size = F.length("segment.head") + F.length("segment.body")
    upto = F.sum(size).over(Window.partitionBy(*one).orderBy("segment.place").rowsBetween(Window.unboundedPreceding, 0))
    return (
        shown.withColumn("end", upto)
        .groupBy(*one)
        .agg(F.sort_array(F.collect_list(F.struct("segment", "end"))).alias("segments"))
        .select(
            "conv_id",
            "perspective",
            "piece",
            F.size("segments").cast("long").alias("n_turns"),
            F.array_join(F.transform("segments", lambda x: F.concat(x["segment"]["head"], x["segment"]["body"])), "").alias("text"),
            _masks(F.col("segments")).alias("mask"),
        )
    )
