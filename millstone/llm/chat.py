"""Operator 1: multi-party perspective rotation (DataFrame functions only).

``rotate`` renders every conversation once per participant: in a
participant's view their own turns are the assistant's, every other speaker
is a named user, and system turns stay system turns. The loss mask is the
list of character ranges that hold the assistant's words.

Shape of the job: the turns of a conversation are numbered by (turn, speaker, text) with a bucketed prefix sum, whatever their turn
numbers are, and cut into *parts* of ``part_turns`` turns, so a conversation of any length, or many rows with one turn
number or without conversation, never land in one task. Equal rows are numbered as one with a count. A part is joined with the speakers of its
conversation, one row each. Concatenating the parts of
a view in ``part`` order gives the whole dialogue; mask offsets are relative
to the part's text.

Defined results: a null speaker is called ``unknown``; a null text is empty; a null
turn sorts first; rows with null conversation ids form
one conversation; turns with equal numbers are ordered by speaker and text,
repeated rows are rendered as often as they occur; a conversation with system
turns only gives no view; control strings inside a text or a name are broken
up so that they cannot open or close a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import materialize, pick
from millstone.operators.order import range_bucket, running_sum

# chat markup (parameters of rotate)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM_ROLES = ("system",)
PART_TURNS = 128
HEAD = 64  # characters of a text that take part in the bucket borders of the numbering


def _plain(c: Column) -> Column:
    """Text with the markup strings broken up."""
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           system_roles: tuple[str, ...] = SYSTEM_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_assistant, text, mask array<struct<start,end>>)."""
    t = pick(turns, conv_id=conv, turn=turn, speaker=speaker, text=text).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.regexp_replace(_plain(F.coalesce("speaker", F.lit("unknown"))), r"[\r\n]+", " ").alias("speaker"),
        _plain(F.coalesce("text", F.lit(""))).alias("text"))
    rows = materialize(t.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("n")), "chat-turns")
    rows = rows.withColumn("start", F.substring("text", 1, HEAD))
    at = running_sum(rows, ["turn", "speaker", "start", "text"], "at", ["conv_id"], weight=F.col("n"),
                     bucket=range_bucket(rows, ["turn", "speaker", "start"]))
    at = at.select("conv_id", "turn", "speaker", "text", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"))
    parts = (at.groupBy("conv_id", F.floor(F.col("at") / part_turns).alias("part"))
             .agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns")))

    who = rows.select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct().where(~F.col("perspective").isin(*system_roles))
    views = parts.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def head(m: Column) -> Column:
        role = (F.when(m["speaker"].isin(*system_roles), m["speaker"])
                .when(m["speaker"] == F.col("perspective"), F.lit("assistant"))
                .otherwise(F.concat(F.lit("user name="), m["speaker"])))
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    tail = CLOSE + "\n"
    views = views.withColumn("m", F.transform("turns", lambda m: F.struct(
        head(m).alias("head"), m["text"].alias("text"),
        ((m["speaker"] == F.col("perspective")) & ~m["speaker"].isin(*system_roles)).alias("own"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"),
                    F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["head"])
        end = start + F.length(m["text"])
        one = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct((end + len(tail)).cast("bigint").alias("at"),
                        F.when(m["own"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("m", zero, step, lambda acc: acc["spans"])
    return views.select(
        "conv_id", "perspective", "part", F.size("m").cast("bigint").alias("n_turns"),
        F.size(F.filter("m", lambda m: m["own"])).cast("bigint").alias("n_assistant"),
        F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["text"], F.lit(tail))), "").alias("text"),
        mask.alias("mask"))
