r"""Chat formatting by perspective rotation.

For every participant of a conversation (each role but ``system``) the dialogue is
rendered once with that participant as the assistant: their turns are training
targets (mask 1), everyone else speaks as a user under their own name, system
turns stay system turns (mask 0).

A rendering is returned turn by turn, with the offsets of each segment and of its
masked part in the whole rendering, so a conversation of any length is never
gathered into one row or task: all turns are put in order by one sort over ranges and
cut into blocks of ``BLOCK`` turns; offsets come from sums per block, then running sums
within a block.  Turns without number, or with equal ones, are dealt like any others.

Defined results: a conversation of system turns only has no perspective and no
rows; null roles count as ``unknown`` and null texts as empty; in roles and texts
``<|`` becomes ``<\|``, and a line feed in a role a space, so that no turn can hold
the marks of another; rows with a null conv_id form one conversation; turns without
number come first, equal turn numbers are ordered by role and text, equal rows are
all rendered; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import staged

BLOCK = 4096


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def perspectives(turns: DataFrame, tag: str = "chat") -> DataFrame:
    """conv_id, perspective, turn, role, speaks_as, segment, start, after, mask_start, mask_after, mask."""
    # The conversation as a struct: equality then holds for a null conv_id too, and every step deals rows by the same key.
    role = F.replace(_plain(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), F.lit(" "))
    base = turns.select(F.struct("conv_id").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text"))
    # Equal rows are told apart by where they lie, so that they need not share a task.
    order = ["conv", "turn", "role", "text", "salt"]
    base = base.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    base = staged(base.drop("salt").withColumn("seq", F.monotonically_increasing_id()), tag)
    who = base.where("role <> 'system'").select("conv", F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    speaks = F.when(own, "assistant").when(F.col("role") == "system", "system").otherwise("user")
    head = F.concat(F.lit("<|start|>"), speaks, F.when(speaks == "user", F.concat(F.lit(" name="), F.col("role"))).otherwise(F.lit("")), F.lit("\n"))
    end = F.lit("<|end|>\n")
    size = (F.length(head) + F.length("text") + F.length(end)).cast("long")
    # Segments are put together last, so that a text travels once per perspective.
    rows = base.join(who, "conv").withColumn("size", size).withColumn("block", F.floor(F.col("seq") / BLOCK))
    whole = ["conv", "perspective"]
    sums = rows.groupBy(*whole, "block").agg(F.sum("size").alias("held"))
    base_of = Window.partitionBy(*whole).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*whole, "block", F.coalesce(F.sum("held").over(base_of), F.lit(0)).alias("base"))
    run = Window.partitionBy(*whole, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(run), F.lit(0))).join(sums, [*whole, "block"])
    start = F.col("base") + F.col("within")
    return rows.select(
        "conv.conv_id",
        "perspective",
        "turn",
        "role",
        speaks.alias("speaks_as"),
        F.concat(head, "text", end).alias("segment"),
        start.alias("start"),
        (start + F.col("size")).alias("after"),
        F.when(own, start + F.length(head)).alias("mask_start"),
        F.when(own, start + F.col("size") - 1).alias("mask_after"),
        F.when(own, 1).otherwise(0).alias("mask"),
    )
