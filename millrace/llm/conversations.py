"""Logged conversations: cumulative snapshots collapse to the longest one, which is then rendered for training.

A log often holds a conversation again after every turn. Each turn is numbered in its conversation, and the turns up to
it are known by rolling sums: over the turns, of hashes of (number, role, text). Two conversations begin alike where
number and sums are equal, whatever their ids. A conversation is dropped if its whole is a proper beginning of another,
or equals a conversation with a smaller conv_id; anti-joins against the distinct beginnings leave the maximal ones.

Turns are ordered by (turn, role, text); a turn that is logged twice with the same role and text counts once. A null role
or text is a value of its own, and so is a null conv_id, which is smallest. Numbers and sums are carried over partitions, so
a conversation may hold any share of all rows. Three sums of 31-bit hashes tell beginnings apart: two different ones are
taken for equal with a probability of about 2**-93.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import Scratch

LANES = ("s0", "s1", "s2")
_ORDER = ("turn", "role", "text")


def turns(conversations: DataFrame) -> DataFrame:
    """The distinct turns with h0, h1, h2, ready to be numbered."""
    return conversations.select("conv_id", "turn", "role", "text").distinct()


def _hash(lane: int, *columns: Column) -> Column:
    # Nulls don't change a hash; whether a value is null is therefore hashed too.
    marked = [x for c in columns for x in (c, c.isNull())]
    return F.pmod(F.xxhash64(F.lit(lane), *marked), F.lit(2**31))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (the turn's number from 1) and s0, s1, s2 (sums over turns 1 to n).

    Rows are range-partitioned by (conversation, order) and stored; a partition adds to its first conversation what the
    partitions before hold of it: at most one row per partition is sent.
    """
    room = Scratch(conversations.sparkSession, "turns")
    order = ["conv_id", *_ORDER]
    laid = turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = room.store(laid.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    inside = Window.partitionBy("part", "conv_id").orderBy("at")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, sums: list[str]) -> DataFrame:
        """`sums` of a conversation's rows in earlier partitions, where there are any."""
        total = rows.groupBy("part", "conv_id").agg(*(F.sum(c).alias(c) for c in sums))
        before = total.select("part", "conv_id", *(F.sum(c).over(earlier).alias(f"before_{c}") for c in sums))
        return F.broadcast(before.filter(f"before_{sums[0]} IS NOT NULL").withColumnsRenamed({"part": "of_part", "conv_id": "of_conv"}))

    def with_carried(rows: DataFrame, sums: list[str]) -> DataFrame:
        other = carried(rows, sums)
        same = (rows["part"] == other["of_part"]) & rows["conv_id"].eqNullSafe(other["of_conv"])
        running = {c: (F.sum(c).over(inside) + F.coalesce(F.col(f"before_{c}"), F.lit(0))).alias(c) for c in sums}
        kept = [c for c in rows.columns if c not in sums]
        return rows.join(other, same, "left").select(*kept, *running.values())

    numbered = with_carried(laid.withColumn("n", F.lit(1).cast("long")), ["n"])
    hashed = numbered.withColumns({
        name: _hash(i, F.col("n"), F.col("role"), F.col("text")) for i, name in enumerate(LANES)})
    return with_carried(hashed, list(LANES)).drop("part", "at")


def maximal(conversations: DataFrame) -> DataFrame:
    """The turns of `prefixes` that belong to maximal conversations, and `turns`, how many the conversation has."""
    known = Scratch(conversations.sparkSession, "prefixes").store(prefixes(conversations))
    whole = known.groupBy("conv_id").agg(F.max_by(F.struct("n", *LANES), "n").alias("w")).select("conv_id", "w.*")
    # Equal conversations: the one with the smallest id.
    first = whole.groupBy("n", *LANES).agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"))
    sizes = whole.select(F.col("conv_id").alias("of_conv"), F.col("n").alias("turns"))
    proper = known.join(sizes, known["conv_id"].eqNullSafe(sizes["of_conv"])).filter("n < turns").select("n", *LANES).distinct()
    kept = first.join(proper, ["n", *LANES], "left_anti").select(F.col("conv_id").alias("kept_conv"), F.col("n").alias("turns"))
    return known.join(kept, known["conv_id"].eqNullSafe(kept["kept_conv"])).drop("kept_conv")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, n, role, rendered, trained: a row per turn of every maximal conversation.

    `rendered` is the turn in its markers; a conversation's text is its turns in order of n. `trained` marks the turns a
    model learns to write, those of the assistant. Turns stay rows, as a conversation has no bound.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rendered = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))
    return maximal(conversations).select(
        "conv_id", "turns", "n", "role", rendered.alias("rendered"), (role == "assistant").alias("trained"))


def join_turns(rendered: DataFrame) -> DataFrame:
    """conv_id, turns, text: whole conversations, for logs whose conversations each fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct("n", "rendered")))
    return rendered.groupBy("conv_id", "turns").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("text"))
