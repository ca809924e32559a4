"""Rows dealt into groups of a bounded size, whatever their ids.

A group's number is a hash of the whole row, so rows without an id, or with the same one, are spread. Rows equal in all
columns can't be told apart: where they are more than a group together, one of them stands for all, with their number.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a row counts for besides its text.
ROW_BYTES = 64


def fresh(name: str, columns: Collection[str]) -> str:
    """`name`, or with marks added to it a name that is none of `columns`, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that hold maps, which have no order, as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))


def dealt(docs: DataFrame, group_bytes: int, part: str, copies: str) -> DataFrame:
    """`docs` with the number of their group, and of the rows that each row stands for."""
    columns, name = [F.col(f"`{c}`") for c in docs.columns], fresh("__row", docs.columns)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    row = row_hash(docs)
    total = docs.agg(F.sum(size)).head()[0] or 0
    same = docs.groupBy(row.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    # At most total / group_bytes of them.
    heavy = [r[0] for r in same.filter((F.col("n") > 1) & (F.col("bytes") > group_bytes)).select(name).collect()]
    once = docs.select(*columns, row.alias(name), F.lit(1).cast("long").alias(copies))
    if heavy:
        marks = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in heavy], f"{name} long"))
        many = once.join(marks, name, "left_semi").groupBy(name).agg(F.first(F.struct(*columns)).alias("r"), F.count(F.lit(1)).alias("n"))
        many = many.select(*(F.col("r")[c].alias(c) for c in docs.columns), name, F.col("n").alias(copies))
        once = once.join(marks, name, "left_anti").select(many.columns).unionAll(many)
    return once.withColumn(part, F.pmod(name, F.lit(max(1, -(-total // group_bytes))))).drop(name)


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Every row as often as it stands for others, without their number."""
    name = fresh("__i", rows.columns)
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop(name, copies)
