"""Connected components of a graph given as a table of edges, and stored tables that are removed after use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import delete_path, scratch_path


class Scratch:
    """Tables written to the shared folder for one operator; `drop` removes the ones no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def store(self, df: DataFrame, **options: str | int) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        df.write.option("compression", "zstd").options(**options).parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = (path, stored)
        return stored

    def drop(self, *stored: DataFrame) -> None:
        for df in stored:
            delete_path(self.spark, self.paths.pop(id(df))[0])


@contextmanager
def rows_at_a_time(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand tasks at most so many rows at a time, for wide rows. Holds for what runs inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, room: Scratch) -> DataFrame:
    """node, component for every node of `edges` (a, b); a component is named by its smallest node.

    In every round a node takes the smallest of itself and its neighbours as its parent, and then its parent's parent.
    Edges are redrawn between parents; those inside one parent go, so what is left shrinks from round to round until no
    edge is left. A hot node is only ever a group that is reduced by minimum.
    """
    def drawn(a: str, b: str):
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    live = room.store(edges.select(*drawn("a", "b")).filter("a <> b").distinct())
    names = room.store(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not live.isEmpty():
        both = live.union(live.select("b", "a")).toDF("node", "other")
        parents = both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent"))
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        parents = room.store(parents.join(above, "parent").select("node", F.col("further").alias("parent")))
        renamed = room.store(names.join(parents.withColumnRenamed("node", "component"), "component", "left").select(
            "node", F.coalesce("parent", "component").alias("component")))
        redrawn = live.join(parents.toDF("a", "pa"), "a").join(parents.toDF("b", "pb"), "b").filter("pa <> pb")
        redrawn = room.store(redrawn.select(*drawn("pa", "pb")).distinct())
        room.drop(live, names, parents)
        live, names = redrawn, renamed
    room.drop(live)
    return names
