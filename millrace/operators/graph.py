"""PageRank over an edge table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.checkpoints import checkpoint_timed
from millrace.session import store

# Fixed values of the rank formula.
DAMPING = 0.85
BASE_RANK = 0.15

# Sources may be hot in at most this many cases, so the table of them can be broadcast whatever the graph's size.
MAX_HOT = 100_000


def out_degree(edges: DataFrame) -> DataFrame:
    """src, degree: number of distinct neighbours."""
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def pagerank(
    edges: DataFrame, iterations: int = 100, checkpoint_every: int = 10, hot_degree: int = 1_000_000
) -> DataFrame:
    """node, rank after `iterations` rounds of rank = 0.15 + 0.85 * sum(rank / degree over in-links).

    Every node with an out-link starts at 1.0. Duplicate edges count once, nodes without in-links leave after
    the first round, nodes without out-links pass nothing on.

    Links and degrees are hash-partitioned by source once and kept; a round's ranks come out of their
    aggregation partitioned by node the same way, so a round shuffles only its partial sums. A source with more
    than `hot_degree` links (or than a 100,000th of all, if that is more) is split into slices of about that
    many. The plan grows with each round:
    `checkpoint_every` rounds the ranks are checkpointed (0: never, for few rounds only).
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = store(edges.select("src", "dst").filter(F.col("src").isNotNull()).distinct(), "links")
    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    degrees = degrees.repartition(parts, "src").sortWithinPartitions("src").persist(
        StorageLevel.MEMORY_AND_DISK)
    size = degrees.agg(F.sum("degree").alias("links"), F.max("degree").alias("degree")).head()
    # No more than links / limit sources are above the limit: that bounds the broadcast to MAX_HOT rows.
    limit = max(hot_degree, (size.links or 0) // MAX_HOT)
    split = (size.degree or 0) > limit
    slices_of = F.ceil(F.col("degree") / limit).cast("int").alias("slices")
    keys = ["src"]
    if split:
        hot = degrees.filter(F.col("degree") > limit).select("src", slices_of)
        slices = F.coalesce("slices", F.lit(1))
        links = links.join(F.broadcast(hot), "src", "left").select(
            "src", "dst", F.pmod(F.hash("dst"), slices).alias("slice"))
        keys = ["src", "slice"]
    links = links.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)

    ranks = degrees.select("src", "degree", F.lit(1.0).alias("rank"))
    for done in range(1, iterations + 1):
        shares = ranks.select("src", (F.col("rank") / F.col("degree")).alias("share"), slices_of)
        if split:
            shares = shares.select("src", "share", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        ranked = (
            links.join(shares, keys).groupBy("dst")
            .agg((F.lit(BASE_RANK) + F.lit(DAMPING) * F.sum("share")).alias("rank"))
            .withColumnRenamed("dst", "src")
        )
        if checkpoint_every and done % checkpoint_every == 0 and done < iterations:
            ranked, _ = checkpoint_timed(ranked, f"ranks of round {done}")
        ranks = ranked.join(degrees, "src") if done < iterations else ranked
    # The result is small next to the links: write it, and give their memory back.
    result = store(ranks.select(F.col("src").alias("node"), "rank"), "ranks")
    links.unpersist()
    degrees.unpersist()
    return result
