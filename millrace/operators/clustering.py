"""KMeans on array columns: fitting, cost, and the nearest of given centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.checkpoints import checkpoint_timed
from millrace.operators.ordering import number_rows
from millrace.session import store

# Numbers of centre coordinates that one function carries to the tasks (8 bytes each). More centres stay a table.
MAX_COORDINATES = 4_000_000
# Distances that a task holds at a time.
MAX_DISTANCES = 4_000_000

# Where centres are too many to travel with a function: centres that the others are grouped around, numbers in a block of
# centres, and points that meet a block in one group.
PIVOTS, BLOCK_COORDINATES, POINTS_PER_GROUP = 256, 1 << 18, 50_000


def to_vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def kmeans_fit(
    df: DataFrame, k: int, iterations: int = 100, seed: int = 42, point: str = "point", checkpoint: bool = False
) -> KMeansModel:
    """KMeans that runs all its iterations (no tolerance) unless the centres stop moving.

    With `checkpoint` the parsed points are checkpointed first.
    """
    points = df.select(to_vector(point).alias("features"))
    if checkpoint:
        points, _ = checkpoint_timed(points, "points")
    points = points.persist()
    try:
        return KMeans(k=k, maxIter=iterations, tol=0.0, seed=seed).fit(points)
    finally:
        points.unpersist()


def kmeans_centres(model: KMeansModel, spark: SparkSession) -> DataFrame:
    """cluster, centre of a fitted model."""
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster long, centre array<double>")


def kmeans_summary(model: KMeansModel, df: DataFrame, point: str = "point") -> DataFrame:
    """cluster, size, cost, centre of a fitted model over `df`; the costs add up to the model's."""
    centres = kmeans_centres(model, df.sparkSession)
    assigned = kmeans_assign(df.select(point), centres, point)
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("distance").alias("cost"))
    return sums.join(centres, "cluster")


def group_means(df: DataFrame, group: str, point: str = "point") -> DataFrame:
    """cluster, centre: the mean point per group."""
    mean = Summarizer.mean(to_vector(point))
    return df.groupBy(F.col(group).alias("cluster")).agg(vector_to_array(mean).alias("centre"))


def _compared(points: np.ndarray, centres: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) and centres without the points' own norms, in one array."""
    out = points @ centres.T
    out *= -2.0
    out += norms
    return out


def _nearest(numbers: np.ndarray, centres: np.ndarray):
    """A function from points to (cluster, squared distance) of the nearest of these centres.

    A point that is null, has a null coordinate, or another number of coordinates than the centres has neither.
    """
    norms = (centres * centres).sum(axis=1)
    # Points are compared a few at a time, so that points times centres stay below a fixed number of distances.
    step = max(1, MAX_DISTANCES // max(len(centres), centres.shape[1]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for points in batches:
            length = points.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            values = points.flatten()
            holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            ends = np.cumsum(np.maximum(length, 0))
            whole = (length == centres.shape[1]) & (holes[ends] == holes[ends - np.maximum(length, 0)])
            x = values.fill_null(0).to_numpy(zero_copy_only=False).astype("float64", copy=False)
            x = x[np.repeat(whole, np.maximum(length, 0))].reshape(-1, centres.shape[1])
            best, distance = np.zeros(len(x), dtype="int64"), np.zeros(len(x))
            for at in range(0, len(x), step):
                part = x[at:at + step]
                found = _compared(part, centres, norms).argmin(axis=1)
                best[at:at + step] = found
                distance[at:at + step] = ((part - centres[found]) ** 2).sum(axis=1)
            place = np.cumsum(whole) - 1
            missing = pa.array(~whole)
            cluster = pa.array(numbers[best][place] if len(x) else np.zeros(len(points), "int64"), mask=~whole)
            yield pa.StructArray.from_arrays(
                [cluster, pa.array(distance[place] if len(x) else np.zeros(len(points)), mask=~whole)], names=["cluster", "distance"],
                mask=missing)

    return F.arrow_udf(find, "cluster long, distance double")


def kmeans_assign(
    points: DataFrame, centres: DataFrame, point: str = "point", max_coordinates: int = MAX_COORDINATES
) -> DataFrame:
    """Add cluster and distance (squared) of the nearest centre; of equally near ones the lowest number.

    `centres` holds cluster and centre. Up to `max_coordinates` numbers travel with the function: no shuffle, and no row per
    (point, centre). More centres stay a table, see `nearest_of_many`. Points that are null, ragged, or have a null
    coordinate stay, with null in both.
    """
    listed = centres.select("cluster", F.col("centre").cast("array<double>").alias("centre"))
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centre")).alias("width")).head()
    if not size.n:
        raise ValueError("no centres")
    if size.n * size.width > max_coordinates:
        return nearest_of_many(points, listed, point)
    rows = listed.orderBy("cluster").collect()
    found = _nearest(np.array([r.cluster for r in rows], dtype="int64"), np.array([r.centre for r in rows]))
    return points.withColumn("__best", found(point)).select(
        *points.columns, F.col("__best.cluster").alias("cluster"), F.col("__best.distance").alias("distance"))


def _bounds(pivots: np.ndarray, blocks: np.ndarray, all_within: bool):
    """A function from points to the number of a block, or from batches of __row, __point, __seen, __limit to `blocks` of each.

    A block's centres are at distances from `low` to `high` of its pivot, so none is nearer to a point than the point's own
    distance from the pivot is outside of these. The block with the least of such bounds, or `all_within` the distance.
    """
    norms, pivot = (pivots * pivots).sum(axis=1), blocks[:, 0].astype(np.int64)
    step = max(1, MAX_DISTANCES // max(len(blocks), len(pivots), pivots.shape[1]))

    def bounded(points: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = points.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(-1, pivots.shape[1])
        for at in range(0, len(x), step):
            part = x[at:at + step]
            away = np.sqrt(np.maximum(_compared(part, pivots, norms) + (part * part).sum(axis=1)[:, None], 0))[:, pivot]
            yield at, away, np.maximum(np.maximum(away - blocks[:, 2], blocks[:, 1] - away), 0)

    if all_within:
        # Points can be near to most blocks, so their lists leave for a few points at a time.
        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                limits = batch.column("__limit").to_numpy(zero_copy_only=False)
                for at, _, least in bounded(batch.column("__point")):
                    # A little more than the bound, as distances are rounded.
                    row, found = np.nonzero(least <= (np.sqrt(limits[at:at + step]) * (1 + 1e-9) + 1e-9)[:, None])
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(least)))])
                    part = batch.slice(at, len(least))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("__row"), part.column("__point"), part.column("__seen"),
                         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int64()))],
                        ["__row", "__point", "__seen", "blocks"])

        return within

    def first(points: pa.Array) -> pa.Array:
        # Of the blocks with the least bound, mostly 0, the one around the nearest pivot.
        found = [np.where(least <= least.min(axis=1, keepdims=True), away, np.inf).argmin(axis=1) for _, away, least in bounded(points)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())

    return F.arrow_udf(first, "long")


def _visited(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """__row, cluster, distance: the nearest centre in the block of each pair (__row, __point, block).

    Pairs of a block that many points ask for are dealt into groups, each of which meets the block once.
    """
    groups = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / POINTS_PER_GROUP).cast("int").alias("groups"))
    groups = store(groups, "groups")
    asked = pairs.join(F.broadcast(groups), "block").select(
        "__row", "__point", "block", F.pmod(F.xxhash64("__row"), F.col("groups")).cast("int").alias("group"))
    held = blocks.join(F.broadcast(groups), "block").select(
        "block", "clusters", "centres", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))

    def nearest(points: pa.Table, block: pa.Table) -> pa.Table:
        row = points["__row"].combine_chunks()
        cluster = block["clusters"][0].values.to_numpy()
        centres = block["centres"][0].values.to_numpy().reshape(len(cluster), -1)
        x = points["__point"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
        norms, step = (centres * centres).sum(axis=1), max(1, MAX_DISTANCES // max(len(centres), centres.shape[1]))
        best, distance = np.zeros(len(x), "int64"), np.zeros(len(x))
        for at in range(0, len(x), step):
            part = x[at:at + step]
            found = _compared(part, centres, norms).argmin(axis=1)
            best[at:at + step] = cluster[found]
            distance[at:at + step] = ((part - centres[found]) ** 2).sum(axis=1)
        return pa.table({"__row": row, "cluster": best, "distance": distance})

    return asked.groupBy("block", "group").cogroup(held.groupBy("block", "group")).applyInArrow(
        nearest, "__row long, cluster long, distance double")


def nearest_of_many(points: DataFrame, centres: DataFrame, point: str = "point") -> DataFrame:
    """`kmeans_assign` for any number of centres, which stay a partitioned table.

    Centres are grouped around PIVOTS of them and, by distance from their pivot, into blocks of BLOCK_COORDINATES numbers. A
    point first meets the block that is most likely to hold its nearest centre; what it finds there rules out all blocks
    that can't hold a nearer one (triangle inequality), and it meets the others. The driver holds the pivots and three
    numbers for each block.
    """
    spark = points.sparkSession
    chosen = centres.orderBy(F.xxhash64("cluster"), "cluster").limit(PIVOTS).collect()
    pivots = np.array([r.centre for r in chosen])
    placed = centres.withColumn("__p", _nearest(np.arange(len(pivots)), pivots)("centre")).select(
        "cluster", "centre", F.col("__p.cluster").alias("pivot"), F.sqrt("__p.distance").alias("away"))
    ranked = number_rows(placed, ["away", "cluster"], by=["pivot"], name="n")
    ring = F.floor(F.col("n") / max(1, BLOCK_COORDINATES // pivots.shape[1])).alias("ring")
    # The lists are sorted by cluster, so that of equally near centres the lowest number is found.
    members = F.array_sort(F.collect_list(F.struct("cluster", "centre")))
    blocks = ranked.groupBy("pivot", ring).agg(F.min("away").alias("low"), F.max("away").alias("high"), members.alias("members")).select(
        "pivot", "ring", "low", "high", F.col("members.cluster").alias("clusters"), F.flatten("members.centre").alias("centres"))
    blocks = store(blocks, "blocks")
    known = blocks.select("pivot", "ring", "low", "high").orderBy("pivot", "ring").collect()
    bounds = np.array([[r.pivot, r.low, r.high] for r in known])
    names = spark.createDataFrame([(i, r.pivot, r.ring) for i, r in enumerate(known)], "block long, pivot long, ring long")
    blocks = blocks.join(F.broadcast(names), ["pivot", "ring"]).select("block", "clusters", "centres")
    rows = store(points.withColumn("__row", F.monotonically_increasing_id()), "points")
    numbers = F.col(point).cast("array<double>")
    whole = rows.filter((F.size(numbers) == pivots.shape[1]) & ~F.exists(numbers, lambda x: x.isNull())).select("__row", numbers.alias("__point"))
    first = whole.select("__row", "__point", _bounds(pivots, bounds, False)("__point").alias("block"))
    found = store(_visited(first, blocks), "found")
    left = whole.join(found.select("__row", F.col("distance").alias("__limit")), "__row").join(
        first.select("__row", F.col("block").alias("__seen")), "__row")
    others = left.select("__row", "__point", "__seen", "__limit").mapInArrow(
        _bounds(pivots, bounds, True), "__row long, __point array<double>, __seen long, blocks array<long>",
    ).select("__row", "__point", "__seen", F.explode("blocks").alias("block"))
    more = _visited(others.filter("block <> __seen").drop("__seen"), blocks)
    best = found.unionAll(more).groupBy("__row").agg(F.min(F.struct("distance", "cluster")).alias("__best"))
    return rows.join(best, "__row", "left").select(
        *points.columns, F.col("__best.cluster").alias("cluster"), F.col("__best.distance").alias("distance"))


def kmeans_cost(points: DataFrame, centres: DataFrame, point: str = "point") -> DataFrame:
    """One row: the sum of squared distances to the nearest centre."""
    return kmeans_assign(points, centres, point).agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("cost"))
