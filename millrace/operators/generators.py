"""Generated inputs, one row per row of an id table.

Every random number is a hash of (id, seed), so a row's values depend on nothing else: neither on how the ids
are partitioned nor on which attempt of a task computes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import linear_target, polyvander

# Range and noise of the regression rows, spread of the clusters.
X_MAX, NOISE = 10.0, 3.0
CLUSTER_DIM, CLUSTER_SPREAD = 2, 0.012

_DIGITS = 10  # hex digits per random number; an md5 holds three


def _uniforms(*parts: str | Column) -> list[Column]:
    """Three independent uniform numbers in (0, 1) from the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)))
    return [
        (F.conv(F.substring(digest, 1 + _DIGITS * i, _DIGITS), 16, 10).cast("double") + 0.5) / 16.0**_DIGITS
        for i in range(3)
    ]


def _normals(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers (Box-Muller)."""
    radius, angle = F.sqrt(-2.0 * F.ln(u1)), 2.0 * math.pi * u2
    return radius * F.cos(angle), radius * F.sin(angle)


def polynomial_rows(ids: DataFrame, dim: int, seed: int = 42, key: str = "id") -> DataFrame:
    """id, label, features: x uniform in (0, 10), label 2x + 10 + noise, features 1, x, …, x^(dim-1)."""
    u1, u2, u3 = _uniforms(F.col(key), f"poly{seed}")
    drawn = ids.select(F.col(key).alias("id"), (u1 * X_MAX).alias("x"), _normals(u2, u3)[0].alias("noise"))
    return drawn.select(
        "id", (linear_target("x") + NOISE * F.col("noise")).alias("label"), polyvander("x", dim).alias("features"))


def cluster_rows(ids: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """id, cluster, point: one of k centres, uniform in the unit square, with normal noise around it.

    A centre is a hash of its number, so no table of centres is sent around.
    """
    u1, u2, u3 = _uniforms(F.col(key), f"point{seed}")
    noise = _normals(u2, u3)
    drawn = ids.select(
        F.col(key).alias("id"), F.floor(u1 * k).cast("int").alias("cluster"),
        *(noise[i].alias(f"n{i}") for i in range(CLUSTER_DIM)))
    centre = _uniforms(F.col("cluster"), f"centre{seed}")
    return drawn.select(
        "id", "cluster",
        F.array(*(centre[i] + CLUSTER_SPREAD * F.col(f"n{i}") for i in range(CLUSTER_DIM))).alias("point"))


def gen_polynomial(spark: SparkSession, rows: int, dim: int, seed: int = 42) -> DataFrame:
    return polynomial_rows(spark.range(rows), dim, seed)


def gen_clusters(spark: SparkSession, rows: int, k: int, seed: int = 42) -> DataFrame:
    return cluster_rows(spark.range(rows), k, seed)


def write_labelled(rows: DataFrame, path: str) -> str:
    """Write label, features as `label,f1 f2 …` lines."""
    rows.select(F.concat_ws(",", F.col("label").cast("string"), F.concat_ws(
        " ", F.transform("features", lambda x: x.cast("string"))))).write.mode("overwrite").text(path)
    return path


def write_points(rows: DataFrame, path: str) -> str:
    """Write points as lines of numbers separated by a blank."""
    rows.select(F.concat_ws(" ", F.transform("point", lambda x: x.cast("string")))).write.mode("overwrite").text(path)
    return path
