"""Gradient-boosted regression on text rows of label and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import cast_all, key_share, max_width, widen
from millrace.session import shared_dir, store

#: The column of a row's weight in the learner.
WEIGHT = "__rows"


def feature_matrix(labelled: DataFrame, width: int | None = None) -> DataFrame:
    """label, feature0, feature1, … as doubles from `label`, `features` (numbers separated by a blank).

    As wide as the longest row, found with one pass more over the data unless `width` tells it. Missing
    features and junk are null.
    """
    split = labelled.select("label", F.split("features", " ").alias("features"))
    return cast_all(widen(split, "features", width if width is not None else max_width(split, "features")))


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features", invalid: str = "keep") -> DataFrame:
    """The columns as one vector; with `keep` nulls become NaN."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid=invalid).transform(df)


def split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Random parts. Which row goes where follows the rows' order in their partitions, see `split_by_key`."""
    return df.randomSplit(list(weights), seed)


def split_by_key(df: DataFrame, key: str, weights: Sequence[int], name: str = "part") -> DataFrame:
    """Add the number of the part a row belongs to, by its key alone, so that it is the same in every run.

    Weights are whole numbers; integer keys take their remainder, others that of their hash.
    """
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    place = F.pmod(F.col(key) if whole else F.xxhash64(key), F.lit(sum(weights)))
    bounds = [sum(weights[: i + 1]) for i in range(len(weights))]
    part: Column = F.lit(len(weights) - 1)
    for i in reversed(range(len(weights) - 1)):
        part = F.when(place < bounds[i], i).otherwise(part)
    return df.withColumn(name, part)


def part_by_share(key: Sequence[str | Column], weights: Sequence[float], seed: int = 0) -> Column:
    """The number of the part a row belongs to, by a hash of its key: random parts that no partitioning changes."""
    place, part = key_share(key, f"part{seed}"), F.lit(len(weights) - 1)
    for i in reversed(range(len(weights) - 1)):
        part = F.when(place < round(sum(weights[:i + 1]) / sum(weights) * 2**32), i).otherwise(part)
    return part


def gbt_regression(
    train: DataFrame, label: str, features: Sequence[str], iterations: int = 100,
    checkpoint_interval: int = -1, seed: int = 42,
) -> PipelineModel:
    """Assemble `features` and fit one tree per iteration.

    Rows of equal features become one, with their mean label and their number as its weight: to squared errors that is the same,
    and the passes of the learner are over as many rows as there are distinct features. The interval is always set: left alone,
    tree learners checkpoint every ten rounds once a folder is known.
    """
    shared_dir(train.sparkSession)
    target = F.col(label).cast("double")
    # A missing label is an error of the learner, so a mean does not pass over it.
    alike = store(train.groupBy(*features).agg(
        F.when(F.count(target) == F.count(F.lit(1)), F.avg(target)).alias(label), F.count(F.lit(1)).cast("double").alias(WEIGHT)), "alike")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(labelCol=label, featuresCol="features", weightCol=WEIGHT, maxIter=iterations, seed=seed,
                       checkpointInterval=checkpoint_interval)
    return Pipeline(stages=[assembler, gbt]).fit(alike)


def describe_model(model: PipelineModel) -> str:
    """The learned trees as text."""
    return model.stages[-1].toDebugString


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: the root mean squared error."""
    return df.agg(F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(label), 2))).alias("rmse"))
