"""Readers for the text inputs of the workloads."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.columns import key_share
from millrace.session import path_exists
from millrace.sources import schemas

logger = logging.getLogger(__name__)


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, sep: str = "|") -> DataFrame:
    """Delimited text without header under a declared schema.

    Values that do not fit their type, and columns missing at the end of a line, become null.
    """
    return spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def read_orders(spark: SparkSession, path: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    return sample_rows(read_delimited(spark, path, schemas.ORDERS), fraction, seed)


def read_order_items(spark: SparkSession, path: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    return sample_rows(read_delimited(spark, path, schemas.ORDER_ITEMS), fraction, seed)


def sample_rows(df: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """A Bernoulli sample; fraction 1.0 keeps every row and adds nothing to the plan."""
    return df if fraction >= 1.0 else df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_by_key(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """A Bernoulli sample that takes a row or not by a hash of its key: the same rows however `df` is partitioned.

    A filter in the scan, without a shuffle. Rows of one key go together; other seeds take other rows.
    """
    return df.filter(key_share(key, seed) < round(fraction * 2**32))


def read_run_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with header. Without a schema the types are inferred, at the cost of one more pass over the files."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_capped(
    spark: SparkSession, glob: str, n: int = 10_000,
    order: Sequence[str | Column] = (), schema: str | StructType | None = None,
) -> DataFrame:
    """The first `n` rows of all files of a glob (CSV with header, gzip allowed).

    `order` makes the choice repeatable and is planned as a top-n: no full sort. Without it any n rows come.
    """
    rows = read_run_table(spark, glob, schema)
    return (rows.orderBy(*order) if order else rows).limit(n)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """`label,f1 f2 …` lines, both columns as text."""
    return read_delimited(spark, path, schemas.LABELLED, sep=",")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """One point per line, numbers separated by a blank, as `array<double>`; junk numbers are null."""
    return spark.read.text(path).select(
        F.transform(F.split("value", " "), lambda x: x.try_cast("double")).alias("point"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (src, dst) of whitespace-separated lines; what follows the second field is ignored."""
    fields = F.split("value", r"\s+")
    return (
        spark.read.text(path)
        .select(F.get(fields, F.lit(0)).alias("src"), F.get(fields, F.lit(1)).alias("dst"))
        .filter(F.col("dst").isNotNull())
        .distinct()
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with columns that give their order: log, block, line, value.

    `log` is the file, `block` the offset at which the reading task's split of it starts. A split is read in
    order, so (block, line) orders the lines of a file however many tasks read it. `line` is not a line number.
    """
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("log"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A driver log by line, or no lines and a warning if there is no such file."""
    return or_empty(spark, lambda: read_lines(spark, path), "log string, block long, line long, value string", path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document per line: doc_id, text. Ids are unique and follow the order of the lines in a file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def stopword_table(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a stop-word file, however many, as `word`."""
    return (
        spark.read.text(path)
        .select(F.explode(F.split("value", r"\s+")).alias("word"))
        .filter(F.col("word") != "").distinct()
    )


def read_stopwords(spark: SparkSession, path: str, limit: int = 200_000) -> list[str]:
    """The words of a stop-word file, in sorted order, to hand to every task.

    A file of more than `limit` words is refused; `stopword_table` takes any, for `text.drop_words`.
    """
    words = stopword_table(spark, path).limit(limit + 1).collect()
    if len(words) > limit:
        raise ValueError(f"{path} holds more than {limit} words; read it with stopword_table")
    return sorted(row.word for row in words)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table stored at `path`; computed and stored there first if it is not there yet.

    Only a folder with the marker of a finished write counts; what a failed writer left is replaced.
    """
    if path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    df = compute()
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: str | StructType, what: str) -> DataFrame:
    """`read()`, or an empty frame and a warning if its input does not exist."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        logger.warning("nothing found at %s, no rows are returned", what)
        return spark.createDataFrame([], schema)
