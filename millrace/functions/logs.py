"""What driver logs say about checkpoints, from frames of lines: log, columns that order the lines, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import regex_all
from millrace.operators.ordering import number_rows

LINE_ORDER = ("block", "line")

# The messages of Spark that carry checkpoint times, checkpointed RDDs and application ids.
CHECKPOINT_TIME = r"Checkpointing took\s(\d{%d,})\sms"
CHECKPOINT_RDD = r"Done\scheckpointing\sRDD\s(\d+)\sto"
LOCAL_APP_ID = r"(local-\d+)\.inprogress"
CLUSTER_APP_ID = r"/job-event-log/(spark-\w+)\.inprogress"


def _matches(lines: DataFrame, hint: str, pattern: str, name: str, order: Sequence[str], as_int: bool) -> DataFrame:
    """log, order columns, pos, name: a row per match. Lines without `hint` are dropped before the regex runs."""
    return lines.filter(F.col("value").contains(hint)).select(
        "log", *order, F.posexplode(regex_all("value", pattern, 1, as_int)).alias("pos", name))


def log_checkpoint_times(lines: DataFrame, order: Sequence[str] = LINE_ORDER, min_digits: int = 2) -> DataFrame:
    """The checkpoint times in a log, in ms. Times of a single digit do not count unless `min_digits` is 1."""
    return _matches(lines, "Checkpointing took", CHECKPOINT_TIME % min_digits, "tcMs", order, True)


def log_checkpoint_rdds(lines: DataFrame, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """The ids of the RDDs a log reports as checkpointed."""
    return _matches(lines, "checkpointing", CHECKPOINT_RDD, "rddId", order, True)


def log_app_id(lines: DataFrame, local: bool = False, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """The first application id of each log: log, app_id. A minimum by position, so no log is sorted."""
    found = _matches(lines, ".inprogress", LOCAL_APP_ID if local else CLUSTER_APP_ID, "app_id", order, False)
    return found.groupBy("log").agg(F.min_by("app_id", F.struct(*order, "pos")).alias("app_id"))


def zip_matches(lines: DataFrame, order: Sequence[str] = LINE_ORDER, min_digits: int = 2) -> DataFrame:
    """log, rddId, tcMs: the n-th checkpoint time of a log belongs to its n-th checkpointed RDD.

    The longer list is cut; of an RDD named twice the later time stays.
    """
    def found(kind: str, pattern: str) -> Column:
        return F.transform(
            regex_all("value", pattern, 1, True), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))

    # Both kinds come out of one reading of the log.
    both = F.concat(found("time", CHECKPOINT_TIME % min_digits), found("rdd", CHECKPOINT_RDD))
    mentioned = F.col("value").contains("Checkpointing took") | F.col("value").contains("checkpointing")
    matches = lines.filter(mentioned).select("log", *order, F.posexplode(both).alias("pos", "m")).select(
        "log", *order, "pos", "m.kind", "m.found")
    numbered = number_rows(matches, [*order, "pos"], by=["log", "kind"], name="n")
    pairs = numbered.groupBy("log", "n").agg(
        F.max(F.when(F.col("kind") == "rdd", F.col("found"))).alias("rddId"),
        F.max(F.when(F.col("kind") == "time", F.col("found"))).alias("tcMs"),
    ).filter(F.col("rddId").isNotNull() & F.col("tcMs").isNotNull())
    return pairs.groupBy("log", "rddId").agg(F.max_by("tcMs", "n").alias("tcMs"))
