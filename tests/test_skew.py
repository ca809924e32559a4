"""Joins whose left side has a third of its rows under one key are split at run time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import orders, runs

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def final_plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.toString()


def hot(spark, key):
    return spark.range(0, 400_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000).alias(key), F.col("id").alias("taskId"),
        F.lit(3).alias("numTasks"), F.col("id").alias("goods_price"))


def test_hot_stage(spark, small_partitions):
    tc = spark.range(20_000).select(F.col("id").alias("stageId"), F.rand(1).alias("tcMinStage"))
    df = runs.add_tc_per_task(hot(spark, "stageId"), tc)
    assert "skew=true" in final_plan(df) and df.count() == 400_000


def test_hot_order(spark, small_partitions):
    listed = spark.range(20_000).select(F.col("id").alias("order_id"), F.lit("d").alias("order_date"))
    items = hot(spark, "order_id").select("order_id", "goods_price")
    assert "skew=true" in final_plan(orders.join_orders(listed, items))
    # Totals need no splitting: one row per order and task is shuffled.
    totals = orders.order_totals(listed, items)
    assert totals.filter("order_id = 0").head().sum_goods_price == sum(
        i for i in range(400_000) if i % 3 == 0 or i % 20_000 == 0)
