"""How often rows are shuffled, with broadcasts off and plans as they are before they run."""

from __future__ import annotations

import os
import re

import pytest

from millrace.operators import orders, runs
from millrace.plans import bindings
from millrace.session import store
from millrace.sources import eventlog


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    return len(re.findall(r"Exchange (?!SinglePartition)", df._jdf.queryExecution().executedPlan().toString()))


def test_each_side_of_the_order_totals_is_shuffled_once(spark, no_broadcast):
    listed = store(spark.range(50).selectExpr("id AS order_id", "current_date() AS order_date"))
    items = store(spark.range(500).selectExpr("id % 50 AS order_id", "1.5D AS goods_price"))
    assert exchanges(orders.order_totals(listed, items)) == 2


def test_tasks_of_a_report_meet_their_stage_in_one_join(spark, no_broadcast, monkeypatch):
    stored = []
    monkeypatch.setattr(runs, "store", lambda df, label: stored.append(store(df, label)) or stored[-1])
    report = runs.run_report(spark.createDataFrame([("a", "{}")], eventlog.EVENTS))
    tasks = re.findall(r"/(tasks-[0-9a-f]+)", report._jdf.queryExecution().executedPlan().toString())
    assert len(stored) == 2 and len(tasks) == 1


def test_null_and_ragged_points_stay(spark):
    from millrace.operators import clustering

    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [9.0, 9.0]), (6, [])], "id int, point array<double>")
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 8.0])], "cluster long, centre array<double>")
    got = {r.id: (r.cluster, r.distance) for r in clustering.kmeans_assign(points, centres).collect()}
    assert got == {1: (0, 1.0), 5: (1, 1.0), **dict.fromkeys((2, 3, 4, 6), (None, None))}


def test_distances_are_held_a_few_at_a_time(spark, monkeypatch):
    from millrace.operators import clustering

    monkeypatch.setattr(clustering, "MAX_DISTANCES", 7)
    points = spark.range(100).selectExpr("id", "array(cast(id AS double)) AS point")
    centres = spark.createDataFrame([(i, [10.0 * i]) for i in range(10)], "cluster long, centre array<double>")
    got = {r.id: r.cluster for r in clustering.kmeans_assign(points, centres).collect()}
    assert got == {i: min(range(10), key=lambda c: (abs(i - 10 * c), c)) for i in range(100)}


def test_no_log_line_is_shuffled_and_logs_are_packed(spark, folder):
    spark.range(400).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "timestamp '2024-01-01' AS o_orderdate", "id * 1.5D AS o_totalprice",
        "if(id % 2 = 0, 'F', 'O') AS o_orderstatus", "'1-URGENT' AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    spark.range(4000).selectExpr(
        "id % 400 AS l_orderkey", "cast(id % 7 + 1 AS int) AS l_linenumber", "id AS l_partkey", "id % 5 AS l_suppkey", "1.0D AS l_quantity",
        "2.0D AS l_extendedprice", "timestamp '2024-01-02' AS l_shipdate", "'R' AS l_returnflag", "'O' AS l_linestatus",
    ).write.parquet(f"{folder}/lineitem.parquet")
    lines = bindings.event_lines(spark, folder)
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in lines.inputFiles())
    text_size = lines.selectExpr("sum(length(value)) AS n").head().n
    assert lines.count() > 8000 and size < text_size / 3


def test_a_large_group_meets_its_median_in_pieces(spark, folder, monkeypatch):
    monkeypatch.setattr(bindings, "ROWS_PER_PIECE", 100)
    spark.range(1000).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "if(id % 10 = 0, null, id % 3) AS l_suppkey", "id * 1.5D AS l_extendedprice",
    ).write.parquet(f"{folder}/lineitem.parquet")
    found = bindings.approx_medians(spark, folder)
    assert "piece" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(-1, 1000, True), (0, 300, True), (1, 300, True), (2, 300, True)]


def test_writing_event_logs_sorts_rows_once_and_no_lines(spark, folder, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.readwriter import DataFrameWriter
    spark.range(40).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(10.5).alias("o_totalprice"),
        F.lit("1996-01-02").cast("timestamp_ntz").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(120).select(
        (F.col("id") % 40).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(3).cast("long").alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(9.5).alias("l_extendedprice"),
        F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit("1996-02-02").cast("timestamp_ntz").alias("l_shipdate"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    plans, write = [], DataFrameWriter.text

    def seen(self, path, *args, **options):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", seen)
    lines = bindings.event_lines(spark, folder)
    # Opened into rows the lines would lose the order of the rows, and the writer would sort them all again.
    assert len(plans) == 3 and not any("Generate" in plan for plan in plans)
    assert lines.filter(F.col("value").contains("JobStart")).count() == 40
    done = sum(i % 7 + 1 < 6 for i in range(120))
    assert lines.filter(F.col("value").contains("TaskEnd")).count() == 2 * done
    assert lines.filter(F.col("value").contains("TaskStart")).count() == 120
