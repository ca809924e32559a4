from __future__ import annotations

import datetime
import gzip
import logging
import os

import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from millrace.operators.clustering import kmeans_fit
from millrace.sources import schemas, sinks, text


def write(path, content):
    with open(path, "w") as file:
        file.write(content)
    return str(path)


def test_delimited_text_is_permissive(spark, folder):
    path = write(f"{folder}/items", "0|4210351682594|0|567|661.40|375117.12\n1|x|1|oops|2.0\n")
    full, short = text.read_order_items(spark, path).orderBy("order_id").collect()
    assert full.item_id == 4210351682594 and full.goods_price == 375117.12 and full.goods_amount is None
    assert short.item_id is None and short.goods_number is None and short.shop_price == 2.0
    assert short.goods_price is None
    orders = text.read_orders(spark, write(f"{folder}/orders", "0|7|2007-04-24\n1|8\n"))
    assert [r.order_date for r in orders.orderBy("order_id").collect()] == [datetime.date(2007, 4, 24), None]


def test_samples_are_repeatable(spark):
    df = spark.range(0, 20_000, numPartitions=4)
    first, second = (text.sample_rows(df, 0.3, 42).collect() for _ in range(2))
    assert first == second and 5_000 < len(first) < 7_000
    assert text.sample_rows(df, 1.0) is df


def test_points_and_edges(spark, folder):
    points = text.read_points(spark, write(f"{folder}/points", "0.5 1.5\n2.0 junk\n"))
    assert [r.point for r in points.collect()] == [[0.5, 1.5], [2.0, None]]
    edges = text.read_edges(spark, write(f"{folder}/edges", "a b\na\tb\nb  b extra\nc\n"))
    assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("b", "b")]


def test_stopwords(spark, folder):
    assert text.read_stopwords(spark, write(f"{folder}/stop", "a\ncan't able\n\na\n")) == ["a", "able", "can't"]


def test_lines_keep_their_order_over_splits(spark, folder):
    path = write(f"{folder}/log", "".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = text.read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        got = [r.value for r in lines.orderBy("log", "block", "line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(20_000)]


def test_a_missing_log_is_empty(spark, folder, caplog):
    with caplog.at_level(logging.WARNING):
        assert text.read_log(spark, f"{folder}/none").count() == 0
    assert "nothing found" in caplog.text


def test_capped_read_of_gzip_files(spark, folder):
    for part in range(2):
        with gzip.open(f"{folder}/{part}.csv.gz", "wt") as file:
            file.write("k,v\n" + "".join(f"{i},{i * 0.5}\n" for i in range(part, 100, 2)))
    capped = text.read_capped(spark, f"{folder}/*.csv.gz", 10, ["k"])
    assert [(r.k, r.v) for r in capped.collect()] == [(i, i * 0.5) for i in range(10)]


def test_cached_computes_once(spark, folder):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    path = f"{folder}/cache"
    assert text.cached(spark, path, compute).count() == text.cached(spark, path, compute).count() == 5
    assert len(calls) == 1


def test_run_table_is_not_overwritten(spark, folder):
    df = spark.createDataFrame([(2, [1, 2], None), (1, [], 0.5)], "stageId int, rddIds array<int>, tc double")
    path = sinks.write_run_table(df, folder, "local", "Analytics", "local-1", True, order=["stageId"])
    assert path.endswith("/output/local/Analytics/local-1_checkpoint.csv")
    sinks.write_run_table(df.limit(0), folder, "local", "Analytics", "local-1", True)
    back = text.read_run_table(spark, path).orderBy("id")
    assert back.columns == ["id", "stageId", "rddIds", "tc"]
    assert [tuple(r) for r in back.collect()] == [(0, 1, "[]", "0.5"), (1, 2, "[1, 2]", "nan")]


def test_scored_rows_are_replaced(spark, folder):
    path = f"{folder}/scored"
    for rows in (10, 6):
        sinks.write_scored(spark.range(rows), path, files=2)
    assert spark.read.option("header", True).csv(path).count() == 6
    assert spark.read.format("binaryFile").load(f"{path}/*.csv.gz").count() == 2


def test_lines_are_copied(spark, folder):
    source = write(f"{folder}/in", "- a\nb\n-c\n")
    kept = spark.read.text(sinks.copy_lines(spark, source, f"{folder}/kept", "-"))
    assert sorted(r.value for r in kept.collect()) == ["- a", "-c"]
    assert spark.read.text(sinks.copy_lines(spark, source, f"{folder}/all")).count() == 3


def test_ranks_are_saved(spark, folder):
    path = sinks.save_ranks(spark.createDataFrame([("a", 0.5)], "node string, rank double"), f"{folder}/ranks")
    assert spark.read.text(path).head().value == "a\t0.5"


def test_a_model_is_fitted_once(spark, folder):
    points = spark.createDataFrame([([float(i), 0.0],) for i in range(10)], "point array<double>")
    calls = []

    def fit():
        calls.append(1)
        return kmeans_fit(points, 2, 5)

    models = [sinks.load_or_fit(KMeansModel.load, fit, f"{folder}/model") for _ in range(2)]
    assert len(calls) == 1
    assert [list(c) for c in models[0].clusterCenters()] == [list(c) for c in models[1].clusterCenters()]


def test_run_table_schema_reads_back(spark, folder):
    names = [f.name for f in spark.createDataFrame([], schemas.RUN_TABLE).schema]
    path = write(f"{folder}/run.csv", ",".join(names) + "\n" + ",".join(["1", "COMPLETE"] + ["2"] * 7 + ["nan"] * 13) + "\n")
    row = text.read_run_table(spark, path, schemas.RUN_TABLE).select(F.col("tcMinTask").try_cast("float")).head()
    assert row[0] != row[0]


def test_shared_folder_is_taken_from_the_session(spark):
    from millrace.session import scratch_path, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("name", ["stagesTable", "x-y"])
def test_stored_frames_keep_schema(spark, name):
    from millrace.session import store

    df = spark.createDataFrame([], "a int, b array<struct<c:string>>")
    assert store(df, name).schema.simpleString() == df.schema.simpleString()


def test_sizes_follow_the_input():
    from millrace.session import sized_settings

    small, large = sized_settings(1 << 30), sized_settings(100 << 40)
    assert small == {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.shuffle.partitions": "200"}
    assert large == {"spark.sql.files.maxPartitionBytes": "512m", "spark.sql.shuffle.partitions": "200000"}
    assert sized_settings(100 << 40, max_partitions=9)["spark.sql.shuffle.partitions"] == "9"


def test_stored_tables_can_be_dropped(spark):
    from millrace.session import drop_stored, store

    table = store(spark.range(3), "short")
    assert table.count() == 3
    drop_stored(spark)
    with pytest.raises(Exception):
        store(spark.range(3), "short").unionAll(table).collect()
    assert store(spark.range(3), "short").count() == 3


def test_a_block_removes_what_it_stored(spark):
    from millrace.session import path_exists, scratch_path, store, stored_for

    with stored_for(spark):
        path = scratch_path(spark, "own")
        spark.range(3).write.parquet(path)
        assert store(spark.range(4)).count() == 4
    assert not path_exists(spark, path)


def test_a_folder_of_a_failed_writer_is_no_cache(spark, folder):
    spark.range(2).write.parquet(f"{folder}/kept")
    os.remove(f"{folder}/kept/_SUCCESS")
    assert text.cached(spark, f"{folder}/kept", lambda: spark.range(5)).count() == 5
    assert text.cached(spark, f"{folder}/kept", lambda: spark.range(7)).count() == 5
