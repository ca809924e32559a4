from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import logs
from millrace.sources import text as readers


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_ragged_rows_are_widened_and_cast(spark):
    df = spark.createDataFrame([("1.5", ["2", "x", "3"]), ("junk", ["4"]), ("0", [])], "label string, f array<string>")
    width = C.max_width(df, "f")
    got = [tuple(r) for r in C.cast_all(C.widen(df, "f", width)).collect()]
    assert width == 3
    assert got == [(1.5, 2.0, None, 3.0), (None, 4.0, None, None), (0.0, None, None, None)]
    assert C.max_width(df.limit(0), "f") == 0


def test_run_table_types(spark):
    df = spark.createDataFrame(
        [("3.0", "[4, 5]", "1", "12.5", "driver", "nan", "2021-09-29T10:11:12.345GMT", "nan", "9"),
         ("nan", "[]", "x", "nan", "7", "0.5", "junk", "2021-09-29T10:11:12.000GMT", "9")],
        "taskIndex string, rddIds string, taskAttempt string, taskDuration string, taskExecutorId string, "
        "tcMinStage string, submissionTime string, completionTime string, taskId string")
    a, b = C.cast_run_table(df).collect()
    assert (a.taskIndex, a.rddIds, a.taskAttempt, a.taskDuration, a.taskExecutorId) == (3, [4, 5], 1, 12.5, None)
    assert math.isnan(a.tcMinStage) and b.tcMinStage == 0.5 and math.isnan(b.taskDuration)
    assert a.submissionTime == datetime.datetime(2021, 9, 29, 10, 11, 12, 345000)
    assert (a.completionTime, b.submissionTime, b.taskIndex, b.taskAttempt, b.rddIds) == (None, None, None, None, [])
    assert b.completionTime == datetime.datetime(2021, 9, 29, 10, 11, 12)
    assert "taskId" not in a.asDict()


def test_older_run_table(spark, folder):
    with open(f"{folder}/run.csv", "w") as file:
        file.write(",stageId,rddId,tcMs,submissionTime,taskLaunchTime\n"
                   "0,4,7.0,952938.0,2021-09-29T10:11:12.345GMT,2021-09-29 10:11:12\n1,4,nan,nan,nan,2021-09-29 10:11:13\n")
    table = C.cast_run_table(readers.read_run_table(spark, f"{folder}/run.csv")).orderBy("id")
    assert dict(table.dtypes)["taskLaunchTime"] == dict(table.dtypes)["submissionTime"] == "timestamp"
    first, second = table.collect()
    assert (first.id, first.rddId, first.tcMs) == (0, 7, 952938.0) and second.rddId is None
    assert math.isnan(second.tcMs) and first.submissionTime.microsecond == 345000 and second.taskLaunchTime.second == 13


def test_names_and_types(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id int, v double, s string")
    assert C.suffix_columns(df, "_2", keep=["id"]).columns == ["id", "v_2", "s_2"]
    assert C.columns_of_type(df, ("int", "double"), exclude=("id",)) == ["v"]


@pytest.mark.parametrize("end, minutes", [
    ("2021-01-01 00:01:30.999", 1.5), ("2021-01-03 00:00:00", 2880.0), ("2021-01-01 00:00:00.5", 0.0), (None, None)])
def test_elapsed(spark, end, minutes):
    assert one(spark, C.elapsed_min(F.lit("2021-01-01 00:00:00"), F.lit(end)))[0] == minutes


def test_elapsed_in_seconds(spark):
    assert one(spark, C.elapsed(F.lit("2021-01-01 00:00:00"), F.lit("2021-01-01 00:02:03"), "s"))[0] == 123


def test_last_match(spark):
    array = F.array(*map(F.lit, [3, 1, 2, 9]))
    assert one(spark, C.last_match(array, [1, 2, 5]), C.last_match(array, [8]), C.last_match(array, lambda x: x > 2),
               C.last_match(array, range(1, 50))) == (2, None, 9, 9)


def test_regex_all(spark):
    text = F.lit("a12 b7 cx")
    got = one(spark, C.regex_all(text, r"([a-z])(\w+)", 2), C.regex_all(text, r"([a-z])(\w+)", 2, as_int=True))
    assert tuple(got) == (["12", "7", "x"], [12, 7, None])


def test_powers_and_target(spark):
    assert one(spark, C.polyvander(F.lit(2.0), 4), C.linear_target(F.lit(3.0))) == ([1.0, 2.0, 4.0, 8.0], 16.0)


def test_nan_rows_go_and_null_rows_stay(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (None, 2.0), (3.0, float("nan"))], "a double, b double")
    assert sorted(r.b for r in C.drop_nan(df, "a", "b").collect()) == [1.0, 2.0]


def test_first_attempt_and_checkpoint_stages(spark):
    df = spark.createDataFrame(
        [(1, 1, "checkpoint at A", "COMPLETE"), (1, 0, "checkpoint at A", "FAILED"), (2, 0, "count at B", "COMPLETE")],
        "stageId int, attemptId int, name string, status string")
    first = C.first_attempt(df, ["stageId"])
    assert {(r.stageId, r.attemptId, r.status) for r in first.collect()} == {(1, 0, "FAILED"), (2, 0, "COMPLETE")}
    assert first.columns == df.columns
    assert C.checkpoint_only(df).count() == 2 and C.checkpoint_only(df, completed=True).count() == 1


def test_tasks_are_flattened(spark):
    df = spark.createDataFrame(
        [(1, {"5": (0, 70), "6": (1, 80)}), (2, {}), (3, None)],
        "stageId int, tasks map<string, struct<attempt: int, duration: long>>")
    got = {tuple(r) for r in C.flatten_tasks(df).collect()}
    assert got == {(1, 0, 70), (1, 1, 80), (2, None, None), (3, None, None)}


LOG = [
    "local-1632000000000.inprogress and local-99.inprogress",
    "Checkpointing took 952938 ms",
    "Done checkpointing RDD 7 to file:/a, Done checkpointing RDD 8 to file:/b",
    "Checkpointing took 700", "Checkpointing took about 800 ms", "Checkpointing took some ms", "Checkpointing took 5 ms",
    "Checkpointing took 20 ms", "Checkpointing took 30 ms", "Done checkpointing RDD 7 to x",
    "Checkpointing took 40 ms", "/job-event-log/spark-4f31ab.inprogress",
]


@pytest.fixture(scope="module")
def log(spark):
    rows = [("a", i, line) for i, line in enumerate(LOG)] + [("b", 0, "nothing here")]
    return spark.createDataFrame(rows, "log string, line int, value string").repartition(5)


def test_log_matches(log):
    times = logs.log_checkpoint_times(log, ["line"]).orderBy("line").collect()
    assert [r.tcMs for r in times] == [952938, 20, 30, 40]
    assert logs.log_checkpoint_times(log, ["line"], min_digits=1).count() == 5
    rdds = logs.log_checkpoint_rdds(log, ["line"]).orderBy("line", "pos").collect()
    assert [r.rddId for r in rdds] == [7, 8, 7]


def test_app_id_of_a_log(log):
    assert [tuple(r) for r in logs.log_app_id(log, True, ["line"]).collect()] == [("a", "local-1632000000000")]
    assert [tuple(r) for r in logs.log_app_id(log, False, ["line"]).collect()] == [("a", "spark-4f31ab")]


def test_times_and_rdds_are_zipped(log):
    got = {(r.log, r.rddId, r.tcMs) for r in logs.zip_matches(log, ["line"]).collect()}
    assert got == {("a", 7, 30), ("a", 8, 20)}  # the fourth time has no RDD; RDD 7 keeps its later time


def test_zip_of_a_hot_log(spark):
    rows = []
    for i in range(2000):
        log = "hot" if i % 3 == 0 else f"log{i % 7}"
        rows += [(log, 2 * i, f"Checkpointing took {1000 + i} ms"), (log, 2 * i + 1, f"Done checkpointing RDD {i} to x")]
    df = spark.createDataFrame(rows, "log string, line int, value string").repartition(6)
    got = {r.rddId: r.tcMs for r in logs.zip_matches(df, ["line"]).collect()}
    assert got == {i: 1000 + i for i in range(2000)}
