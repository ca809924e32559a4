from __future__ import annotations

import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import runs


def test_checkpoint_time_of_an_app(spark):
    jobs = spark.createDataFrame(
        [("a", "checkpoint at X", "2021-09-29 10:00:00", "2021-09-29 10:19:17"),
         ("a", "count at Y", "2021-09-29 10:00:00", "2021-09-29 11:00:00"),
         ("a", "checkpoint at X", "2021-09-29 10:00:00", "2021-09-29 10:01:00")],
        "app_id string, name string, submissionTime string, completionTime string")
    assert runs.tc_of_app(jobs).head().tc_min == 17 / 60 + 19 + 1
    assert runs.checkpoint_jobs(jobs).count() == 2
    without = spark.createDataFrame([("b", "count at Y", "2021-09-29 10:00:00", None), ("c", "checkpoint at X", "2021-09-29 10:00:00", None)], jobs.schema)
    assert {r.app_id: r.tc_min for r in runs.tc_of_app(jobs.union(without)).collect()} == {"a": 17 / 60 + 20, "b": 0.0, "c": 0.0}


def test_shares_per_task(spark):
    tasks = spark.createDataFrame([(1, 4), (1, 4), (2, 2), (3, 0)], "stageId int, numTasks int")
    tc = spark.createDataFrame([(1, 2.0), (3, 5.0)], "stageId int, tcMinStage double")
    got = sorted(((r.stageId, r.tcMinTask) for r in runs.add_tc_per_task(tasks, tc).collect()), key=str)
    assert got == [(1, 0.5), (1, 0.5), (2, None), (3, None)]
    runs.assert_same_count(tasks, runs.add_tc_per_task(tasks, tc))
    with pytest.raises(AssertionError):
        runs.assert_same_count(tasks, tc)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_times_by_the_last_checkpointed_rdd(spark, kind):
    tasks = spark.createDataFrame(
        [(1, [3, 1, 2]), (2, [9]), (3, []), (4, None), (5, [2, 3, 2]), (6, [1, 9]), (7, [None, 1, None])], "taskId int, rddIds array<long>")
    tc = spark.createDataFrame([(1, 10), (2, 20), (None, 99)], "rddId long, tcMs long")
    tasks, tc = tasks.withColumn("rddIds", F.col("rddIds").cast(f"array<{kind}>")), tc.withColumn("rddId", F.col("rddId").cast(kind))
    want = {1: ("2", 20), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("2", 20), 6: ("1", 10), 7: ("1", 10)}
    got = runs.add_tc_by_rdd(tasks, tc)
    assert got.columns == ["taskId", "rddIds", "rddId", "tcMs"]
    assert {r.taskId: (r.rddId if r.rddId is None else str(r.rddId), r.tcMs) for r in got.collect()} == want


def test_distinct_times(spark):
    rows = [(1, 5.0), (1, 5.0), (2, 5.0), (3, float("nan")), (4, 7.0)]
    tasks = spark.createDataFrame(rows, "rddId int, tcMs double")
    assert runs.sum_distinct_tc(tasks).head()[0] == 0.012
    assert runs.sum_distinct_tc(tasks, by=["rddId"]).head()[0] == 0.017


def test_dedupe_keeps_the_smallest_rest(spark):
    df = spark.createDataFrame([(1, None, [2]), (1, None, [1]), (2, "x", [3])], "a int, b string, c array<int>")
    got = {tuple(map(str, r)) for r in runs.dedupe(df, ["a", "b"]).collect()}
    assert got == {("1", "None", "[1]"), ("2", "x", "[3]")}
    assert runs.dedupe(df.select("a"), ["a"]).count() == 2


def recovery_by_hand(rows):
    groups = defaultdict(list)
    for user, t, i, failed in rows:
        groups[user].append((t, i, failed))
    means = {}
    for user, events in groups.items():
        gaps, nxt = [], None
        for t, _, failed in sorted(events, reverse=True):
            if not failed:
                nxt = t
            elif nxt is not None:
                gaps.append(nxt - t)
        means[user] = sum(gaps) * 1000 / len(gaps) if gaps else None
    return means


@pytest.mark.parametrize("failing", [0.3, 0.999, 1.0])
def test_recovery_of_a_hot_group(spark, failing):
    """Groups over many partitions, with long runs of failures across their borders."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"u{rng.randrange(30)}", rng.randrange(100_000), i, rng.random() < failing)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "u string, s long, id long, failed boolean").select(
        "u", F.timestamp_seconds("s").alias("ts"), "id", "failed").repartition(5)
    got = {r.u: r.mttr_ms for r in runs.mttr(df, ["u"], "ts", F.col("failed"), ["id"]).collect()}
    want = recovery_by_hand(rows)
    assert got.keys() == want.keys()
    for user, value in want.items():
        assert got[user] == (None if value is None else pytest.approx(value, rel=1e-12))


def long_runs(spark):
    rows = [(1, "k1", 1.0), (2, "k1", 2.0), (3, "k1", 6.0), (1, "k2", 5.0), (2, "k2", None), (3, "k2", 1.0), (1, "k3", 1.0)]
    return spark.createDataFrame(rows, "run int, k string, v double")


def test_runs_align_on_common_keys(spark):
    aligned = runs.align_runs(long_runs(spark), [1, 2, 3], ["k"], ["v"])
    assert aligned.columns == ["k", "v", "v_2", "v_3"]
    assert {r.k: (r.v, r.v_2, r.v_3) for r in aligned.collect()} == {"k1": (1.0, 2.0, 6.0), "k2": (5.0, None, 1.0)}
    means = {r.k: r.meanV for r in runs.mean_across(aligned, ["v"], [1, 2, 3]).collect()}
    assert means == {"k1": 3.0, "k2": None}


def test_whole_rows_of_repeated_keys_meet(spark):
    rows = [(1, "k", 1, 5), (1, "k", 2, 1), (2, "k", 7, None), (2, "k", None, 8), (1, None, 3, 3), (2, None, 4, 4), (1, "l", 0, 0)]
    df = spark.createDataFrame(rows, "run int, k string, v int, w int")
    got = sorted(((r.k, r.v, r.w, r.v_2, r.w_2) for r in runs.align_runs(df, [1, 2], ["k"], ["v", "w"]).collect()), key=str)
    assert got == sorted([("k", a, b, c, d) for a, b in ((1, 5), (2, 1)) for c, d in ((7, None), (None, 8))], key=str)


def test_rows_of_hot_keys_meet_range_by_range(spark, monkeypatch):
    monkeypatch.setattr(runs, "ROWS_PER_KEY", 10)
    rows = [(1, "hot", i, i % 3) for i in range(95)] + [(2, "hot", i % 2, None) for i in range(23)] + [(3, "hot", 7, 7)]
    rows += [(1, "lone", i, 0) for i in range(50)] + [(r, f"k{i}", i, r) for i in range(20) for r in (1, 2, 3)] + [(1, None, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "run int, k string, v int, w int").repartition(4)
    aligned = runs.align_runs(df, [1, 2, 3], ["k"], ["v", "w"])
    of = {k: {r: [(v, w) for q, j, v, w in rows if (q, j) == (r, k)] for r in (1, 2, 3)} for k in {k for _, k, _, _ in rows if k}}
    want = [(k, *a, *b, *c) for k, r in of.items() for a in r[1] for b in r[2] for c in r[3]]
    assert len(want) == 95 * 23 + 20 and sorted(map(tuple, aligned.collect()), key=str) == sorted(want, key=str)


def test_separate_runs_are_stacked(spark):
    frames = {str(i): long_runs(spark).filter(F.col("run") == i).drop("run") for i in (1, 2)}
    aligned = runs.align_runs(runs.stack_runs(frames), ["1", "2"], ["k"], ["v"])
    assert {r.k for r in aligned.collect()} == {"k1", "k2"}


def test_medians_and_their_sum(spark):
    rows = [(s, float(v)) for s in (1, 2) for v in (5 * s, 1, 9 * s)] + [(1, float("nan"))]
    df = spark.createDataFrame(rows, "stageId int, tcMinStage double")
    for accuracy in (None, 1_000_000):
        medians = runs.median_by(df, ["stageId"], ["tcMinStage"], accuracy).collect()
        assert {r.stageId: r.medianTcMinStage for r in medians} == {1: 5.0, 2: 10.0}
    assert runs.sum_of_medians(df, ["stageId"], ["tcMinStage"]).head().sumMedianTcMinStage == 15.0


def test_matrix_of_checkpoint_times(spark):
    rows = [(r, s, float(10 * s + r)) for r in (1, 2) for s in (2, 1)] + [(1, 3, 1.0)]
    df = spark.createDataFrame(rows * 2, "run int, stageId int, tcMinStage double")
    got = [tuple(r) for r in runs.tc_matrix(df, [1, 2]).collect()]
    assert got == [(1, 11.0, 12.0, 11.5), (2, 21.0, 22.0, 21.5)]


def tasks(spark, rows):
    return spark.createDataFrame(rows, "run string, submissionTime string, completionTime string, numFailedTasks int")


def test_runtimes(spark):
    rows = [("a", "2021-01-01 10:00:00", "2021-01-01 10:01:00", 0), ("a", "2021-01-01 10:05:00", "2021-01-01 10:10:00", 2),
            ("b", "2021-01-01 10:00:00", "2021-01-01 10:20:00", 0)]
    df = tasks(spark, rows)
    times = runs.run_runtimes(df)
    assert {r.run: r.runtime_s for r in times.collect()} == {"a": 600, "b": 1200}
    assert runs.mean_runtime(times).head()[0] == 15.0
    assert runs.app_runtime(df).head().runtime_s == 1200
    tc = spark.createDataFrame([("b", 4.0)], "run string, tc_min double")
    assert {r.run: r.net_runtime_min for r in runs.net_runtime(times, tc).collect()} == {"a": 10.0, "b": 16.0}
    compared = runs.compare_runs(df.filter("run = 'a'").drop("run"), df.filter("run = 'b'").drop("run"), tc.drop("run"))
    got = {r.run: (r.tasks, r.failed_tasks, r.runtime_min, r.tc_min, r.net_runtime_min) for r in compared.collect()}
    assert got == {"normal": (2, 2, 10.0, 0.0, 10.0), "checkpoint": (1, 0, 20.0, 4.0, 16.0)}


def test_write_and_read_times(spark):
    tw, tr = [0.0, 19.93, 16.23, 16.57, 17.62, 17.62], [2.0, 4.0, 3.0, None, 1.0, 5.0]
    got = runs.tw_tr(spark.createDataFrame(list(zip(tw, tr)), "tw double, tr double")).head()
    assert got.tw_mean == pytest.approx(statistics.mean(tw)) and got.tw_median == pytest.approx(statistics.median(tw))
    assert got.tr_mean == got.tr_median == 3.0
    assert got.ratio == pytest.approx(statistics.median(tw) / 3.0)


def test_profile(spark):
    values = [float(v) for v in range(1, 101)]
    got = runs.profile(spark.createDataFrame([(v, None) for v in values], "v double, w int"), ["v", "w"]).collect()
    v, w = sorted(got, key=lambda r: r.column)
    assert v["count"] == 100 and w["count"] == 0
    assert (v["mean"], v["min"], v["p25"], v["p50"], v["p75"], v["max"]) == (50.5, 1, 25, 50, 75, 100)
    assert v["stddev"] == pytest.approx(statistics.stdev(values)) and w["mean"] is None


def test_over_time(spark):
    df = spark.createDataFrame([(2, 1, 0, 5.0), (1, 3, 1, None), (2, 1, 0, 5.0)],
                               "submissionTime int, numCompleteTasks int, numFailedTasks int, tcMs double")
    assert [tuple(r) for r in runs.stage_progress(df).collect()] == [(1, 3, 1), (2, 1, 0)]
    assert [tuple(r) for r in runs.tc_over_time(df).collect()] == [(1, None), (2, 5.0)]
    keyed = df.withColumn("stageId", F.monotonically_increasing_id())
    assert runs.tc_over_time(keyed, keys=["stageId"]).count() == runs.stage_progress(keyed, keys=["stageId"]).count() == 3
    assert [tuple(r) for r in runs.first_distinct(df, ["tcMs", "submissionTime"], ["submissionTime"], 1).collect()] == [
        (None, 1)]


def test_task_quantile(spark):
    rng = random.Random(5)
    rows = [(s, 0, rng.randrange(50)) for s in (0, 0, 0, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "stageId int, attemptId int, executorDeserializeTime int")
    got = {r.stageId: r.quantile for r in runs.task_quantile(df).collect()}
    for stage in (0, 1):
        values = sorted(v for s, _, v in rows if s == stage)
        assert got[stage] == values[math.floor(0.99 * len(values))]
