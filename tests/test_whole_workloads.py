"""The workloads from files to results."""

from __future__ import annotations

import gzip
import os
import random

import pytest

from millrace.functions.columns import cast_run_table
from millrace.operators import generators
from millrace.plans import workloads
from millrace.sources import text as readers
from tests.test_eventlog import event
from tests.test_sources import write


@pytest.mark.parametrize("checkpoint", [False, True])
def test_analytics(spark, folder, checkpoint):
    items = write(f"{folder}/items", "".join(f"{i % 9}|4210351682594|0|2|{i}.50|{2 * i}.25\n" for i in range(40)))
    listed = write(f"{folder}/orders", "".join(f"{i}|{i}|2007-04-{i + 1:02}\n" for i in range(9)))
    top = workloads.analytics(spark, items, listed, checkpoint=checkpoint).collect()
    totals = {o: sum(2 * i + 0.25 for i in range(40) if i % 9 == o) for o in range(9)}
    want = sorted(totals.items(), key=lambda t: -t[1])[:5]
    assert [(r.order_id, r.sum_goods_price) for r in top] == want
    assert workloads.analytics(spark, items, listed, fraction=0.4).count() <= 5


def test_pagerank(spark, folder):
    path = write(f"{folder}/edges", "a b\nb a\nb c\n")
    ranks = {r.node: r.rank for r in workloads.pagerank(spark, path, 1, save=f"{folder}/ranks").collect()}
    assert ranks == {"a": pytest.approx(0.575), "b": pytest.approx(1.0), "c": pytest.approx(0.575)}
    assert spark.read.text(f"{folder}/ranks").count() == 3


def test_kmeans(spark, folder):
    path = generators.write_points(generators.gen_clusters(spark, 200, 3), f"{folder}/points")
    found = workloads.kmeans(spark, path, 3, 10)
    assert found.centres.count() == 3 and 0 < found.cost < 200


def test_lda(spark, folder):
    lines = ["river bank water boat", "court judge law trial"] * 15
    found = workloads.lda(spark, write(f"{folder}/docs", "\n".join(lines)), write(f"{folder}/stop", "bank\nLaw\n"), 2, 5)
    assert tuple(found.counts.head()) == (30, 90, 90) and found.avg_loglik < 0
    assert {r.term for r in found.terms.collect()} == {"river", "water", "boat", "court", "judge", "trial"}


def test_gradient_boosted_trees(spark, folder):
    path = generators.write_labelled(generators.gen_polynomial(spark, 800, 3), f"{folder}/sgd")
    found = workloads.gradient_boosted_trees(spark, path, 4, checkpoint_interval=2)
    assert 3 < found.rmse.head().rmse < 6 and "Tree 3" in found.description
    assert found.predictions.columns == ["prediction", "label", "features"]


def test_failure_study(spark, folder):
    rng = random.Random(1)
    with gzip.open(f"{folder}/part-0.csv.gz", "wt") as file:
        file.write("task_name,map_reduce,plan_cpu,cpu_avg,cpu_max,labels\n")
        for i in range(300):
            cpu = rng.uniform(0, 100)
            file.write(f"t{i},{rng.choice('mr')},{cpu},{cpu if i % 7 else ''},{cpu + 1},{int(cpu > 60)}\n")
    arguments = (spark, f"{folder}/*.csv.gz", f"{folder}/models", f"{folder}/scored", ["task_name"])
    settings = dict(grid_depths=[2], grid_bins=[12], folds=2, iterations=2)
    model, metrics = workloads.failure_study(*arguments, **settings)
    again, _ = workloads.failure_study(*arguments, **settings)
    assert metrics.count() == 2 and again.avgMetrics == pytest.approx(model.avgMetrics)
    scored = spark.read.option("header", True).csv(f"{folder}/scored")
    assert scored.columns == ["task_name", "map_reduce", "plan_cpu", "cpu_avg", "cpu_max", "labels", "prediction"]


def test_run_table_of_an_application(spark, folder):
    name = "local-77"
    info = {"Stage ID": 0, "Stage Attempt ID": 0, "Stage Name": "checkpoint at A", "Number of Tasks": 2,
            "RDD Info": [{"RDD ID": 5}, {"RDD ID": 3}], "Submission Time": 1_632_900_000_000,
            "Completion Time": 1_632_900_090_000}
    lines = [event("StageCompleted", Stage_Info=info)] + [
        event("TaskEnd", Stage_ID=0, Stage_Attempt_ID=0, Task_Info={
            "Task ID": i, "Index": i, "Attempt": 0, "Launch Time": 1_632_900_000_000 + i, "Executor ID": "driver",
            "Finish Time": 1_632_900_050_000, "Failed": False, "Killed": False}) for i in range(2)]
    folder_events = f"{folder}/events"
    os.mkdir(folder_events)
    write(f"{folder_events}/{name}", "\n".join(line for _, line in lines) + "\n")
    log = write(f"{folder}/app.log", f"INFO logging to /x/{name}.inprogress\n")
    path = workloads.report_run(spark, log, folder_events, folder, "Analytics", True)
    assert path.endswith(f"output/local/Analytics/{name}_checkpoint.csv")
    assert spark.read.option("header", True).csv(path).head().submissionTime == "2021-09-29T07:20:00.000GMT"
    typed = cast_run_table(readers.read_run_table(spark, path)).orderBy("id").collect()
    assert [(r.id, r.taskIndex, r.rddIds, r.tcMinStage, r.tcMinTask) for r in typed] == [
        (0, 0, [5, 3], 1.5, 0.75), (1, 1, [5, 3], 1.5, 0.75)]
    assert typed[0].submissionTime is not None and typed[0].taskDuration == 50_000
    with pytest.raises(ValueError):
        workloads.report_run(spark, f"{folder}/none.log", folder_events, folder, "Analytics", True)


def test_run_table_by_rdd_and_from_the_cache(spark, folder):
    name = "local-78"
    info = {"Stage ID": 0, "Stage Attempt ID": 0, "Stage Name": "checkpoint at A", "Number of Tasks": 1,
            "RDD Info": [{"RDD ID": 5}, {"RDD ID": 3}], "Submission Time": 1_632_900_000_000, "Completion Time": 1_632_900_090_000}
    task = {"Task ID": 1, "Index": 0, "Attempt": 0, "Launch Time": 1_632_900_000_000, "Executor ID": "driver",
            "Finish Time": 1_632_900_050_000, "Failed": False, "Killed": False}
    os.mkdir(f"{folder}/events")
    write(f"{folder}/events/{name}", "\n".join(line for _, line in (
        event("StageCompleted", Stage_Info=info), event("TaskEnd", Stage_ID=0, Stage_Attempt_ID=0, Task_Info=task))) + "\n")
    log = write(f"{folder}/app.log", f"INFO logging to /x/{name}.inprogress\nINFO Checkpointing took 120 ms.\n"
                "INFO Done checkpointing RDD 5 to /c/a, new parent\nINFO Checkpointing took 45 ms.\nINFO Done checkpointing RDD 9 to /c/b\n")
    arguments = dict(by_rdd=True, cache=f"{folder}/cache")
    path = workloads.report_run(spark, log, f"{folder}/events", f"{folder}/first", "Analytics", True, **arguments)
    row = cast_run_table(readers.read_run_table(spark, path)).head()
    assert (row.rddId, row.tcMs, row.rddIds) == (5, 120.0, [5, 3])
    os.remove(f"{folder}/events/{name}")
    again = workloads.report_run(spark, log, f"{folder}/events", f"{folder}/second", "Analytics", True, **arguments)
    assert cast_run_table(readers.read_run_table(spark, again)).head() == row
