"""Event logs written by a small application of our own."""

from __future__ import annotations

import glob
import json
import logging
import os
import subprocess
import sys
import tempfile
import textwrap

import pytest
from pyspark.sql import functions as F

from millrace.operators import runs
from millrace.sources import eventlog

APPLICATION = textwrap.dedent("""
    import sys
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").appName("own")
        .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", sys.argv[1]).config("spark.eventLog.rolling.enabled", sys.argv[3])
        .config("spark.eventLog.compress", sys.argv[3]).config("spark.checkpoint.dir", sys.argv[2])
        .config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.enabled", "false").getOrCreate())
    df = spark.range(0, 1000, 1, 4).selectExpr("id % 10 as k", "id").checkpoint()
    df.groupBy("k").count().collect()
    spark.stop()
""")


@pytest.fixture(scope="module", params=["plain", "rolling and compressed"])
def events(spark, request):
    folder, checkpoints = (tempfile.mkdtemp(prefix="millrace-log-") for _ in range(2))
    packed = request.param != "plain"
    subprocess.run([sys.executable, "-c", APPLICATION, folder, checkpoints, str(packed).lower()], check=True,
                   timeout=180, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    assert len(glob.glob(f"{folder}/*")) == 1 and bool(glob.glob(f"{folder}/*/*.zstd")) == packed
    return eventlog.read_events(spark, folder).persist()


def test_application(events):
    app = eventlog.applications(events).head()
    assert app.app_id.startswith("local-") and app.start < app.end
    assert eventlog.app_duration(events, app.app_id).head().duration_ms == app.duration_ms > 0
    assert eventlog.app_duration(events, "unknown").head().duration_ms == 0


def test_jobs(events):
    jobs = eventlog.jobs(events).orderBy("jobId").collect()
    assert [j.jobId for j in jobs] == list(range(len(jobs)))
    assert "checkpoint at" in jobs[0].name and jobs[0].submissionTime <= jobs[0].completionTime
    assert [tuple(r) for r in eventlog.jobs(events, 0).collect()] == [tuple(jobs[0])]


def test_stages_and_tasks(events):
    stages = eventlog.stage_attempts(events).orderBy("stageId", "attemptId").collect()
    ran = [s for s in stages if s.status == "COMPLETE"]
    assert {s.status for s in stages} <= {"COMPLETE", "SKIPPED"} and len(ran) >= 3
    for stage in ran:
        assert stage.numTasks == stage.numCompleteTasks == eventlog.tasks(events, stage.stageId, 0).count()
        assert stage.submissionTime <= stage.firstTaskLaunchedTime <= stage.completionTime and stage.rddIds
    assert ran[0].numTasks == 4 and "checkpoint" in ran[0].name


def test_report(events):
    report = runs.run_report(events)
    assert report.filter("taskId is not null").count() == eventlog.tasks(events).count()
    with_tc = report.filter("tcMinStage is not null")
    assert with_tc.select("name").distinct().filter(~F.col("name").contains("checkpoint")).count() == 0
    assert with_tc.count() >= 4
    assert with_tc.filter(F.col("tcMinTask") != F.col("tcMinStage") / F.col("numTasks")).count() == 0
    assert runs.run_report(events, "unknown").count() == 0


def test_app_and_stage_checkpoint_times_agree(events):
    of_app = runs.tc_of_app(eventlog.jobs(events)).head().tc_min
    of_stages = runs.tc_per_stage(eventlog.stage_attempts(events)).agg(F.sum("tcMinStage")).head()[0]
    assert int(of_app) == int(of_stages)


def event(kind, **fields):
    return ("app", json.dumps({"Event": f"SparkListener{kind}", **{k.replace("_", " "): v for k, v in fields.items()}}))


@pytest.fixture(scope="module")
def troubled(spark):
    """Stage 0 fails and is tried again, stage 1 still runs, stage 2 never starts; one line is cut off."""
    def stage(attempt, reason=None):
        info = {"Stage ID": 0, "Stage Attempt ID": attempt, "Stage Name": "checkpoint at A", "Number of Tasks": 2,
                "RDD Info": [{"RDD ID": 5}], "Submission Time": 1000, "Completion Time": 200_000}
        return event("StageCompleted", Stage_Info={**info, **({"Failure Reason": reason} if reason else {})})

    def task(stage_id, attempt, number, failed=False, killed=False):
        return event("TaskEnd", Stage_ID=stage_id, Stage_Attempt_ID=attempt, Task_Info={
            "Task ID": number, "Index": 0, "Attempt": 0, "Launch Time": 20_000, "Finish Time": 21_000,
            "Executor ID": "1", "Failed": failed, "Killed": killed})

    planned = [{"Stage ID": i, "Stage Name": f"plan {i}", "Number of Tasks": 3} for i in range(3)]
    rows = [
        event("JobStart", Job_ID=0, Submission_Time=500, Stage_Infos=planned),
        stage(0, "lost"), stage(1), task(0, 0, 1, failed=True), task(0, 0, 2, killed=True), task(0, 1, 3),
        task(0, 1, 3), task(1, 0, 4), ("app", event("TaskEnd", Stage_ID=9)[1][:-5]), ("app", "no json"),
    ]
    return spark.createDataFrame(rows, eventlog.EVENTS)


def test_failed_running_and_skipped_stages(troubled):
    got = {(s.stageId, s.attemptId): s for s in eventlog.stage_attempts(troubled).collect()}
    assert {k: s.status for k, s in got.items()} == {
        (0, 0): "FAILED", (0, 1): "COMPLETE", (1, 0): "ACTIVE", (2, 0): "PENDING"}
    assert got[0, 1].numCompleteTasks == 1  # logged twice
    over = troubled.union(troubled.sparkSession.createDataFrame([event("ApplicationEnd", Timestamp=9)], eventlog.EVENTS))
    assert {s.stageId: s.status for s in eventlog.stage_attempts(over).collect()}[2] == "SKIPPED"
    assert (got[0, 0].numCompleteTasks, got[0, 0].numFailedTasks, got[0, 0].numKilledTasks) == (0, 1, 1)
    assert got[2, 0].numTasks == 3 and got[2, 0].name == "plan 2" and got[0, 1].rddIds == [5]
    assert eventlog.jobs(troubled).head().completionTime is None


def test_submitted_stages_and_running_tasks(spark):
    def start(number):
        return event("TaskStart", Stage_ID=4, Stage_Attempt_ID=0, Task_Info={"Task ID": number, "Index": number, "Attempt": 0, "Launch Time": 3000 + number})

    info = {"Stage ID": 4, "Stage Attempt ID": 0, "Stage Name": "count at B", "Number of Tasks": 5, "RDD Info": [{"RDD ID": 8}], "Submission Time": 2000}
    end = event("TaskEnd", Stage_ID=4, Stage_Attempt_ID=0, Task_Info={
        "Task ID": 1, "Index": 1, "Attempt": 0, "Launch Time": 3001, "Finish Time": 3500, "Executor ID": "1", "Failed": False, "Killed": False})
    rows = [event("StageSubmitted", Stage_Info=info), start(1), start(2), start(2), start(3), end]
    stage = eventlog.stage_attempts(spark.createDataFrame(rows, eventlog.EVENTS)).head()
    assert (stage.status, stage.numTasks, stage.numActiveTasks, stage.numCompleteTasks, stage.rddIds) == ("ACTIVE", 5, 2, 1, [8])
    assert stage.submissionTime.timestamp() == 2.0 and stage.firstTaskLaunchedTime.timestamp() == 3.001 and stage.completionTime is None


def test_report_of_trouble(troubled):
    rows = runs.run_report(troubled).collect()
    assert sorted((r.stageId, r.attemptId, r.taskId or 0) for r in rows) == [
        (0, 0, 1), (0, 0, 2), (0, 1, 3), (1, 0, 4), (2, 0, 0)]
    # The first attempt of the checkpoint stage failed, so the stage has no checkpoint time.
    assert all(r.tcMinStage is None for r in rows)


def test_no_log_no_rows(spark, folder, caplog):
    with caplog.at_level(logging.WARNING):
        events = eventlog.read_events(spark, os.path.join(folder, "none"))
    assert eventlog.jobs(events).count() == eventlog.stage_attempts(events).count() == 0
    assert "nothing found" in caplog.text


def test_a_cut_off_compressed_log(spark, folder):
    import zstandard

    lines = "".join(event("TaskEnd", Stage_ID=i, Stage_Attempt_ID=0)[1] + "\n" for i in range(30_000))
    packed = zstandard.ZstdCompressor().compress(lines.encode())
    for name, content in (("whole", packed), ("cut", packed[: len(packed) // 2])):
        with open(os.path.join(folder, f"events_1_{name}.zstd{'.inprogress' * (name == 'cut')}"), "wb") as file:
            file.write(content)
    counts = {r.app_id: r["count"] for r in eventlog.tasks(eventlog.read_events(spark, folder)).groupBy(
        "app_id").count().collect()}
    assert counts["whole"] == 30_000 and 0 < counts["cut"] < 30_000


@pytest.mark.parametrize(("name", "content"), [("cut", lambda x: x[: len(x) // 2]), ("torn", lambda x: x[:5000] + b"?" * 50 + x[5050:])])
def test_a_finished_log_that_is_not_whole_is_refused(spark, folder, name, content):
    import zstandard

    lines = "".join(event("TaskEnd", Stage_ID=i, Stage_Attempt_ID=0)[1] + "\n" for i in range(30_000))
    with open(os.path.join(folder, f"app-{name}.zstd"), "wb") as file:
        file.write(content(zstandard.ZstdCompressor().compress(lines.encode())))
    with pytest.raises(Exception, match=f"app-{name}.zstd is damaged or cut off"):
        eventlog.read_events(spark, folder).count()


def test_many_frames_and_unknown_codecs(spark, folder):
    import zstandard

    with open(os.path.join(folder, "app-1.zstd"), "wb") as file:
        for i in range(50):
            file.write(zstandard.ZstdCompressor().compress(f"line {i}\n".encode()))
    assert sorted(r.value for r in eventlog.read_events(spark, folder).collect()) == sorted(f"line {i}" for i in range(50))
    with open(os.path.join(folder, "app-2.lz4"), "wb") as file:
        file.write(b"anything")
    with pytest.raises(ValueError, match="app-2.lz4"):
        eventlog.read_events(spark, folder)


def test_names_of_rolling_logs(spark, folder):
    part = os.path.join(folder, "eventlog_v2_app-7")
    os.mkdir(part)
    with open(os.path.join(part, "events_1_app-7"), "w") as file:
        file.write(event("ApplicationStart", Timestamp=1)[1] + "\n")
    with open(os.path.join(folder, "local-3.inprogress"), "w") as file:
        file.write(event("ApplicationStart", Timestamp=1)[1] + "\n")
    names = {r.app_id for r in eventlog.read_events(spark, folder).collect()}
    assert names == {"app-7", "local-3"}
