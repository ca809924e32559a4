"""Applications, jobs, stage attempts and tasks from Spark event logs.

An event log is JSON lines. Each function keeps the lines of the event kinds it needs by a plain text match,
parses only the fields it needs with a declared schema, and reads the log once. Lines that cannot be parsed
are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.text import or_empty

EVENTS = "app_id string, value string"

# Field names as Spark writes them.
_APPLICATION = "`Event` string, `App ID` string, `App Attempt ID` string, `Timestamp` long"
_JOB = (
    "`Event` string, `Job ID` long, `Submission Time` long, `Completion Time` long, "
    "`Stage Infos` array<struct<`Stage ID` long, `Stage Name` string, `Number of Tasks` int>>"
)
_STAGE_INFO = (
    "struct<`Stage ID` long, `Stage Attempt ID` int, `Stage Name` string, `Number of Tasks` int, "
    "`RDD Info` array<struct<`RDD ID` long>>, `Submission Time` long, `Completion Time` long, "
    "`Failure Reason` string>"
)
_TASK_INFO = (
    "struct<`Task ID` long, `Index` int, `Attempt` int, `Launch Time` long, `Finish Time` long, "
    "`Executor ID` string, `Failed` boolean, `Killed` boolean>"
)
_TASK = (
    f"`Event` string, `Stage ID` long, `Stage Attempt ID` int, `Task Info` {_TASK_INFO}, "
    "`Task Metrics` struct<`Executor Deserialize Time` long, `Executor Run Time` long>"
)
_STAGE = f"{_JOB}, `Stage Info` {_STAGE_INFO}"
_TASK_START = f"`Event` string, `Stage ID` long, `Stage Attempt ID` int, `Task Info` {_TASK_INFO}"


def _zstd_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """app_id, value: the lines of zstd files given as app_id, file, content, a bounded number at a time.

    The log of a running application may end within a block; its whole lines count. Any other file that ends early or is
    damaged is an error that names it.
    """
    for batch in batches:
        columns = (batch.column("app_id").to_pylist(), batch.column("file").to_pylist(), batch.column("content"))
        for app_id, file, content in zip(*columns):
            for chunk in _chunks_of_lines(pa.CompressedInputStream(pa.py_buffer(content.as_buffer()), "zstd"), file):
                yield pa.RecordBatch.from_pydict({
                    "app_id": pa.array([app_id] * len(chunk), pa.string()), "value": pa.array(chunk, pa.string())})


def _chunks_of_lines(stream: pa.NativeFile, file: str, limit: int = 2_000, size: int = 1 << 12) -> Iterator[list[str]]:
    """Lists of about `limit` lines. Reads are short, as one that meets the end of a file too early returns nothing."""
    lines: list[bytes] = []
    rest, whole = b"", True
    while whole:
        try:
            data = stream.read(size)
        except OSError as error:
            if ".inprogress" not in file:
                raise ValueError(f"{file} is damaged or cut off: {error}") from error
            data, rest = b"", b""
        *found, rest = (rest + data).split(b"\n")
        lines += found
        whole = bool(data)
        if not whole and rest:
            lines.append(rest)
        if len(lines) >= limit or not whole and lines:
            yield [line.decode("utf-8", "replace") for line in lines]
            lines = []


def read_events(spark: SparkSession, path: str, folder_key: str | None = None) -> DataFrame:
    """Event-log lines with their application: app_id, value. No lines and a warning if nothing is there.

    The application is taken from the file's name (`<app>[.inprogress]`), or for a rolling log from its
    `events_<n>_<app>` part; with a `folder_key`, for logs collected by Spark, from the folder `<key>=<app>`. Plain files are split and read by line. Files compressed as Spark does by default
    (`.zstd`, which its text reader does not know) are opened whole, one task per file; rolling keeps them small, and a
    file of 2 GB or more is refused. So are files of the codecs that can't be read here (lz4, lzf, snappy).
    """
    def app_id(name: Column) -> Column:
        if folder_key:
            return F.regexp_extract("_metadata.file_path", f"/{folder_key}=([^/]+)/", 1).alias("app_id")
        return F.regexp_extract(name, r"^(?:events_\d+_)?([^.]+)", 1).alias("app_id")

    def read() -> DataFrame:
        files = spark.read.option("recursiveFileLookup", True)
        name = F.col("_metadata.file_name")
        lines = files.text(path).filter(~name.contains(".zstd")).select(app_id(name), "value")
        unknown = files.option("pathGlobFilter", "*.{lz4,lzf,snappy}*").format("binaryFile").load(path).select("path").head()
        if unknown is not None:
            raise ValueError(f"{unknown.path}: event logs of this codec can't be read")
        packed = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.zstd*").format("binaryFile").load(path)
        return lines.unionAll(packed.select(app_id(name), name.alias("file"), "content").mapInArrow(_zstd_lines, EVENTS))

    return or_empty(spark, read, EVENTS, path)


def _parse(events: DataFrame, kinds: list[str], schema: str) -> DataFrame:
    """app_id and `e`, the parsed event, for the events of the given kinds.

    Opening a one-element array keeps the check of the parsed kind behind the parser; as a filter on a plain
    projection it would be pushed below and parse every line a second time.
    """
    mentioned = F.lit(False)
    for kind in kinds:
        mentioned = mentioned | F.col("value").contains(f'"{kind}"')
    parsed = events.filter(mentioned).select("app_id", F.explode(F.array(F.from_json("value", schema))).alias("e"))
    return parsed.filter(F.col("e.Event").isin(kinds))


def _time(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def applications(events: DataFrame) -> DataFrame:
    """One row per application log: app_id, attempt, start, end, duration_ms (null while running)."""
    e = F.col("e")
    parsed = _parse(events, ["SparkListenerApplicationStart", "SparkListenerApplicationEnd"], _APPLICATION)
    started = e["Event"] == "SparkListenerApplicationStart"
    first = F.min(F.when(started, F.struct(e["Timestamp"].alias("at"), e["App Attempt ID"].alias("attempt"))))
    rows = parsed.groupBy("app_id").agg(first.alias("s"), F.max(F.when(~started, e["Timestamp"])).alias("end"))
    return rows.select(
        "app_id", F.coalesce(F.col("s.attempt"), F.lit("1")).alias("attempt"),
        _time(F.col("s.at")).alias("start"), _time(F.col("end")).alias("end"),
        (F.col("end") - F.col("s.at")).alias("duration_ms"),
    )


def app_durations(events: DataFrame) -> DataFrame:
    """app_id, duration_ms of every application; 0 if the log does not tell."""
    return applications(events).select("app_id", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))


def app_duration(events: DataFrame, app_id: str) -> DataFrame:
    """One row with the duration of one application; 0 if it is unknown."""
    of_app = events.filter(F.col("app_id") == app_id)
    return app_durations(of_app).agg(
        F.lit(app_id).alias("app_id"), F.coalesce(F.max("duration_ms"), F.lit(0)).alias("duration_ms"))


def jobs(events: DataFrame, job_id: int | None = None) -> DataFrame:
    """One row per job: app_id, jobId, name, submissionTime, completionTime.

    A job is named after its last stage. Start and end meet in one aggregation, not in a join.
    """
    e = F.col("e")
    parsed = _parse(events, ["SparkListenerJobStart", "SparkListenerJobEnd"], _JOB)
    if job_id is not None:
        parsed = parsed.filter(e["Job ID"] == job_id)
    last_stage = F.array_max(F.transform(
        e["Stage Infos"], lambda s: F.struct(s["Stage ID"].alias("id"), s["Stage Name"].alias("name"))))
    return parsed.groupBy("app_id", e["Job ID"].alias("jobId")).agg(
        F.max(last_stage["name"]).alias("name"),
        _time(F.min(e["Submission Time"])).alias("submissionTime"),
        _time(F.max(e["Completion Time"])).alias("completionTime"),
    )


def tasks(events: DataFrame, stage_id: int | None = None, attempt: int | None = None) -> DataFrame:
    """One row per finished task attempt; a task that is logged twice counts once."""
    e = F.col("e")
    parsed = _parse(events, ["SparkListenerTaskEnd"], _TASK)
    if stage_id is not None:
        parsed = parsed.filter(e["Stage ID"] == stage_id)
    if attempt is not None:
        parsed = parsed.filter(e["Stage Attempt ID"] == attempt)
    info = e["Task Info"]
    return parsed.select(
        "app_id",
        e["Stage ID"].alias("stageId"),
        e["Stage Attempt ID"].alias("attemptId"),
        info["Attempt"].alias("taskAttempt"),
        (info["Finish Time"] - info["Launch Time"]).alias("taskDuration"),
        info["Executor ID"].alias("taskExecutorId"),
        info["Index"].alias("taskIndex"),
        _time(info["Launch Time"]).alias("taskLaunchTime"),
        info["Task ID"].alias("taskId"),
        e["Task Metrics"]["Executor Deserialize Time"].alias("executorDeserializeTime"),
        (info["Failed"] & ~info["Killed"]).alias("failed"),
        info["Killed"].alias("killed"),
        _time(info["Finish Time"]).alias("taskFinishTime"),
    ).distinct()


def started_tasks(events: DataFrame) -> DataFrame:
    """app_id, stageId, attemptId, taskId, taskLaunchTime of every task attempt that was launched, each once."""
    e = F.col("e")
    return _parse(events, ["SparkListenerTaskStart"], _TASK_START).select(
        "app_id", e["Stage ID"].alias("stageId"), e["Stage Attempt ID"].alias("attemptId"),
        e["Task Info"]["Task ID"].alias("taskId"), _time(e["Task Info"]["Launch Time"]).alias("taskLaunchTime")).distinct()


def stage_attempts(events: DataFrame, finished_tasks: DataFrame | None = None) -> DataFrame:
    """One row per stage attempt with its task counts; sort by stageId, attemptId for the order of time.

    Started and finished tasks are counted as plain sums; the counts then meet what the log says of the stages, when a
    job planned them, when they were submitted, when they completed, in one aggregation, so no join is needed.
    `finished_tasks`, the result of `tasks`, spares parsing them again.

    A stage is COMPLETE or FAILED once its completion is logged, and ACTIVE from its submission (or its first task) on.
    One that was only planned is PENDING while its application runs, that is without a logged end, and SKIPPED after it.
    Active tasks are those started and not finished, in stages that are active; logs without task starts have none.
    """
    key = ["app_id", "stageId", "attemptId"]
    finished = tasks(events) if finished_tasks is None else finished_tasks
    counted = finished.groupBy(*key).agg(
        F.count(F.lit(1)).cast("int").alias("numSeenTasks"),
        F.count_if("failed").cast("int").alias("numFailedTasks"),
        F.count_if("killed").cast("int").alias("numKilledTasks"),
        F.min("taskLaunchTime").alias("firstTaskLaunchedTime"),
    )
    started = started_tasks(events).groupBy(*key).agg(
        F.count(F.lit(1)).cast("int").alias("numStartedTasks"), F.min("taskLaunchTime").alias("firstTaskLaunchedTime"))
    e = F.col("e")
    info = e["Stage Info"]
    plan_type = "struct<name string, tasks int>"
    planned = F.transform(e["Stage Infos"], lambda s: F.struct(
        s["Stage ID"].alias("stageId"), F.lit(0).alias("attemptId"),
        F.struct(s["Stage Name"].alias("name"), s["Number of Tasks"].alias("tasks")).alias("plan")))
    told = F.array(F.struct(
        info["Stage ID"].alias("stageId"), info["Stage Attempt ID"].alias("attemptId"), F.lit(None).cast(plan_type).alias("plan")))
    # The end of an application belongs to all its stages; it is told apart by a stage that no stage has.
    ended = F.array(F.struct(F.lit(None).cast("long").alias("stageId"), F.lit(0).alias("attemptId"), F.lit(None).cast(plan_type).alias("plan")))
    kind = e["Event"]
    described = _parse(
        events, ["SparkListenerStageCompleted", "SparkListenerStageSubmitted", "SparkListenerJobStart", "SparkListenerApplicationEnd"], _STAGE
    ).select(
        "app_id", F.when(kind == "SparkListenerStageCompleted", info).alias("info"),
        F.when(kind == "SparkListenerStageSubmitted", info).alias("begun"),
        F.explode(F.when(kind == "SparkListenerJobStart", planned).when(kind == "SparkListenerApplicationEnd", ended).otherwise(told)).alias("stage"),
    ).select("app_id", "stage.*", "info", "begun")
    counts = ["numSeenTasks", "numFailedTasks", "numKilledTasks", "numStartedTasks"]
    met = described.unionByName(counted, allowMissingColumns=True).unionByName(started, allowMissingColumns=True).groupBy(*key).agg(
        F.max("info").alias("info"), F.max("begun").alias("begun"), F.max("plan").alias("plan"),
        *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts),
        F.min("firstTaskLaunchedTime").alias("firstTaskLaunchedTime"),
    )
    over = met.filter("stageId IS NULL").select("app_id", F.lit(True).alias("over"))
    met = met.filter("stageId IS NOT NULL").join(over, "app_id", "left")
    seen, info, begun = F.col("numSeenTasks"), F.col("info"), F.col("begun")
    status = (
        F.when(info["Failure Reason"].isNotNull(), "FAILED").when(info.isNotNull(), "COMPLETE")
        .when(begun.isNotNull() | (seen > 0) | (F.col("numStartedTasks") > 0), "ACTIVE")
        .when(F.col("over"), "SKIPPED").otherwise("PENDING"))
    active = F.when(status == "ACTIVE", F.greatest(F.col("numStartedTasks") - seen, F.lit(0))).otherwise(0)
    return met.select(
        "app_id", status.alias("status"), "stageId", "attemptId",
        F.coalesce(info["Number of Tasks"], begun["Number of Tasks"], F.col("plan.tasks"), seen).alias("numTasks"),
        active.alias("numActiveTasks"),
        (seen - F.col("numFailedTasks") - F.col("numKilledTasks")).alias("numCompleteTasks"),
        "numFailedTasks", "numKilledTasks",
        _time(F.coalesce(info["Submission Time"], begun["Submission Time"])).alias("submissionTime"),
        "firstTaskLaunchedTime",
        _time(info["Completion Time"]).alias("completionTime"),
        F.coalesce(info["Stage Name"], begun["Stage Name"], F.col("plan.name")).alias("name"),
        F.transform(F.coalesce(info["RDD Info"], begun["RDD Info"]), lambda r: r["RDD ID"]).alias("rddIds"),
        "numSeenTasks",
    )
