"""Measures of Spark runs: checkpoint time, runtimes, recovery, and runs side by side.

Frames are at the grain the name says: `jobs` one row per job, `stages` one per stage attempt, `tasks` one per
task, `runs` in long form (a `run` column) unless stated. `by` names the columns that tell applications or runs
apart; empty means the frame holds one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import checkpoint_only, elapsed_min, first_attempt, is_checkpoint
from millrace.operators.ordering import approx_quantiles, exact_quantile, exact_quantiles, number_rows, sketch_size
from millrace.session import store
from millrace.sources import eventlog


# --- checkpoint time ---------------------------------------------------------------------------------------

def checkpoint_jobs(jobs: DataFrame) -> DataFrame:
    """The checkpoint jobs with their duration in minutes."""
    return checkpoint_only(jobs).withColumn("duration_min", elapsed_min("submissionTime", "completionTime"))


def tc_of_app(jobs: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """tc_min per application: the minutes its checkpoint jobs took together, 0 if it has none.

    A checkpoint job without an end adds nothing.
    """
    minutes = F.when(is_checkpoint(), elapsed_min("submissionTime", "completionTime"))
    return jobs.groupBy(*by).agg(F.coalesce(F.sum(minutes), F.lit(0.0)).alias("tc_min"))


def tc_per_stage(stages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """stageId, tcMinStage of completed checkpoint stages, from first task launch to completion.

    Of a stage with several attempts the first one counts, if that completed.
    """
    keys = [*by, "stageId"]
    wanted = stages.select(*keys, "attemptId", "name", "status", "firstTaskLaunchedTime", "completionTime")
    first = checkpoint_only(first_attempt(checkpoint_only(wanted), keys), completed=True)
    return first.select(*keys, elapsed_min("firstTaskLaunchedTime", "completionTime").alias("tcMinStage"))


def add_tc_per_task(tasks: DataFrame, tc: DataFrame, keys: Sequence[str] = ("stageId",)) -> DataFrame:
    """Add tcMinStage, and its equal share per task tcMinTask; both null for stages without checkpoint.

    The tasks are the left side: a hot stage is split at run time, and `tc` is broadcast if it proves small.
    """
    return tasks.join(tc, [*keys], "left").withColumn("tcMinTask", F.try_divide("tcMinStage", "numTasks"))


def add_tc_by_rdd(tasks: DataFrame, rdd_tc: DataFrame) -> DataFrame:
    """Add `rddId`, the last of a task's `rddIds` that was checkpointed, and its `tcMs`; null if none was.

    `rdd_tc` holds rddId (once each) and tcMs. The distinct id lists, one for each stage or so, are opened and meet the
    times; what is found joins the tasks by list. Null ids and lists find nothing.
    """
    places = tasks.select("rddIds").distinct().select("rddIds", F.posexplode("rddIds").alias("pos", "rddId"))
    last = places.join(rdd_tc.select("rddId", "tcMs"), "rddId").groupBy("rddIds").agg(
        F.max_by(F.struct("rddId", "tcMs"), "pos").alias("__last"))
    return tasks.join(last, "rddIds", "left").select(
        *tasks.columns, F.col("__last.rddId").alias("rddId"), F.col("__last.tcMs").alias("tcMs"))


def sum_distinct_tc(tasks: DataFrame, by: Sequence[str] = (), tc: str = "tcMs") -> DataFrame:
    """tc_sum_seconds: the sum of the distinct checkpoint times (ms), NaN left out.

    Task rows repeat a checkpoint's time. Equal times of different RDDs collapse unless `by` (rddId) keeps
    them apart.
    """
    valid = tasks.select(*by, tc)
    if dict(valid.dtypes)[tc] in ("float", "double"):
        valid = valid.filter(~F.isnan(tc))
    return valid.distinct().agg((F.sum(tc).cast("double") / 1000).alias("tc_sum_seconds"))


def tc_over_time(
    tasks: DataFrame, tc: str = "tcMs", time: str = "submissionTime", keys: Sequence[str] = ()
) -> DataFrame:
    """Checkpoint time by submission time, oldest first; rows without a checkpoint time stay, with null.

    Equal pairs are one row unless `keys` (the application, the stage) tell them apart.
    """
    return tasks.select(*keys, time, tc).distinct().orderBy(time, tc, *keys)


# --- tasks and stages --------------------------------------------------------------------------------------

def dedupe(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """One row per distinct `subset`; of the other columns the smallest combination stays."""
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.distinct()
    kept = df.groupBy(*subset).agg(F.min(F.struct(*rest)).alias("__rest"))
    return kept.select(*(F.col(c) if c in subset else F.col(f"__rest.{c}") for c in df.columns))


def task_quantile(tasks: DataFrame, column: str = "executorDeserializeTime", q: float = 0.99,
                  by: Sequence[str] = ("stageId", "attemptId"), method: str = "index") -> DataFrame:
    """The exact quantile of a task measure per stage attempt, as the history server's task summary gives it."""
    return exact_quantile(tasks, column, q, by, method)


def stage_progress(stages: DataFrame, time: str = "submissionTime", keys: Sequence[str] = ()) -> DataFrame:
    """Completed and failed tasks by submission time; equal rows are one unless `keys` tell them apart."""
    return stages.select(*keys, time, "numCompleteTasks", "numFailedTasks").distinct().orderBy(
        time, "numCompleteTasks", "numFailedTasks", *keys)


def mttr(attempts: DataFrame, by: Sequence[str], time: str, failed: Column, order: Sequence[str]) -> DataFrame:
    """mttr_ms, recoveries per group: mean time from a failure to the next success, and how many failures had one.

    `time` + `order` must identify a row of a group. Rows are range-partitioned by group and time, newest
    first, so a hot group spreads over many partitions. Within a partition a failure finds the success before
    it (in that order); failures that find none there take the nearest one of an earlier partition, for which
    a row per group and partition suffices.
    """
    by = list(by)
    keys = [*by, "__t", *order]
    rows = attempts.select(
        *by, F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), *order, failed.alias("__failed"))
    newest_first = [F.col(c) for c in by] + [F.desc("__t")] + [F.desc(c) for c in order]
    placed = rows.repartitionByRange(*newest_first).withColumn("__part", F.spark_partition_id())
    group = Window.partitionBy("__part", *by).orderBy(*newest_first[len(by):])
    success = F.when(~F.col("__failed"), F.col("__t"))
    next_success = F.last(success, ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, -1))
    wide = "decimal(38,0)"
    gap, at = F.col("__next") - F.col("__t"), F.col("__t")
    parts = placed.select(*keys, "__failed", "__part", next_success.alias("__next")).groupBy("__part", *by).agg(
        F.sum(F.when(F.col("__failed"), gap.cast("decimal(20,0)"))).cast(wide).alias("closed"),
        F.count_if(F.col("__failed") & F.col("__next").isNotNull()).alias("n_closed"),
        F.sum(F.when(F.col("__failed") & F.col("__next").isNull(), at.cast("decimal(20,0)"))).cast(wide).alias("open"),
        F.count_if(F.col("__failed") & F.col("__next").isNull()).alias("n_open"),
        F.min(success).alias("__oldest_success"),
    )
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("__next", F.last("__oldest_success", ignorenulls=True).over(earlier))
    closes = F.col("__next").isNotNull() & (F.col("n_open") > 0)
    recovered = F.sum("n_closed") + F.sum(F.when(closes, F.col("n_open")).otherwise(0))
    late = F.col("n_open").cast("decimal(18,0)") * F.col("__next").cast("decimal(18,0)") - F.col("open")
    return carried.groupBy(*by).agg(
        F.try_divide(
            F.coalesce(F.sum("closed"), F.lit(0)).cast("double")
            + F.coalesce(F.sum(F.when(closes, late)), F.lit(0)).cast("double"),
            1000 * recovered,
        ).alias("mttr_ms"), recovered.alias("recoveries"))


def task_recovery(tasks: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """mttr_ms, recoveries of failed and killed tasks: from the end of one to the next success of the same task.

    `tasks` as `eventlog.tasks` gives them, a task being a stage's task index.
    """
    of_task = mttr(tasks, [*by, "stageId", "taskIndex"], "taskFinishTime", F.col("failed") | F.col("killed"),
                   ["attemptId", "taskAttempt", "taskId"])
    total = F.sum("recoveries")
    return of_task.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("mttr_ms") * F.col("recoveries")), total).alias("mttr_ms"), total.alias("recoveries"))


# --- runs side by side -------------------------------------------------------------------------------------

def stack_runs(runs: Mapping[str, DataFrame]) -> DataFrame:
    """The runs below each other, told apart by a `run` column."""
    labelled = [df.withColumn("run", F.lit(run)) for run, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


#: Rows of a key that one run may have in a task; keys with more are split.
ROWS_PER_KEY = 1000


def align_runs(runs: DataFrame, names: Sequence, key: Sequence[str], columns: Sequence[str],
               base_columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key that all runs have: the first run's columns plain, the others' as `<column>_<run>`.

    `runs` is in long form. What inner joins on the key give: a null key meets nothing, and a key that runs hold several
    times gives every combination of their rows. The runs meet in one aggregation, one shuffle for any number of runs,
    where joins would take one each. Of a key that all runs have and one holds more than ROWS_PER_KEY times, the rows of
    each run are numbered over partitions, and ranges of numbers meet each other: no task holds more than ROWS_PER_KEY of
    a run, and the work of a hot key is spread as its combinations are. `runs` is read several times.
    """
    key = list(key)
    base = [*(base_columns if base_columns is not None else columns)]
    wanted = [base if i == 0 else list(columns) for i in range(len(names))]
    if len(names) == 1:
        return runs.filter(F.col("run") == names[0]).dropna(subset=key).select(*key, *base)
    run = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("run")).cast("int") - 1
    kept = runs.filter(F.col("run").isin(list(names))).dropna(subset=key).withColumn("__run", run)

    def met(rows: DataFrame, by: list[str]) -> DataFrame:
        lists = [
            F.collect_list(F.when(F.col("__run") == i, F.struct(F.lit(1).alias("__one"), *wanted[i]))).alias(f"__run_{i}")
            for i in range(len(names))]
        grouped = rows.groupBy(*by).agg(*lists)
        for i in range(len(names)):  # An empty list opens to no row: the key is missing in that run.
            grouped = grouped.withColumn(f"__run_{i}", F.explode(f"__run_{i}"))
        return grouped.select(*key, *(
            F.col(f"__run_{i}.{c}").alias(c if i == 0 else f"{c}_{n}") for i, n in enumerate(names) for c in wanted[i]))

    counts = kept.groupBy(*key).agg(*(F.count_if(F.col("__run") == i).alias(f"__n{i}") for i in range(len(names))))
    sizes = [F.col(f"__n{i}") for i in range(len(names))]
    # Rows of a key that a run lacks meet nothing, however many they are; both kinds of keys are out of the main path.
    large = store(counts.filter(F.greatest(*sizes) > ROWS_PER_KEY), "large-keys")
    if large.isEmpty():
        return met(kept, key)
    split = large.filter(F.least(*sizes) > 0).select(*key, *(F.ceil(n / ROWS_PER_KEY).cast("int").alias(f"__parts{i}") for i, n in enumerate(sizes)))
    few = kept.join(large.select(*key), key, "left_anti")
    columns_used = list(dict.fromkeys([*base, *columns]))
    hot = number_rows(kept.select("__run", *key, *columns_used).join(split.select(*key), key, "left_semi"),
                      columns_used, by=["__run", *key], name="__number").join(split, key)
    ranges = [f"__range{i}" for i in range(len(names))]
    for i, name in enumerate(ranges):
        own = F.array((F.col("__number") / ROWS_PER_KEY).cast("int"))
        hot = hot.withColumn(name, F.explode(F.when(F.col("__run") == i, own).otherwise(F.sequence(F.lit(0), F.col(f"__parts{i}") - 1))))
    return met(few, key).unionByName(met(hot, [*key, *ranges]))


def mean_across(aligned: DataFrame, columns: Sequence[str], names: Sequence) -> DataFrame:
    """Add `mean<Column>` over the runs of an aligned frame; null if one run has none."""
    def mean(column: str) -> Column:
        parts = [F.col(column), *(F.col(f"{column}_{run}") for run in names[1:])]
        return reduce(lambda a, b: a + b, parts) / len(parts)

    return aligned.withColumns({f"mean{c[0].upper()}{c[1:]}": mean(c) for c in columns})


def median_by(df: DataFrame, key: Sequence[str], columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """`median<Column>` per key, a value of the data each; null and NaN do not count.

    Exact, by counting between values (`exact_quantiles`). With an `accuracy` from sketches instead, which are merged in a
    tree: one pass, doubles, and off by a share of about 1 / accuracy of a group's ranks, 1 / 11,000 at best; groups of fewer
    values than a sketch holds are exact.
    """
    find = exact_quantiles(df, columns, {"median": 0.5}, key) if accuracy is None else approx_quantiles(
        df, columns, {"median": 0.5}, key, sketch_size(accuracy))
    return find.select(*key, *(F.col(f"{c}.median").alias(f"median{c[0].upper()}{c[1:]}") for c in columns))


def sum_of_medians(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], accuracy: int | None = None
) -> DataFrame:
    """One row: per column the sum of its medians per key."""
    medians = median_by(df, key, columns, accuracy)
    return medians.agg(*(F.sum(c).alias(f"sum{c[0].upper()}{c[1:]}") for c in medians.columns if c not in key))


def tc_matrix(runs: DataFrame, names: Sequence, tc: str = "tcMinStage") -> DataFrame:
    """Per stage the checkpoint times of all runs side by side and their mean, by stage."""
    aligned = align_runs(runs.filter(~F.isnan(tc)).groupBy("run", "stageId").agg(F.max(tc).alias(tc)),
                         names, ["stageId"], [tc])
    return mean_across(aligned, [tc], names).orderBy("stageId")


# --- runtimes and summaries --------------------------------------------------------------------------------

def run_runtimes(tasks: DataFrame, by: Sequence[str] = ("run",), start: str = "submissionTime",
                 end: str = "completionTime") -> DataFrame:
    """runtime_s per run: last completion minus first submission, in whole seconds."""
    def seconds(c: str) -> Column:
        return F.unix_seconds(F.col(c).cast("timestamp"))

    span = (F.max(seconds(end)) - F.min(seconds(start))).alias("runtime_s")
    return tasks.groupBy(*by).agg(span) if by else tasks.agg(span)


def app_runtime(tasks: DataFrame, start: str = "submissionTime", end: str = "completionTime") -> DataFrame:
    """runtime_s of the one application in the frame."""
    return run_runtimes(tasks, (), start, end)


def mean_runtime(runtimes: DataFrame) -> DataFrame:
    """mean_runtime_min over the runs."""
    return runtimes.agg((F.avg("runtime_s") / 60).alias("mean_runtime_min"))


def net_runtime(runtimes: DataFrame, tc: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """runtime_min, tc_min and what is left without the checkpoints; a run without any has tc_min 0."""
    minutes = (F.col("runtime_s") / 60).alias("runtime_min")
    spent = F.coalesce("tc_min", F.lit(0.0))
    return runtimes.join(tc, [*by], "left").select(
        *by, minutes, spent.alias("tc_min"), (F.col("runtime_s") / 60 - spent).alias("net_runtime_min"))


def compare_runs(normal: DataFrame, checkpoint: DataFrame, tc: DataFrame) -> DataFrame:
    """Two labelled rows: tasks, failed tasks and runtime of both runs, and the checkpoint run's `tc_min`.

    `tc` is one row with tc_min.
    """
    both = stack_runs({"normal": normal, "checkpoint": checkpoint})
    counts = both.groupBy("run").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("numFailedTasks").alias("failed_tasks"),
        (F.max(F.unix_seconds(F.col("completionTime").cast("timestamp")))
         - F.min(F.unix_seconds(F.col("submissionTime").cast("timestamp")))).alias("runtime_s"),
    )
    # The time joins its run as one more row to sum up, which needs no join of two one-row frames.
    labelled = tc.select(F.lit("checkpoint").alias("run"), "tc_min")
    measures = ("tasks", "failed_tasks", "runtime_s", "tc_min")
    met = counts.unionByName(labelled, allowMissingColumns=True).groupBy("run").agg(
        *(F.max(m).alias(m) for m in measures))
    minutes, spent = F.col("runtime_s") / 60, F.coalesce("tc_min", F.lit(0.0))
    return met.select(
        "run", "tasks", "failed_tasks", minutes.alias("runtime_min"), spent.alias("tc_min"),
        (minutes - spent).alias("net_runtime_min"))


def tw_tr(runs: DataFrame, tw: str = "tw", tr: str = "tr") -> DataFrame:
    """One row: mean and median of both measures over the runs, and median(tw) / mean(tr)."""
    # Quantiles read their input several times.
    measures = store(runs.select(F.col(tw).cast("double").alias("tw"), F.col(tr).cast("double").alias("tr")), "measures")
    means = measures.agg(F.avg("tw").alias("tw_mean"), F.avg("tr").alias("tr_mean"))
    medians = exact_quantiles(measures, ["tw", "tr"], {"median": 0.5}, method="linear").select(
        F.col("tw.median").alias("tw_median"), F.col("tr.median").alias("tr_median"))
    both = means.unionByName(medians, allowMissingColumns=True)
    one = both.agg(*(F.max(c).alias(c) for c in ("tw_mean", "tr_mean", "tw_median", "tr_median")))
    return one.withColumn("ratio", F.try_divide("tw_median", "tr_mean"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, mean, stddev, min, p25, p50, p75, max: a numeric summary, quartiles being values of the data.

    One pass for the sums and one for the exact quartiles, whatever the number of columns.
    """
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    measures = {"mean": F.avg, "stddev": F.stddev, "min": F.min, "max": F.max}
    names = ["count", *measures, *quartiles]

    def by_column(wide: DataFrame) -> DataFrame:
        rows = wide.select(F.explode(F.array(*(
            F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns))).alias("r"))
        return rows.select("r.column", "r.s.*")

    sums = df.agg(*(
        F.struct(F.count(c).alias("count"), *(f(F.col(c)).cast("double").alias(name) for name, f in measures.items()))
        .alias(c) for c in columns))
    cuts = exact_quantiles(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), columns, quartiles)
    met = by_column(sums).unionByName(by_column(cuts), allowMissingColumns=True)
    return met.groupBy("column").agg(*(F.max(name).alias(name) for name in names))


def first_distinct(df: DataFrame, columns: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    """The first `n` distinct combinations by `order`."""
    return df.select(*columns).distinct().orderBy(*order).limit(n)


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after a step, and whether they agree."""
    one = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    sums = one.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"),
                   F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"))
    return sums.withColumn("same", F.col("rows_before") == F.col("rows_after"))


def assert_same_count(before: DataFrame, after: DataFrame) -> None:
    counts = row_counts(before, after).head()
    if not counts.same:
        raise AssertionError(f"{counts.rows_before} rows became {counts.rows_after}")


# --- the whole report --------------------------------------------------------------------------------------

def run_report(events: DataFrame, app_id: str | None = None) -> DataFrame:
    """Task rows of all applications (or one) with their stage attempt and checkpoint times.

    A task that is logged twice counts once. The log is read twice, for tasks and for stages. Tasks join their
    stage attempt, an inner join, so that a stage with most of the tasks can be split; attempts without tasks
    are added below.
    """
    if app_id is not None:
        events = events.filter(F.col("app_id") == app_id)
    key = ["app_id", "stageId", "attemptId"]
    details = ["taskAttempt", "taskDuration", "taskExecutorId", "taskIndex", "taskLaunchTime", "taskId"]
    # Both are read more than once; as stored tables the log is parsed only once for each.
    tasks = store(eventlog.tasks(events).select(*key, *details, "failed", "killed"), "tasks")
    stages = store(eventlog.stage_attempts(events, tasks), "stages")
    kept = [c for c in stages.columns if c != "numSeenTasks"]
    # Checkpoint times join the stages, which are few; the tasks then meet both in one join.
    timed = add_tc_per_task(stages, tc_per_stage(stages, by=["app_id"]), ["app_id", "stageId"])
    shares = ["tcMinStage", "tcMinTask"]
    with_tasks = tasks.join(timed, key).select(*kept, *details, *shares)
    without = timed.filter(F.col("numSeenTasks") == 0).select(*kept, *shares)
    return with_tasks.unionByName(without, allowMissingColumns=True).select(*kept, *details, *shares)
