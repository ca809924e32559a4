"""Projections and filters on plain columns. All of them are built-in expressions, none shuffles but `max_width`."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how the history server writes times.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSz"
_SECONDS = {"s": 1, "min": 60}


def max_width(df: DataFrame, column: str) -> int:
    """The longest array of the column, 0 if there are no rows."""
    return max_array_width(df, column).head()[0] or 0


def max_array_width(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(F.size(column)).alias("max_width"))


def widen(df: DataFrame, column: str, n: int, prefix: str = "feature") -> DataFrame:
    """One column per array position in place of the array; positions past the end are null."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *(F.get(column, F.lit(i)).alias(f"{prefix}{i}") for i in range(n)))


def cast_all(df: DataFrame, kind: str = "double") -> DataFrame:
    """Every column as `kind`; what cannot be cast becomes null."""
    return df.select(*(F.col(c).try_cast(kind).alias(c) for c in df.columns))


def cast_run_table(df: DataFrame) -> DataFrame:
    """Give the text columns of a run table their types; `nan` times and junk become null, `nan` numbers NaN.

    Takes tables with checkpoint times per stage and task (`tcMinStage`, `tcMinTask`) and those with times per
    RDD (`rddId`, `tcMs`). `rddIds` (`[3, 2]`) becomes an array. Executors may have names such as `driver`, which
    become null. A row number without a name (`_c0`) is called `id`.
    """
    kinds = dict(df.dtypes)

    def whole(c: str) -> Column:  # through double, because an integer column with gaps is written as `3.0`
        number = F.col(c).try_cast("double")
        return F.when(~F.isnan(number), number).try_cast("int")

    def instant(c: str) -> Column:
        return F.try_to_timestamp(c, F.lit(TIME_FORMAT)) if kinds[c] == "string" else F.col(c).try_cast("timestamp")

    def numbers(c: str) -> Column:
        found = F.regexp_extract_all(F.col(c).cast("string"), F.lit(r"(\d+)"), F.lit(1))
        return F.transform(found, lambda x: x.try_cast("int"))

    typed = {
        **dict.fromkeys(["taskIndex", "taskAttempt", "taskExecutorId", "rddId"], whole),
        **dict.fromkeys(["taskDuration", "tcMinStage", "tcMinTask", "tcMs"], lambda c: F.col(c).try_cast("float")),
        **dict.fromkeys(["submissionTime", "firstTaskLaunchedTime", "completionTime", "taskLaunchTime"], instant),
        "rddIds": numbers,
    }
    cast = df.withColumns({c: to(c) for c, to in typed.items() if c in kinds})
    return cast.drop("taskId").withColumnRenamed("_c0", "id")


def suffix_columns(df: DataFrame, suffix: str, keep: Collection[str] = ()) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{c}{suffix}") for c in df.columns))


def columns_of_type(df: DataFrame, types: Collection[str], exclude: Collection[str] = ()) -> list[str]:
    return [name for name, kind in df.dtypes if kind in types and name not in exclude]


def elapsed(start: str | Column, end: str | Column, unit: str = "min") -> Column:
    """Time between two instants, cut to whole seconds, in `s` or `min`."""
    micros = F.unix_micros(_instant(end)) - F.unix_micros(_instant(start))
    return F.floor(micros / 1_000_000) / _SECONDS[unit]


def elapsed_min(start: str | Column, end: str | Column) -> Column:
    return elapsed(start, end, "min")


def _instant(time: str | Column) -> Column:
    return (F.col(time) if isinstance(time, str) else time).cast("timestamp")


def last_match(array: str | Column, keep: Collection | Callable[[Column], Column]) -> Column:
    """The last array element that is in `keep` (values, or a predicate on an element); null if there is none."""
    inside = keep if callable(keep) else lambda x: x.isin(list(keep))
    return F.try_element_at(F.filter(array, inside), F.lit(-1))


def regex_all(column: str | Column, pattern: str, group: int = 1, as_int: bool = False) -> Column:
    """All matches of one group, in order; with `as_int` as numbers, null where a match is none."""
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(group))
    return F.transform(found, lambda x: x.try_cast("long")) if as_int else found


def key_share(key: Sequence[str | Column], salt: int | str = 0) -> Column:
    """A whole number in [0, 2**32) that depends on the key's values and the salt alone, and is spread evenly.

    The first 32 bits of the MD5 of salt and key as text, which SQL engines agree on. Null counts as empty.
    """
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key]
    digest = F.md5(F.concat_ws("|", F.lit(str(salt)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def polyvander(x: str | Column, n: int) -> Column:
    """The powers 1, x, …, x^(n-1) as an array."""
    base = F.col(x) if isinstance(x, str) else x
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda power: F.pow(base, power))


def linear_target(x: str | Column) -> Column:
    return 2 * (F.col(x) if isinstance(x, str) else x) + 10


def drop_nan(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with a NaN in one of the columns; rows with nulls stay."""
    for column in columns:
        df = df.filter(F.col(column).isNull() | ~F.isnan(column))
    return df


def is_checkpoint(name: str = "name") -> Column:
    """Whether a job or stage writes a checkpoint, by its name."""
    return F.col(name).contains("checkpoint")


def checkpoint_only(df: DataFrame, completed: bool = False) -> DataFrame:
    """Jobs or stages that write a checkpoint, by their name; with `completed` only those that finished."""
    kept = df.filter(is_checkpoint())
    return kept.filter(F.col("status") == "COMPLETE") if completed else kept


def first_attempt(df: DataFrame, keys: Sequence[str], attempt: str = "attemptId") -> DataFrame:
    """The row with the lowest attempt per key; equal attempts are ordered by the other columns.

    A minimum over rows, so every task sends one row per key. The minimum of a struct has no fixed width, so Spark
    aggregates it over sorted rows: each task sorts its own rows by key before it sends, and what it gets after.
    """
    rest = [c for c in df.columns if c not in keys and c != attempt]
    lowest = df.groupBy(*keys).agg(F.min(F.struct(attempt, *rest)).alias("__first"))
    return lowest.select(*(F.col(c) if c in keys else F.col(f"__first.{c}") for c in df.columns))


def flatten_tasks(stages: DataFrame, tasks: str = "tasks", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per task of stage rows whose `tasks` is a map of structs; stages without tasks keep one row."""
    # The fields of a task as the history server names them, and as run tables do.
    names = {"attempt": "taskAttempt", "duration": "taskDuration", "executorId": "taskExecutorId",
             "index": "taskIndex", "launchTime": "taskLaunchTime", "taskId": "taskId"}
    kept = list(keep) if keep is not None else [c for c in stages.columns if c != tasks]
    fields = stages.schema[tasks].dataType.valueType.fieldNames()
    rows = stages.select(*kept, F.explode_outer(F.map_values(tasks)).alias("__task"))
    return rows.select(*kept, *(F.col(f"__task.{f}").alias(names.get(f, f)) for f in fields))
