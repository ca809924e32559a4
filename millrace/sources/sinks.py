"""Writers for results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordering import number_rows
from millrace.session import path_exists

# Fixed value: times in run tables, as the history server writes them.
_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'"


# Fixed value: the layout of the folders of run tables.
def run_table_path(root: str, mode: str, workload: str, app_id: str, checkpoint: bool) -> str:
    return f"{root}/output/{mode}/{workload}/{app_id}_{'checkpoint' if checkpoint else 'normal'}.csv"


def write_run_table(
    df: DataFrame, root: str, mode: str, workload: str, app_id: str, checkpoint: bool,
    order: Sequence[str | Column] = (),
) -> str:
    """Write a run table as CSV with a leading row number and nulls as `nan`; an existing one is kept.

    `order` says what the row numbers follow; without it the table must bring its own `id` as first column.
    Arrays are written as text `[1, 2]`. Returns the path.
    """
    path = run_table_path(root, mode, workload, app_id, checkpoint)
    table = number_rows(df, order, name="id").select("id", *df.columns) if order else df
    arrays = {name for name, kind in table.dtypes if kind.startswith("array")}
    table = table.select(*(
        F.col(c).cast("string").alias(c) if c in arrays else F.col(c) for c in table.columns))
    table.write.mode("ignore").options(
        header=True, nullValue="nan", timestampFormat=_TIME_FORMAT, timeZone="GMT").csv(path)
    return path


def write_scored(df: DataFrame, path: str, files: int | None = None) -> str:
    """Write scored rows as gzip CSV with header, replacing what is there.

    `files` fixes the number of files, and with it the number of writing tasks; set it (to 2, say) for small
    results only.
    """
    rows = df.repartition(files) if files else df
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    return path


def load_or_fit(load: Callable[[str], MLWritable], fit: Callable[[], MLWritable], path: str) -> MLWritable:
    """The model saved at `path`; fitted and saved there first if there is no whole one."""
    if path_exists(SparkSession.getActiveSession(), f"{path}/metadata/_SUCCESS"):
        return load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


def copy_lines(spark: SparkSession, source: str, target: str, prefix: str | None = None) -> str:
    """Copy text lines, all of them or those that start with `prefix`."""
    lines = spark.read.text(source)
    if prefix is not None:
        lines = lines.filter(F.col("value").startswith(prefix))
    lines.write.text(target)
    return target


def save_ranks(ranks: DataFrame, path: str) -> str:
    """Write a rank table as `node<TAB>rank` lines, replacing what is there."""
    ranks.select(F.concat_ws("\t", *ranks.columns)).write.mode("overwrite").text(path)
    return path
