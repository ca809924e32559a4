"""Session settings and the shared folder for checkpoints and stored tables."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the sizing: it merges small shuffle partitions, splits hot ones in joins and
# turns a sort-merge join into a broadcast join once the real size of a side is known.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def sized_settings(
    input_bytes: int, shuffled_share: float = 0.25, max_split_mb: int = 512, max_partitions: int = 200_000
) -> dict[str, str]:
    """Split and shuffle sizes for an input of that many bytes, to pass to `build_session`.

    Splits of 128 MB, growing to `max_split_mb` where that keeps a scan near 200,000 tasks. Enough shuffle partitions for
    `shuffled_share` of the input in pieces of 128 MB, at most `max_partitions`; adaptive execution merges what is too small.
    """
    mb = 1 << 20
    split = min(max(128, math.ceil(input_bytes / 200_000 / mb)), max_split_mb)
    parts = min(max(200, math.ceil(input_bytes * shuffled_share / (128 * mb))), max_partitions)
    return {"spark.sql.files.maxPartitionBytes": f"{split}m", "spark.sql.shuffle.partitions": str(parts)}


def build_session(app_name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` adds to them or replaces them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and stored tables, and make `checkpoint()` use it.

    Taken from `spark.checkpoint.dir`; a `file:` folder given there must be one that all machines mount. Where it is
    unset a session in one process gets a new folder under the system's temporary folder; any other is refused, since
    its executors share no such folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses, below the folder of this application.

    It belongs to the innermost `stored_for` block, which removes it at its end, or else to the application.
    """
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def stored_for(spark: SparkSession) -> Iterator[None]:
    """Remove what is stored inside the block at its end. Use results before that, or write them elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_path(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-package-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._millrace_shipped = True


def store(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but stays columnar: a later reader fetches only the columns it
    needs. Every reader sees the same rows, also after executors are lost. Stored tables go at the end of the
    `stored_for` block they were made in, or else stay until `drop_stored`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables this application has stored; frames that still read one fail afterwards."""
    delete_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a file scan over at least as many partitions as there are cores.

    For work that is heavy per row, or goes over its input many times. Files that give fewer partitions are
    small, so moving them costs little; a large input has more partitions and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
