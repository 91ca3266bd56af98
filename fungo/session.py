"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task of a join, a grouping or a window.
TASK_ROWS = 1 << 19

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(master: str | None = None, app: str = "fungo", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_fungo_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="fungo-"), "fungo.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._fungo_shipped = True


def is_local(master: str) -> bool:
    """One machine, one process; a local cluster has executors of its own."""
    return master == "local" or master.startswith("local[")


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure checkpoints go to a folder every executor can read.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif is_local(context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark deletes the shuffle files of a query that ends while this is set. Otherwise
#: they stay until the driver next collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables that go with the innermost ``passing`` block.
_passing: ContextVar[set[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that stay, and the
    shuffle files of the queries that write them once each is written."""
    folders: set[str] = set()
    token = _passing.set(folders)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)
        _passing.reset(token)
        for folder in folders:
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def erase(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    _delete(table.sparkSession, table._folder)


def _fresh(spark: SparkSession, stays: bool) -> str:
    """A folder of its own beside the checkpoints."""
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    if not stays and (folders := _passing.get()) is not None:
        folders.add(folder)
    return folder


def written(df: DataFrame, stays: bool = False) -> DataFrame:
    """A table written beside the checkpoints and read again. Its size is known
    to the planner, so it is broadcast only where it is small."""
    folder = _fresh(df.sparkSession, stays)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._folder = folder
    return table


def bucketed(df: DataFrame, parts: int, key: str, stays: bool = False) -> DataFrame:
    """The same in ``parts`` buckets by ``key``: tables of as many buckets are joined
    and grouped by it without a shuffle. ``df`` should come dealt to ``parts`` tasks by
    ``key``, so that a bucket is a file."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    folder = _fresh(spark, stays)
    (df.write.format("parquet").option("path", folder).option("compression", "zstd")
     .bucketBy(parts, key).sortBy(key).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files are not in the warehouse
    table._folder = folder
    return table


def parallel_parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df`` of about ``rows`` rows by the hash of ``columns``, in tasks of about
    ``TASK_ROWS`` rows. The number of shuffle partitions is fixed for a session,
    so a large table would otherwise have larger tasks instead of more."""
    tasks = -(-rows // TASK_ROWS)
    by = [F.col(k) for k in columns]
    return df.repartition(tasks, *by) if tasks > parallel_parts(df.sparkSession) else df.repartition(*by)


def joined_parts(spark: SparkSession, rows: int) -> int:
    """Tasks of a join of many tables of ``rows`` rows, which are all sorted in it at once."""
    return max(parallel_parts(spark), -(-rows // max(1, TASK_ROWS // 4)))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Even out rows that cost far more to compute on than to move.

    Hashing on columns keeps a recomputed task's rows the same; the extra hash
    keeps the split from being merged with an equal one made for a join, which
    would be sized by bytes."""
    return df.repartition(parallel_parts(df.sparkSession), F.xxhash64(*columns))
