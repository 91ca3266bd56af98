"""Typed table scans and sinks."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fungo.functions.scalars import id_key
from fungo.operators.dedup import keep_first, keyed_union
from fungo.schemas import DDL, LOG_KEYS
from fungo.session import cut_lineage


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the table's schema; absent columns become null, unreadable
    cells too. A whole number spelled "3313.0" is read as a whole number."""
    have = dict(df.dtypes)

    def cell(f):
        if f.name not in have:
            return F.lit(None).cast(f.dataType)
        whole = have[f.name] == "string" and f.dataType.simpleString() in ("int", "bigint")
        return (id_key(F.col(f.name)) if whole else F.col(f.name)).try_cast(f.dataType)

    return df.select(*[cell(f).alias(f.name) for f in StructType.fromDDL(DDL[table]).fields])


def read_or_empty(spark: SparkSession, table: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A table scan with its schema, or no rows when nothing is there yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], DDL[table])
    if fmt == "csv":
        text = spark.read.option("header", True).csv(path)
        return conform(text, table)
    reader = spark.read.schema(DDL[table])
    folders = [f"{path}/{DATA}/{f}" for f in current(spark, path)[1]] or [path]
    return reader.json(path) if fmt == "json" else reader.parquet(*folders)


COMMITS, DATA = "_commits", "_data"
#: Seconds after which a half-written commit counts as given up.
ABANDONED = 600


def commits(spark: SparkSession, path: str) -> list[tuple[int, list[str]]]:
    """The commits of a replaceable table, newest first: number and folders. A
    commit whose list is not written to its end is none yet."""
    fs, folder = _fs(spark, f"{path}/{COMMITS}")
    if not fs.exists(folder):
        return []
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    found = []
    for status in fs.listStatus(folder):
        at = status.getPath()
        if at.getName().isdigit():
            stream = fs.open(at)
            lines = read(stream, "UTF-8").split("\n")
            stream.close()
            if lines[-1] == "end":
                found.append((int(at.getName()), lines[:-1]))
    return sorted(found, reverse=True)


def current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number and folders of the newest commit; -1 and none if there is no table."""
    return next(iter(commits(spark, path)), (-1, []))


def commit(spark: SparkSession, path: str, base: int, folders: list[str], keep: int = 2) -> None:
    """Make ``folders`` the table, if ``base`` is still its newest commit: one
    file is created, which fails if another writer was first. Readers see the
    old list or the new one. Data that only older commits than the last
    ``keep`` list is deleted, so a job may read the table it replaces."""
    fs, at = _fs(spark, f"{path}/{COMMITS}/{base + 1:020d}")
    if fs.exists(at) and current(spark, path)[0] == base and (
            fs.getFileStatus(at).getModificationTime() < (time.time() - ABANDONED) * 1000):
        fs.delete(at, False)  # broke off while it was written, long ago
    out = fs.create(at, False)
    out.writeBytes("\n".join([*folders, "end"]))
    out.close()
    known = commits(spark, path)
    wanted = {f for _, listed in known[:keep] for f in listed}
    for number, listed in known[keep:]:
        for f in set(listed) - wanted:
            remove(spark, f"{path}/{DATA}/{f}")
        remove(spark, f"{path}/{COMMITS}/{number:020d}")


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside the old data, then point to the new. Read it with ``read_table``."""
    spark = df.sparkSession
    base, _ = current(spark, path)
    folder = uuid.uuid4().hex
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{DATA}/{folder}")
    commit(spark, path, base, [folder])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its newest commit."""
    _, folders = current(spark, path)
    if not folders:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(*[f"{path}/{DATA}/{f}" for f in folders])


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def append(df: DataFrame, table: str, path: str, partition_by: list[str] | None = None) -> None:
    writer = conform(df, table).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_quotes(batch: DataFrame, path: str) -> None:
    """Append unseen snapshot ids to the monthly log. Only the months present
    in the batch are read back."""
    spark = batch.sparkSession
    fresh = batch if "ordinal" in batch.columns else batch.withColumn("ordinal", F.lit(0))
    fresh = conform(keep_first(fresh, ["snapshot_id"], "ordinal"), "quotes").withColumn(
        "month", F.date_format("fetched_at", "yyyy-MM"))
    append_unseen(fresh, path, "snapshot_id")


def append_unseen(fresh: DataFrame, path: str, ident: str) -> None:
    """Append rows whose id the log does not hold in their month, however old
    they are. Ids are unique in ``fresh``; a batch appended twice adds nothing."""
    spark = fresh.sparkSession
    if exists(spark, path):
        fresh = cut_lineage(fresh)  # read for its months and again for its rows
        months = [r[0] for r in fresh.select("month").distinct().collect()]
        known = spark.read.schema(fresh.schema).parquet(path).where(
            F.array_contains(F.lit(months), F.col("month")) if months else F.lit(False)).select("month", ident)
        fresh = fresh.join(known, ["month", ident], "left_anti")
    fresh.write.mode("append").partitionBy("month").parquet(path)


def record_credits(spend: DataFrame, path: str, table: str = "credit_log") -> int | None:
    """Append the run's spend; return the lowest balance that can be read."""
    append(spend, table, path)
    return spend.agg(F.min(F.col("credits_remaining").try_cast("int"))).first()[0]


def merge_table(table: str, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Union for keyed logs, replacement for snapshots."""
    key = LOG_KEYS.get(table)
    return keyed_union(ours, theirs, key) if key else ours


def snapshot_calendar(spark: SparkSession, start: str, end: str, hour: int = 22, minute: int = 50,
                      manifest: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One UTC instant per day that is not in the manifest yet, oldest first."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("requested_date"))
    days = days.withColumn("moment", F.col("requested_date").cast("timestamp")
                           + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute)))
    if manifest is not None:
        days = days.join(manifest.select("requested_date"), "requested_date", "left_anti")
    return days.orderBy("requested_date").limit(limit) if limit is not None else days


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON rows, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).json(path)


def capture_counts(quotes: DataFrame, now: Column, spend: DataFrame) -> DataFrame:
    """Quotes priced, quotes refused because play had begun, credits spent."""
    started = F.coalesce(F.col("commence_time") <= now, F.lit(True))
    spent = spend.agg(F.sum(F.col("credits_used").try_cast("int")).alias("c")).scalar()
    return quotes.agg(F.count_if(F.col("priced") == 1).alias("priced_quotes"),
                      F.count_if(started).alias("in_play"),
                      F.countDistinct("event_id").alias("events")).withColumn("credits", spent)
