"""Quotes as a stream: idempotent log, board of the latest capture, screening."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators import ledger as L
from fungo.session import cut_lineage
from fungo.sources.tables import DATA, append_unseen, commit, conform, current, exists, read_table

c = F.col


def not_started(stream: DataFrame, commence: str, captured: str) -> DataFrame:
    return stream.where(S.is_future(c(commence), c(captured)))


def fresh(stream: DataFrame, captured: str, now: Column,
          minutes: int = C.MAX_QUOTE_AGE_MINUTES) -> DataFrame:
    return stream.where((F.unix_micros(now) - F.unix_micros(c(captured))) / 60e6 <= minutes)


def log_quotes(stream: DataFrame, path: str, checkpoint: str, ident: str = "snapshot_id",
               time: str = "fetched_at") -> StreamingQuery:
    """Append each unseen id to the log, partitioned by month. The log itself is
    the state, read only for the months of a batch: an id is new however late
    it comes, and a batch replayed after a failure adds nothing."""
    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([ident]).withColumn("month", S.month_of(c(time)))
        append_unseen(fresh, path, ident)
    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(rows: DataFrame, keys: list[str], time: str, ordinal: str) -> DataFrame:
    values = [k for k in rows.columns if k not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(time, ordinal)).alias("r")).select(
        *keys, "r.*")


def fold(batch: DataFrame, path: str, keys: list[str], time: str, ordinal: str, buckets: int = 64) -> None:
    """Fold rows into a board: the latest row per key, kept in ``buckets`` by
    hash of the key. Only buckets that the rows touch are read and written anew;
    all of them become current by one commit, so a reader sees the board before
    or after. Folding the same rows twice changes nothing."""
    spark = batch.sparkSession
    new = cut_lineage(latest(batch, keys, time, ordinal).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    touched = {f"bucket={r[0]}" for r in new.select("bucket").distinct().collect()}
    base, folders = current(spark, path)
    held = {f.rpartition("/")[2]: f for f in folders}
    mine = [f"{path}/{DATA}/{held[b]}" for b in sorted(touched & held.keys())]
    plain = new.drop("bucket")
    if mine:
        old = spark.read.schema(plain.schema).parquet(*mine)
        plain = latest(old.unionByName(plain), keys, time, ordinal)
    home = uuid.uuid4().hex
    (plain.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
     .write.partitionBy("bucket").parquet(f"{path}/{DATA}/{home}"))
    commit(spark, path, base, sorted(({**held, **{b: f"{home}/{b}" for b in touched}}).values()))


def keep_board(stream: DataFrame, path: str, checkpoint: str, keys: list[str], time: str,
               ordinal: str, buckets: int = 64) -> StreamingQuery:
    """Latest row per key of a stream; a batch replayed after a failure changes nothing. Read it with ``read_board``."""
    return (stream.writeStream.foreachBatch(lambda batch, _: fold(batch, path, keys, time, ordinal, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_board(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def screen_cards(stream: DataFrame, ledger_path: str, rejected_path: str, checkpoint: str,
                 now: Callable[[DataFrame], Column]) -> StreamingQuery:
    """Screen each arriving card against the stored ledger, so the day cap and
    the locked ids hold across runs; keep the wagers and the rejections.

    Both are kept by writer (the checkpoint) and batch, and the batch's own
    wagers are not part of the ledger it is screened against: a batch replayed
    after a failure anywhere decides the same and replaces its own rows."""
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at, part = now(batch), f"writer={writer}/batch={number}"
        held = None
        if exists(spark, ledger_path):
            held = spark.read.parquet(ledger_path).where((c("writer") != writer) | (c("batch") != number))
        seen = cut_lineage(L.screen(batch, at, held, L.staked_by_day(held) if held is not None else None))
        conform(L.wagers(seen, at), "ledger").write.mode("overwrite").parquet(f"{ledger_path}/{part}")
        L.rejections(seen, at).write.mode("overwrite").parquet(f"{rejected_path}/{part}")
    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def trailing_workload(stream: DataFrame, key: str, time: str, amount: Column,
                      days: int = C.WORKLOAD_DAYS, delay: str = "1 day") -> DataFrame:
    """Totals of sliding day-aligned windows per key."""
    return (stream.withWatermark(time, delay)
            .groupBy(key, F.window(time, f"{days} days", "1 day").alias("w"))
            .agg(F.sum(amount).alias("workload"), F.count(F.lit(1)).alias("n")))


def keep_workload(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, amount: Column,
                  days: int = C.WORKLOAD_DAYS, delay: str = "1 day") -> StreamingQuery:
    """The windows of ``trailing_workload`` as a board: each batch brings the new
    totals of the windows it changed, so open windows are there with what they
    hold so far, and a window stays as it was when the watermark closed it."""
    totals = trailing_workload(stream, key, time, amount, days, delay).select(
        key, c("w.start").alias("start"), c("w.end").alias("end"), "workload", "n")

    def add(batch: DataFrame, number: int) -> None:
        fold(batch.withColumn("batch", F.lit(number)), path, [key, "start"], "batch", "batch")
    return (totals.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
