"""Registry of queries over the driver's tables, with the SQL they must equal."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fungo.session import checkpoint_ready, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)
        QUERIES[name] = shipped
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which every executor can read."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
