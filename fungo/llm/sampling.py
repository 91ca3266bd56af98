"""A bounded sample of labelled documents for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled(docs: DataFrame, label: str, each: int) -> DataFrame:
    """key and label of up to ``each`` documents of each label: in each of ``each`` hash buckets the one of least hash.

    The minima are partial aggregates, so a label that holds most rows is no hot group. Rows: labels times ``each``."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    return (docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(key.alias("key"), "doc_id", F.col(label).alias("label"))
            .groupBy("label", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(each)).alias("bucket"))
            .agg(F.min(F.struct("key", "doc_id")).alias("least"))
            .select("label", F.col("least.doc_id").alias("doc_id")))
