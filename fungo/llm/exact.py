"""Exact deduplication by composable polynomial fingerprints.

A text, white space made single, is cut into pieces; each piece of bytes is
hashed as a polynomial modulo a prime at four bases, chunk by chunk. Two hashes
combine by shifting the first by the length of the second, so the pieces of a
huge document are hashed by different tasks and joined by arithmetic. Texts of
equal fingerprint and length are then compared with the text that would stay,
chunk against chunk; a text that differs forms its own group.

Null counts as an empty text. Of equal texts the smallest id stays (null ids
last, then the first row). An empty table gives an empty result. Other columns
pass through ``drop_copies`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.llm.common import free_name, landed, numbered, small_batches, stored
from fungo.session import parallel_parts

PRIME = (1 << 31) - 1
BASES = (1000003, 1299709931, 715827883, 1610612741)
CHUNK = 4096
PIECE = 1 << 20
COMPARED = 1 << 16
HASHES = [f"h{i}" for i in range(len(BASES))]
SHIFTS = [f"q{i}" for i in range(len(BASES))]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * base % PRIME
    return out


POWERS = np.stack([_powers(b, CHUNK)[::-1] for b in BASES], 1).astype(np.float64)
STEP = [pow(b, CHUNK, PRIME) for b in BASES]


def polynomial(data: bytes) -> list[int]:
    """The hash of some bytes at each base. Sums of a chunk stay under 2**53, so floats are exact."""
    n = len(data)
    if not n:
        return [0] * len(BASES)
    values = np.frombuffer(data, np.uint8).astype(np.float64) + 1
    if n <= CHUNK:
        return [int(v) % PRIME for v in values @ POWERS[CHUNK - n:]]
    padded = np.zeros(-(-n // CHUNK) * CHUNK)
    padded[-n:] = values  # leading zeros leave the polynomial as it is
    chunks = (padded.reshape(-1, CHUNK) @ POWERS).astype(np.int64) % PRIME
    total = [0] * len(BASES)
    for row in chunks.tolist():
        total = [(t * s + h) % PRIME for t, s, h in zip(total, STEP, row)]
    return total


def _piece_hash():
    @F.pandas_udf(", ".join(f"{c} long" for c in ["size", *HASHES, *SHIFTS]))
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            rows.append((len(data), *polynomial(data), *(pow(b, len(data), PRIME) for b in BASES)))
        return pd.DataFrame(rows, columns=["size", *HASHES, *SHIFTS], dtype="int64")
    return of


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def combined(parts: Column, hash_: str, shift: str) -> Column:
    """Hashes of pieces in order, each shifted by the length of what follows."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: (total * p[shift] + p[hash_]) % PRIME)


def fingerprints(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """row_id, doc_id, sha (of the normalised text), size and the hashes, one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    piece_hash = _piece_hash()
    base = (numbered(docs.select("doc_id", "text")).withColumn("text", normalised(F.col("text")))
            .withColumn("sha", F.sha2("text", 256)))
    whole = base.where(F.length("text") <= piece).withColumn("h", piece_hash(F.col("text")))
    whole = whole.select("row_id", "doc_id", "sha", "h.size", *(f"h.{c}" for c in HASHES))
    pieces = (
        base.where(F.length("text") > piece)
        .select("row_id", "doc_id", "sha", F.posexplode(cut(F.col("text"), piece)).alias("no", "text"))
        .repartition(parallel_parts(spark), "row_id", "no")
        .withColumn("h", piece_hash(F.col("text")))
        .groupBy("row_id", "doc_id", "sha")
        .agg(F.sum("h.size").alias("size"),
             F.array_sort(F.collect_list(F.struct("no", *(f"h.{c}" for c in HASHES + SHIFTS)))).alias("parts")))
    joined = pieces.select("row_id", "doc_id", "sha", "size",
                           *(combined(F.col("parts"), h, q).alias(h) for h, q in zip(HASHES, SHIFTS)))
    return stored(whole.unionByName(joined))


def cut(text: Column, size: int) -> Column:
    """A text in pieces of ``size`` characters, in one pass over it; an empty text is one piece."""
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _keeper() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_id")).alias("keeper")


def _chunks(texts: DataFrame) -> DataFrame:
    return texts.select("row_id", "group_id", F.posexplode(cut(F.col("text"), COMPARED)).alias("no", "chunk"))


def groups(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """row_id, doc_id, keep_id, group_size, kept, sha: one row per row of docs."""
    docs = landed(docs)
    found = fingerprints(docs, piece)
    alike = stored(found.groupBy("size", *HASHES).agg(_keeper(), F.count("*").alias("n")))
    member = stored(found.join(alike.withColumnRenamed("keeper", "k"), ["size", *HASHES])
                    .select("row_id", "doc_id", "sha", "n", F.col("k.row_id").alias("group_id")))
    several = member.where("n > 1").select("row_id", "group_id")
    texts = (numbered(docs.select("text")).select("row_id", normalised(F.col("text")).alias("text"))
             # The list of copies grows with the corpus, so it is merged at every size.
             .join(several.hint("merge"), "row_id"))
    chunks = stored(_chunks(texts))
    stays = chunks.where("row_id = group_id").select("group_id", "no", F.col("chunk").alias("kept_chunk"))
    other = chunks.where("row_id <> group_id")
    differs = stored(other.join(stays, ["group_id", "no"], "left")
                     .where("kept_chunk is null or chunk <> kept_chunk").select("row_id").distinct())
    classed = member.join(differs.withColumn("differs", F.lit(True)), "row_id", "left").withColumn(
        "class", F.when(F.col("differs"), F.col("sha")).otherwise(""))
    keepers = stored(classed.groupBy("group_id", "class").agg(_keeper(), F.count("*").alias("group_size")))
    return classed.join(keepers, ["group_id", "class"]).select(
        "row_id", "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keeper.row_id")).alias("kept"), "sha")


def drop_copies(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The rows of docs that stay, with all columns."""
    docs = landed(docs)
    gone = stored(groups(docs, piece).where("not kept").select("row_id"))
    name = free_name(docs, "row_id")
    return (numbered(docs, name).join(gone.withColumnRenamed("row_id", name), name, "left_anti")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
