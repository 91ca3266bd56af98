"""Packing documents into fixed-length sequences along a space-filling curve.

A document's token ids are hashed to a vector of signs, summed and averaged to
a point in a few dimensions; the place of that point on a Hilbert curve is the
document's key. Documents are range-sorted by key and laid end to end, so
neighbours in a sequence resemble each other. Each document's place is a
prefix sum in two levels (within a range, over the ranges), and the line is cut
every ``length`` tokens: no sequence but the last is short. That one is cut at
powers of two, so nothing is padded.

Only keys and token counts are sorted; token ids move once, to meet the place
of their document.

Null text is empty and still gives the end id. Rows with equal or null ids are
documents of their own. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fungo.llm.common import landed, numbered, small_batches, stored
from fungo.llm.tokens import vocabulary_path, word_tokens
from fungo.session import parallel_parts

DIMENSIONS, BITS, LANE = 4, 12, 16
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def signs(ids: np.ndarray) -> np.ndarray:
    """A hashed vector of signs for each id: four lanes of 16 bits, 1 for plus."""
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return sum(((h >> np.uint64(d)) & np.uint64(1)) << np.uint64(LANE * d) for d in range(DIMENSIONS))


def point(ids: np.ndarray, table: np.ndarray) -> list[int]:
    """The share of plus signs in each dimension, on the grid of the curve. Whole numbers throughout, for texts of any length."""
    plus = [0] * DIMENSIONS
    for at in range(0, len(ids), (1 << LANE) - 1):  # a lane cannot overflow
        lanes = int(table[ids[at:at + (1 << LANE) - 1]].sum())
        plus = [p + (lanes >> LANE * d & (1 << LANE) - 1) for d, p in enumerate(plus)]
    return [min((p << BITS) // len(ids), (1 << BITS) - 1) for p in plus]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), each coordinate under 2**bits."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, from the top
        low = q - 1
        for d in range(dims):
            set_ = (x[:, d] & q) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(set_, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap if d else 0
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in reversed(range(bits)):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def _tokens(path: str, end_id: int):
    @F.pandas_udf("ids binary, n long, curve long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = word_tokens(path)
        end, table = np.array([end_id], coder.kind).tobytes(), signs(np.arange(len(coder.last)))
        for texts in batches:
            ids = [x + end for x in coder.encode(texts.tolist())]
            n = np.array([len(x) // coder.kind.itemsize for x in ids], np.int64)
            points = np.array([point(np.frombuffer(x, coder.kind), table) for x in ids], np.int64).reshape(-1, DIMENSIONS)
            yield pd.DataFrame({"ids": ids, "n": n, "curve": hilbert(points)})
    return tokens


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before = 0
    for b in batches:
        ends = before + b["n"].cumsum()
        if len(b):
            yield pd.DataFrame({"row_id": b["row_id"], "part": b["part"], "n": b["n"], "before": ends - b["n"]})
            before = int(ends.iloc[-1])


def cuts(total: int, length: int) -> np.ndarray:
    """Starts of the sequences behind the last full one, and the end of the line."""
    at, out = total // length * length, []
    for p in reversed(range(length.bit_length())):
        if total - at >= 1 << p:
            out.append(at)
            at += 1 << p
    return np.array([*out, total], np.int64)


def _cutter(total: int, length: int):
    full, tail = total // length * length, cuts(total, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, raw, n, place in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n", "place"))):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}")
                at = place
                while at < place + n:
                    if at < full:
                        first = at // length * length
                        sequence, stop = at // length, first + length
                    else:
                        k = int(np.searchsorted(tail, at, "right")) - 1
                        first, sequence, stop = int(tail[k]), full // length + k, int(tail[k + 1])
                    stop = min(stop, place + n)
                    rows.append((doc, at - place, stop - at, ids[at - place:stop - place].astype("<u4").tobytes(), n,
                                 sequence, at - first))
                    at = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE.types)], schema=PIECE)
    return cut


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary_path(vocabulary)
    coded = stored(
        numbered(landed(docs).select(F.col("doc_id").cast("long"), "text"))
        .withColumn("t", _tokens(path, end_id)(F.coalesce("text", F.lit(""))))
        .select("row_id", "doc_id", "t.*"))
    line = stored(
        coded.select("row_id", "doc_id", "n", "curve")
        .repartitionByRange(parallel_parts(spark), "curve", "doc_id", "row_id")
        .sortWithinPartitions("curve", "doc_id", "row_id")
        .select("row_id", "n", F.spark_partition_id().alias("part"))
        .mapInPandas(_running, "row_id long, part int, n long, before long"))
    # One row per range: as many as shuffle partitions.
    parts = stored(line.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))
    total = parts.agg(F.sum("n")).first()[0] or 0
    placed = line.join(F.broadcast(parts.drop("n")), "part").select("row_id", (F.col("base") + F.col("before")).alias("place"))
    return (coded.select("row_id", "doc_id", "ids", "n").join(placed, "row_id")
            .select("doc_id", "ids", "n", "place")
            .mapInArrow(_cutter(total, length),
                         "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"))
