"""Embedding whitening: vectors on their principal directions, each with unit variance.

Method: rows, centred, are reduced block by block to triangular factors (QR);
the factors of tasks are merged in a tree until one is left. That one is of the
size of the covariance, whatever the number of rows: the driver makes it
bidiagonal by Householder reflections, finds its singular values by dqds and
their vectors by twisted factorisations (see ``bidiagonal``). The covariance is
never formed, so small variances keep their accuracy.

Entries become whole numbers first (``SCALE`` steps to one, shifted by
``SHIFT``), so means and deviations are exact. A vector that is null, or holds
null or non-finite entries, is dropped. So is one of another length than most
(of the longer, if two lengths are equally common): it lies in another space. An
entry beyond 2**45 counts as that. Equal rows and equal or null ids are rows of
their own. Along a direction without variance the whitened value is 0, and the
direction is left out of the identity error. A deviation too large for a long is
null. An empty table, or one without usable vectors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.llm.bidiagonal import EPS, right_vectors
from fungo.llm.common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = float(1 << 45)
#: Rows of a block of the factorisation, and factors merged at once.
ROWS, FAN = 4096, 32
SPLIT = 1 << 26
WIDE = 1 << 62


def usable(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows that can be used."""
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(values, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    whole = F.transform(values, lambda c: F.floor(F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE) + SHIFT)
    found = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)
    found = stored(found.select(F.col(id_).cast("long").alias("vec_id"), whole.alias("x")))
    # One row per length that occurs; the first is wanted.
    sizes = found.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return found.where(F.size("x") == (sizes["size"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                high, low = np.divmod(matrix(b.column("x")), SPLIT)
                yield pa.RecordBatch.from_pydict({"at": np.arange(high.shape[1]), "high": high.sum(0), "low": low.sum(0),
                                                  "n": np.full(high.shape[1], b.num_rows)})
    whole = "decimal(38,0)"
    rows = vectors.select("x").mapInArrow(part, "at long, high long, low long, n long").groupBy("at").agg(
        *(F.sum(F.col(c).cast(whole)).alias(c) for c in ("high", "low", "n"))).orderBy("at").collect()
    return (int(rows[0]["n"]) if rows else 0), [int(r["high"]) * SPLIT + int(r["low"]) for r in rows]


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: as 64-bit numbers where they fit, else as Python's."""
    if len(x) and n * int(np.abs(x).max()) < WIDE and max(map(abs, total)) < WIDE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None beyond a long."""
    if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] < WIDE:
        return (d * d).sum(1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in found]


FACTOR = "part long, factor binary"


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def factor(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The triangular factor of all centred vectors."""
    dims = len(total)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = np.zeros((0, dims)), 0
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            x = matrix(b.column("x"))
            for at in range(0, len(x), ROWS):
                held = triangle(np.concatenate([held, (deviations(x[at:at + ROWS], n, total) / n).astype(float)]))
        if len(held):
            yield pa.RecordBatch.from_pydict({"part": [part], "factor": [held.tobytes()]})

    def merged(table: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((0, dims))
        for raw in table["factor"]:
            held = triangle(np.concatenate([held, np.frombuffer(raw).reshape(-1, dims)]))
        return pd.DataFrame({"part": [table["part"].iloc[0] // FAN], "factor": [held.tobytes()]})

    parts = stored(vectors.select("x", F.spark_partition_id().cast("long").alias("part")).mapInArrow(blocks, FACTOR))
    while parts.count() > 1:
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merged, FACTOR))
    raw = np.frombuffer(parts.first()["factor"]).reshape(-1, dims)
    return np.concatenate([raw, np.zeros((dims - len(raw), dims))])


def fit(vectors: DataFrame, components: int) -> tuple[int, list[int], np.ndarray, list[float], float]:
    """Rows, sums, the whitening directions (columns), shares of variance, and the identity error."""
    n, total = sums(vectors)
    if not n:
        return 0, [], np.zeros((0, 0)), [], 0.0
    values, found = right_vectors(factor(vectors, n, total))
    count, all_ = min(components, len(total)), float(values.sum())
    values, found = values[:count], found[:, :count]
    spread = values > (len(total) * EPS) ** 2 * values[0]
    scaled = np.where(spread, found / np.sqrt(np.where(spread, values / n, 1.0)), 0.0)
    return n, total, scaled, (values / all_ if all_ else values).tolist(), identity_error(vectors, n, total, scaled[:, spread])


def identity_error(vectors: DataFrame, n: int, total: list[int], scaled: np.ndarray) -> float:
    """The largest difference between the covariance of the whitened vectors and the identity."""
    k = scaled.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w = (deviations(matrix(b.column("x")), n, total) / n).astype(float) @ scaled
                held[:k] += w.T @ w
                held[k] += w.sum(0)
        i, j = np.indices(held.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": held.ravel()})

    if not k:
        return 0.0
    held = np.zeros((k + 1, k))
    for r in vectors.select("x").mapInArrow(part, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        held[r["i"], r["j"]] = r["v"]
    mean = held[k] / n
    return float(np.abs(held[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                 ("explained", pa.float64()), ("identity_error", pa.float64())])


def whitened(rows: DataFrame, components: int = COMPONENTS, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row per usable row and component."""
    vectors = usable(rows, id_, vector)
    n, total, scaled, shares, error = fit(vectors, components)
    k = scaled.shape[1]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = deviations(matrix(b.column("x")), n, total)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(b.column("vec_id").to_numpy(zero_copy_only=False).repeat(k), pa.int64(), from_pandas=True)
                if not b.column("vec_id").null_count else pa.array([v for v in b.column("vec_id").to_pylist() for _ in range(k)], pa.int64()),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array([v for v in squares(d) for _ in range(k)], pa.int64()), pa.array(((d / n).astype(float) @ scaled).ravel()),
                pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))], schema=OUT)
    return vectors.mapInArrow(out, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                   "identity_error double")
