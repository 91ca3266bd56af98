"""State strictly before each row, without one task per key.

A plain running window puts a whole key in one task. Here each key is cut
along its own order into ``coarse`` parts (days), and a day of a key with more
than ``PART_ROWS`` rows into ranges of its rows, whose ends Spark samples, so
ids may be sparse or hashed. Rows are only windowed inside a range; what came
earlier is added from the totals of earlier ranges and days. A key holding a
third of the table is therefore spread over as many tasks as it has ranges, and
the only windows that see a whole key run over one row per day or range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fungo.session import dealt, parallel_parts, written

PART_ROWS = 1 << 18


@dataclass(frozen=True)
class Order:
    """A total order, and an SQL expression of whole numbers that never decreases along it."""

    by: Sequence[str]
    coarse: str = "0"


def day_order(date: str, ident: str, *ties: str) -> Order:
    """Order by day, then id; parts are days."""
    return Order((date, ident, *ties), f"datediff(`{date}`, DATE'1970-01-01')")


def id_order(ident: str, *ties: str) -> Order:
    """Order by an id alone."""
    return Order((ident, *ties))


def ranged(rows: DataFrame, group: Sequence[str], by: Sequence[str], part_rows: int, name: str) -> DataFrame:
    """``rows`` with the range that a row falls in: 0 for groups of up to ``part_rows`` rows.

    Large groups are sorted into sampled ranges and written once, so that every
    reader sees the same ranges. Ranges rise along the order and rows that tie
    in it stay together."""
    return _ranged(rows, group, by, part_rows, name)[0]


def _ranged(rows: DataFrame, group: Sequence[str], by: Sequence[str], part_rows: int, name: str) -> tuple[DataFrame, int, bool]:
    """The same, the number of rows, and whether any group was large."""
    seen = Observation()
    large = (rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
             .observe(seen, F.sum("_rows").alias("rows")).where(F.col("_rows") > part_rows))
    large = written(large)
    count = seen.get["rows"] or 0
    total = large.agg(F.sum("_rows")).first()[0]
    if not total:
        return rows.withColumn(name, F.lit(0)), count, False
    of = large.select(*group)
    parts = max(parallel_parts(rows.sparkSession), -(-total // part_rows))
    cut = written(rows.join(of, [*group], "left_semi").repartitionByRange(parts, *group, *by)
                  .withColumn(name, F.spark_partition_id()))
    return rows.join(of, [*group], "left_anti").withColumn(name, F.lit(0)).unionByName(cut), count, True


def running(df: DataFrame, keys: Sequence[str], order: Order,
            sums: Mapping[str, Column] | None = None,
            lasts: Mapping[str, Column] | None = None,
            trailing: Mapping[str, tuple[Column, int]] | None = None,
            part_rows: int = PART_ROWS) -> DataFrame:
    """Append state strictly before each row. Rows without key or order are
    left out; they have no state.

    ``sums``      running total of the non-null values before the row (0 if none)
    ``lasts``     most recent non-null value before the row (null if none)
    ``trailing``  total over earlier rows of the last n coarse parts, the row's
                  own part counted as the first
    """
    sums, lasts, trailing = dict(sums or {}), dict(lasts or {}), dict(trailing or {})
    keys = list(keys)
    order_at = F.struct(*[F.col(c) for c in order.by])

    rows = df.withColumn("_coarse", F.expr(order.coarse))
    for column in [*keys, *order.by[:2], "_coarse"]:
        rows = rows.where(F.col(column).isNotNull())
    rows, count, cut = _ranged(rows, [*keys, "_coarse"], order.by, part_rows, "_fine")
    # Where no day is cut the range is a constant, which no join is by.
    parts = [*keys, "_coarse", *(["_fine"] if cut else [])]
    totals = [*sums, *trailing]

    def valued(rows):
        return rows.withColumns({**{f"_v_{n}": c for n, c in sums.items()},
                                 **{f"_v_{n}": c for n, c in lasts.items()},
                                 **{f"_v_{n}": c for n, (c, _) in trailing.items()}})

    # One row per range. What came earlier in its day and in earlier days of its
    # key are windows over these rows, which one exchange by key serves.
    # The totals are summed before they are shuffled.
    fine = valued(rows).groupBy(*parts).agg(
        F.lit(1).alias("_one"),
        *[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in totals],
        *[F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), order_at))
          .alias(f"_p_{n}") for n in lasts])
    if not cut:
        fine = fine.withColumn("_fine", F.lit(0))
    if keys:
        fine = dealt(fine, count, *keys)
    inside = W.partitionBy(*keys, "_coarse").orderBy("_fine").rowsBetween(W.unboundedPreceding, -1)
    days = W.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_coarse")
    before = days.rangeBetween(W.unboundedPreceding, -1)

    def latest(name):
        held = F.col(f"_p_{name}").isNotNull()
        return F.max_by(F.col(f"_p_{name}"), F.when(held, F.struct("_coarse", "_fine")))

    offsets = fine.select(
        *parts,
        *[zero_over(f"_p_{n}", inside).alias(f"_f_{n}") for n in totals],
        *[F.last(f"_p_{n}", ignorenulls=True).over(inside).alias(f"_f_{n}") for n in lasts],
        *[zero_over(f"_p_{n}", before).alias(f"_c_{n}") for n in sums],
        *[latest(n).over(before).alias(f"_c_{n}") for n in lasts],
        *[zero_over(f"_p_{n}", days.rangeBetween(-(k - 1), -1)).alias(f"_c_{n}")
          for n, (_, k) in trailing.items()])

    # The rows are shuffled once, without what is computed from their columns: the
    # windows and the join are by the columns that they are dealt by.
    local = W.partitionBy(*parts).orderBy(*order.by).rowsBetween(W.unboundedPreceding, -1)
    rows = valued(dealt(rows, count, *parts)).select(
        *df.columns, *[p for p in parts if p not in df.columns],
        *[zero_over(f"_v_{n}", local).alias(f"_r_{n}") for n in totals],
        *[F.last(f"_v_{n}", ignorenulls=True).over(local).alias(f"_r_{n}") for n in lasts])
    return rows.join(offsets, parts).select(
        *df.columns,
        *[(F.col(f"_c_{n}") + F.col(f"_f_{n}") + F.col(f"_r_{n}")).alias(n) for n in totals],
        *[F.coalesce(f"_r_{n}", f"_f_{n}", f"_c_{n}").alias(n) for n in lasts])


def zero_over(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window), F.lit(0))


def position(df: DataFrame, keys: Sequence[str], order: Order, name: str = "pos", part_rows: int = PART_ROWS) -> DataFrame:
    """1-based position of each row inside its key."""
    return running(df, keys, order, sums={name: F.lit(1).cast("bigint")}, part_rows=part_rows).withColumn(
        name, F.col(name) + 1)


def last_n_before(df: DataFrame, keys: Sequence[str], count: str, n: int,
                  means: Mapping[str, Column], block: int = 4096) -> DataFrame:
    """Means of the last n non-null values strictly before each row.

    ``count`` holds how many values the key had before the row, so the values
    wanted are those of rows whose count lies in [count - n, count - 1]. Rows
    are grouped in blocks of counts, and the last n counts of a block are also
    sent to the next one: every frame is complete inside its block, and no task
    holds a whole key.
    """
    block = max(block, n)
    own = F.expr(f"`{count}` div {block}")
    spill = (F.col(count) % block >= block - n) & F.coalesce(
        *[F.when(v.isNotNull(), True) for v in means.values()], F.lit(False))
    copies = df.withColumns({"_own": own, **{f"_v_{k}": v for k, v in means.items()}}).withColumn(
        "_block", F.explode(F.when(spill, F.array(F.col("_own"), F.col("_own") + 1))
                            .otherwise(F.array(F.col("_own")))))
    frame = W.partitionBy(*keys, "_block").orderBy(count).rangeBetween(-n, -1)
    return copies.select(*df.columns, "_own", "_block", *[
        F.avg(f"_v_{k}").over(frame).alias(k) for k in means]).where(
        F.col("_block") == F.col("_own")).drop("_own", "_block")
