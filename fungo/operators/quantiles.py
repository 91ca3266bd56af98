"""Exact medians and order statistics per group, whatever the size of a group.

The built-in ``percentile`` keeps every distinct value of a group in one
buffer, which is right for groups of up to ``LARGE`` rows. In a larger group
equal values are counted first (with map-side combining), and a histogram of
counts is refined level by level: the value axis is cut into slices, the slice
that holds a wanted rank is cut again, until it holds few distinct values. No
task sees more than the slices of a level or ``FEW`` distinct values, however
narrow the range of the values is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fungo.session import written

LARGE, FEW = 200_000, 20_000
SLICES_PER_DOUBLING, BINS = 512, 4096


def slice_of(v: Column) -> Column:
    """A number that never decreases along the values; NaN is the largest value."""
    step = F.floor(F.greatest(F.least(F.log2(F.abs(v)), F.lit(1100.0)), F.lit(-1100.0)) * SLICES_PER_DOUBLING)
    far = F.lit(1101 * SLICES_PER_DOUBLING)
    return (F.when(F.isnan(v), 3 * far).when(v == 0, F.lit(0)).otherwise(F.signum(v) * (step + far))).cast("bigint")


def bin_of(v: Column) -> Column:
    """The bin of a value between ``lo`` and ``hi``: each step is monotone in floating point, so bins keep the order."""
    return F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("bigint")


def quantiles(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[Column, str]],
              extras: Mapping[str, Column] | None = None, large: int = LARGE, few: int = FEW) -> DataFrame:
    """``specs`` maps an output name to (value, "median" or "upper").

    "upper" is the larger of the two middle values. ``extras`` are ordinary
    aggregates computed beside them. Null values are ignored; a group of nulls
    only has a null. Without keys there is one row, even of empty input.
    """
    keys, extras = list(keys), dict(extras or {})
    order = W.orderBy(*keys) if keys else W.orderBy(F.lit(0))
    # As many rows as groups that are large: rows / ``large`` at most.
    big = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large)
                  .withColumn("_g", F.row_number().over(order)).select(
                      *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_g"))
    if big.isEmpty():
        return small_groups(df, keys, specs, extras)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or F.lit(True)
    rest = df.join(big, same, "left_anti") if keys else None
    mine = df.join(big, same)
    values = {n: (v.cast("double"), kind) for n, (v, kind) in specs.items()}
    long = (mine.select("_g", F.explode(F.array(*[
        F.struct(F.lit(n).alias("_spec"), v.alias("_v")) for n, (v, _) in values.items()])).alias("_s"))
        .select("_g", "_s.*").where(F.col("_v").isNotNull()))
    counted = written(long.withColumn("_v", F.col("_v") + F.lit(0.0)).groupBy("_g", "_spec", "_v").agg(F.count(F.lit(1)).alias("_c")))
    upper = [n for n, (_, kind) in specs.items() if kind == "upper"]
    picked = wanted_values(counted, upper, few)
    wide = picked.groupBy("_g").agg(*[F.avg(F.when(F.col("_spec") == n, F.col("_v"))).alias(n) for n in specs])
    aside = mine.groupBy("_g").agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in extras.items()])
    out = big.join(aside, "_g").join(wide, "_g", "left").select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *specs, *extras)
    return small_groups(rest, keys, specs, extras).unionByName(out) if keys else out


def small_groups(df: DataFrame, keys: list[str], specs: Mapping[str, tuple[Column, str]], extras: Mapping[str, Column]) -> DataFrame:
    """One aggregate. The upper middle value is the least value with a share above one half at or below it."""
    def of(value: Column, kind: str) -> Column:
        v = value.cast("double") + F.lit(0.0)
        if kind == "median":
            return F.percentile(v, 0.5)
        return F.element_at(F.array_sort(F.collect_list(v)), (F.floor(F.count(v) / 2) + 1).cast("int"))
    out = df.groupBy(*keys).agg(*[
        F.when(F.count(v) > 0, of(v, kind)).alias(n) for n, (v, kind) in specs.items()], *[c.alias(n) for n, c in extras.items()])
    return out.select(*keys, *specs, *extras)


def wanted_values(counted: DataFrame, upper: Sequence[str], few: int) -> DataFrame:
    """(_g, _spec, _v): the middle values of each group and spec of counted values (_g, _spec, _v, _c)."""
    group = ["_g", "_spec"]
    slices = counted.groupBy(*group, slice_of(F.col("_v")).alias("_slice")).agg(
        F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_kinds"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    total = slices.groupBy(*group).agg(F.sum("_c").alias("_n"))
    low = F.when(F.col("_spec").isin(list(upper)), F.floor(F.col("_n") / 2)).otherwise(F.floor((F.col("_n") - 1) / 2))
    ranks = total.select(*group, F.explode(F.array_distinct(F.array(low, F.floor(F.col("_n") / 2)))).alias("_rank"))
    # A wanted rank: its slice, and its rank inside it.
    targets = written(inside(slices.join(ranks.withColumn("_want", F.col("_rank")), group), "_slice"))
    while True:
        most = targets.where("lo < hi").agg(F.max("_kinds")).first()[0]
        if most is None or most <= few:
            break
        wide = targets.where((F.col("_kinds") > few) & (F.col("lo") < F.col("hi")))
        bins = (counted.join(wide.drop("_c", "_kinds"), group).where(F.col("_v").between(F.col("lo"), F.col("hi")))
                .groupBy(*group, "_rank", "_want", bin_of(F.col("_v")).alias("_slice"))
                .agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_kinds"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
        targets = written(inside(bins, "_slice").unionByName(targets.where((F.col("_kinds") <= few) | ~(F.col("lo") < F.col("hi")))))
    last = counted.join(targets.drop("_c", "_kinds"), group).where(
        F.col("_v").between(F.col("lo"), F.col("hi")) | (F.isnan("_v") & F.isnan("lo")))
    return inside(last, "_v").select(*group, "_v")


def inside(rows: DataFrame, along: str) -> DataFrame:
    """Of the counted rows of each target, along an axis, the one that holds the wanted rank; ``_want`` becomes the rank inside it."""
    upto = F.sum("_c").over(W.partitionBy("_g", "_spec", "_rank").orderBy(along))
    keep = [c for c in rows.columns if c != "_want"]
    return (rows.withColumn("_to", upto).where((F.col("_want") < F.col("_to")) & (F.col("_want") >= F.col("_to") - F.col("_c")))
            .select(*keep, (F.col("_want") - (F.col("_to") - F.col("_c"))).alias("_want")).drop("_slice"))
