"""Clustered bootstrap, searched-threshold correction, stratified permutation.

Draws are functions of counters (``functions.rng``), so results do not depend
on partitioning and a recomputed task reproduces them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import rng
from fungo.operators.prefix import id_order, position
from fungo.session import cut_lineage, parallel_parts, spread, written

ROUNDS = 24
CHUNK = 8192
FEW = 200_000


def cluster_parts(df: DataFrame, keys: Sequence[str], cluster: str, value: str,
                  outcome: str | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per cluster: sum and count of ``value``, the range of outcomes,
    and further sums. Written out, as every later step starts from it."""
    y = F.col(outcome) if outcome else F.lit(0.0)
    return written(df.groupBy(*keys, F.col(cluster).alias("_cluster")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.min(y).alias("_lo"), F.max(y).alias("_hi"),
        *[F.sum(v).alias(k) for k, v in (sums or {}).items()]))


def interval(parts: DataFrame, keys: Sequence[str], skip_constant: bool, draws: int = 2000,
             seed: int = 11, min_clusters: int = 10, min_usable: int = 100) -> DataFrame:
    """90 per cent interval of a mean over resampled clusters.

    A mean over a resample needs only each cluster's sum and count, so the cost
    is draws x clusters whatever the number of rows. Up to ``FEW`` clusters are
    broadcast and each task sums the draws it made before anything is shuffled;
    more are joined by merge. The planner does not choose, as it takes the draws,
    which are exploded, for smaller than the clusters.
    """
    keys = list(keys)
    few = parts.count() <= FEW
    by = W.partitionBy(*keys)
    parts = parts.withColumns({"_i": F.row_number().over(by.orderBy("_cluster")) - 1,
                               "_c": F.count(F.lit(1)).over(by)})
    slots = (spread(parts.where(F.col("_c") >= min_clusters).select(*keys, "_c", "_i"), *keys, "_i")
             .select(*keys, "_c", "_i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_d"))
             .select(*keys, "_d", (rng.mix(F.col("_d").cast("bigint"), F.col("_i").cast("bigint"), seed)
                                   % F.col("_c")).cast("int").alias("_i")))
    clusters = parts.select(*keys, "_i", "_s", "_n", "_lo", "_hi")
    drawn = slots.join(F.broadcast(clusters) if few else clusters.hint("merge"), [*keys, "_i"])
    means = drawn.groupBy(*keys, "_d").agg(
        (F.sum("_s") / F.sum("_n")).alias("_m"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    if skip_constant:
        means = means.where(F.col("_lo") < F.col("_hi"))
    ends = means.groupBy(*keys).agg(
        F.count("_m").alias("usable_draws"),
        F.percentile("_m", F.array(F.lit(0.05), F.lit(0.95))).alias("_p"))
    return ends.where(F.col("usable_draws") >= min_usable).select(
        *keys, "usable_draws", F.round(F.col("_p")[0], 5).alias("low"),
        F.round(F.col("_p")[1], 5).alias("high"))


def cluster_bootstrap(df: DataFrame, keys: Sequence[str], cluster: str, value: str,
                      outcome: str | None = None, draws: int = 2000, seed: int = 11,
                      min_clusters: int = 10, min_usable: int = 100) -> DataFrame:
    """Interval of the mean of ``value``; with ``outcome``, a resample holding a
    single outcome is skipped."""
    return interval(cluster_parts(df, keys, cluster, value, outcome), keys, outcome is not None,
                    draws, seed, min_clusters, min_usable)


def search_correction(frame: DataFrame, ident: str, draws: int = 5000, seed: int = 3,
                      cuts: Sequence[int] = C.SEARCH_CUTS, min_rows: int = 5) -> DataFrame:
    """Price a search over thresholds when the price is right.

    Rows are reduced to per-band sums per draw before the shuffle; the sum over
    a cut is the sum of the bands at or above it.
    """
    cuts = sorted(cuts)
    band = sum((F.col("gap_pts") >= c).cast("int") for c in cuts)
    rows = frame.withColumn("_b", band).where(F.col("_b") > 0).select(
        "_b", F.col(ident).cast("bigint").alias("_id"), "won", "market_prob")
    # Simulating costs draws times the rows, so they are narrowed, evened out
    # and written once.
    rows = cut_lineage(spread(rows, "_id"))

    def at_or_above(df, key, columns):
        above = W.partitionBy(*key).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({c: F.sum(c).over(above) for c in columns})

    # A cut between two occupied bands selects the same rows as the next
    # occupied one, so reading the occupied bands covers every usable cut.
    # There are at most as many bands as cuts.
    whole = W.partitionBy(F.lit(0))
    bands = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum(F.col("won") / F.col("market_prob")).alias("w"))
    usable = at_or_above(bands, [F.lit(0)], ["n", "w"]).where(F.col("n") >= min_rows).select(
        "_b", "n", F.max(F.col("w") / F.col("n") - 1.0).over(whole).alias("obs"), F.max("_b").over(whole).alias("top"))
    # A task returns one array of sums over draws per band.
    sim = (rows.select("_b", "_id", "market_prob").mapInPandas(_simulated(len(cuts), draws, seed), "_b int, w array<double>")
           .select("_b", F.posexplode("w").alias("_d", "w")).select((F.col("_d") + 1).alias("_d"), "_b", "w"))
    # Bands without a simulated winner still count, with zero.
    empty = bands.select(F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_d"), "_b", F.lit(0.0).alias("w"))
    sim = sim.unionByName(empty).groupBy("_d", "_b").agg(F.sum("w").alias("w"))
    sim = at_or_above(sim, ["_d"], ["w"]).join(usable, "_b")
    best = sim.groupBy("_d", "obs", "top").agg(F.max(F.col("w") / F.col("n") - 1.0).alias("best"))
    return best.groupBy("obs", "top").agg(
        F.avg((F.col("best") >= F.col("obs")).cast("double")).alias("p"),
        F.avg("best").alias("m"), F.avg((F.col("best") > 0.30).cast("double")).alias("s")).select(
        F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("top")).alias("widest_usable_cut"),
        F.round(F.col("obs") * 100, 1).alias("best_observed_roi_pct"),
        F.round("p", 4).alias("p_value_after_search"),
        F.round(F.col("m") * 100, 1).alias("null_best_cut_mean_roi_pct"),
        F.round("s", 3).alias("null_share_above_30pct"), F.lit(len(cuts)).alias("cuts_searched"))


def _simulated(bands: int, draws: int, seed: int):
    def run(batches):
        sums = np.zeros((bands + 1, draws))
        when = np.arange(1, draws + 1, dtype=np.int64)
        for batch in batches:
            ids, bands_of, price = (batch[k].to_numpy() for k in ("_id", "_b", "market_prob"))
            least = below(price).astype(np.uint64)[:, None]
            # Blocks of rows and draws that stay in a core's cache.
            for start in range(0, len(batch), 128):
                rows = slice(start, start + 128)
                paid = np.zeros((bands + 1, len(ids[rows])))
                paid[bands_of[rows], np.arange(len(ids[rows]))] = 1.0 / price[rows]
                for first in range(0, draws, 128):
                    cut = slice(first, first + 128)
                    sums[:, cut] += paid @ (rng.mix_grid(ids[rows], when[cut], seed) < least[rows]).astype(float)
        held = np.flatnonzero(sums.any(axis=1))
        if len(held):
            yield pd.DataFrame({"_b": held.astype("int32"), "w": [sums[b] for b in held]})
    return run


def below(price: np.ndarray) -> np.ndarray:
    """The least whole number that, divided by ``rng.M``, is not below the price."""
    m = float(rng.M)
    least = np.ceil(price * m)
    least = np.where((least - 1.0) / m >= price, least - 1.0, least)
    return np.where(least / m < price, least + 1.0, least).astype(np.int64)


def group_spread(df: DataFrame, keys: Sequence[str], group: str, value: str,
                 min_rows: int = 15, min_groups: int = 5) -> DataFrame:
    """Row-weighted standard deviation of group means; null with few groups."""
    keys = list(keys)
    means = (df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group)
             .agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
             .where(F.col("_n") >= min_rows))
    # Deviations are taken from the group-free mean first, which keeps the
    # second moment well conditioned.
    centre = means.groupBy(*keys).agg((F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("_c"))
    joined = means.join(centre, keys) if keys else means.withColumn(
        "_c", centre.scalar())
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sqrt(F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_c"), F.lit(2.0)))
               / F.sum("_n")).alias("_sd"))
    return out.select(*keys, "groups",
                      F.when(F.col("groups") >= min_groups, F.col("_sd")).alias("spread"))


def permutation_test(df: DataFrame, keys: Sequence[str], stratum: str, group: str, value: str,
                     ident: str, draws: int = 2000, seed: int = 5, min_rows: int = 15,
                     min_groups: int = 5, min_usable: int = 100) -> DataFrame:
    """Observed spread of group means against labels shuffled inside strata.

    A shuffle inside a stratum of n rows is a bijection on 0..n-1, computed row
    by row with a swap-or-not network (Hoang, Morris and Rogaway, 2012): nothing
    is sorted and no permuted copy of the table is shuffled. Rows are laid out by label, so the
    label at a position follows from the label counts alone. Tasks work on
    fixed-size position chunks and return one sum per draw and label.
    """
    keys = list(keys)
    block = [*keys, stratum]
    # Four columns, read by every step below: written out once.
    base = cut_lineage(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(
        *block, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"),
        F.col(ident).cast("bigint").alias("_id")))
    sizes = base.groupBy(*block, "_g").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*block).orderBy("_g")
    sizes = sizes.withColumns({
        "_to": F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_size": F.sum("_n").over(W.partitionBy(*block))})
    spots = position(base, [*block, "_g"], id_order("_id"), "_k").join(
        sizes.select(*block, "_g", (F.col("_to") - F.col("_n")).alias("_from"), "_size"),
        [*block, "_g"]).withColumn("_pos", F.col("_from") + F.col("_k") - 1)
    spots = spots.withColumn("_chunk", F.floor(F.col("_pos") / CHUNK).cast("bigint"))

    # Centre on the mean of the rows that count, as the spread is shift free.
    totals = sizes.groupBy(*keys, "_g").agg(F.sum("_n").alias("_w"))
    # Fresh names, as both sides of the cogroup come from the same rows.
    spot = [f"_b{i}" for i in range(len(block))]
    bounds = sizes.select(
        *[F.col(k).alias(b) for k, b in zip(block, spot)], F.col("_g").alias("_label"), "_to", "_size",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_size") - 1) / CHUNK).cast("bigint")))
        .alias("_part"))
    mean = base.groupBy(*keys).agg(F.avg("_v").alias("_mean"))
    spots = (spots.join(mean, keys) if keys else spots.withColumn("_mean", mean.scalar())).select(
        *block, "_chunk", "_pos", "_g", "_size", (F.col("_v") - F.col("_mean")).alias("_v"))

    # A fixed number of tasks: a chunk costs draws times its bytes.
    spots = spots.repartition(parallel_parts(base.sparkSession), *block, "_chunk")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in base.select(*keys, "_g").schema.fields)
    # A chunk gets the bounds of its stratum's labels. That is less than sending
    # the moved rows of every draw to their labels while a stratum has fewer
    # than draws x CHUNK labels.
    null = (spots.drop("_g", "_size").groupBy(*block, "_chunk").cogroup(bounds.groupBy(*spot, "_part"))
            .applyInPandas(_shuffled_sums(keys, draws, seed), f"{schema}, _d int, _s double"))
    null = null.groupBy(*keys, "_g", "_d").agg(F.sum("_s").alias("_s"))
    kept = totals.where(F.col("_w") >= min_rows)
    null = null.join(kept, [*keys, "_g"])
    m = F.col("_s") / F.col("_w")
    null = null.groupBy(*keys, "_d").agg(
        (F.sum(F.col("_w") * m * m) / F.sum("_w")
         - F.pow(F.sum("_s") / F.sum("_w"), F.lit(2.0))).alias("_var"))
    null = null.withColumn("_sd", F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))))

    seen = group_spread(base.select(*keys, "_g", "_v"), keys, "_g", "_v", min_rows, min_groups)
    seen = seen.where(F.col("spread").isNotNull())
    rows = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    if keys:
        both = null.join(seen.join(rows, keys), keys)
    else:
        both = null.withColumns({"spread": seen.select("spread").scalar(),
                                 "groups": seen.select("groups").scalar(),
                                 "rows": rows.scalar()}).where(F.col("spread").isNotNull())
    out = both.groupBy(*keys, "groups", "rows", "spread").agg(
        F.count(F.lit(1)).alias("_u"), F.median("_sd").alias("_med"),
        F.avg((F.col("_sd") >= F.col("spread")).cast("double")).alias("_p"))
    med = F.col("_med")
    return out.where(F.col("_u") >= min_usable).select(
        *keys, "groups", "rows", F.round("spread", 5).alias("observed_spread"),
        F.round(med, 5).alias("null_spread_median"), F.round("_p", 4).alias("p_value"),
        F.round(F.col("spread") - med, 5).alias("excess"),
        F.round(F.sqrt(F.greatest(F.col("spread") * F.col("spread") - med * med, F.lit(0.0))), 5)
        .alias("implied_true_sd"))


def permuted(pos: np.ndarray, size: int, draw: int, seed: int) -> np.ndarray:
    """Where each position goes in one draw; a bijection on 0..size-1.

    Each round pairs every position with its mirror around a random centre and
    swaps the pair on a coin that both ends share.
    """
    return permuted_grid(pos, size, np.array([draw]), seed)[0]


def permuted_grid(pos: np.ndarray, size: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """``permuted`` of every position in every draw, a row for each draw.

    The coin of ``rng.coin_np`` is the parity of a polynomial in the greater end,
    ``a x**2 + b x + g`` mod M, where only b and g depend on the round. All steps
    are in place, in unsigned words."""
    tick = draws.astype(np.int64)[:, None] * ROUNDS + np.arange(ROUNDS)
    centres = (rng.mix_np(tick, np.int64(1), seed) % size).astype(np.uint64)
    key = rng.mix_np(tick, np.int64(2), seed + 1)
    square = rng.A1 * rng.A1 % rng.M * rng.A3 % rng.M
    linear = (key * 2 % rng.M * square % rng.M).astype(np.uint64)
    # One more than the constant: see the parity below.
    constant = ((key * key % rng.M * square % rng.M + key) % rng.M + 1).astype(np.uint64)
    wide, mask, bits, one, square = (np.array(k, dtype=np.uint64) for k in (size, rng.M, 31, 1, square))
    x = np.repeat(pos.astype(np.uint64)[None, :], len(draws), axis=0)
    other, high, y = np.empty_like(x), np.empty_like(x), np.empty_like(x)
    folded = np.empty_like(x)

    def fold():
        np.right_shift(y, bits, out=folded)
        np.bitwise_and(y, mask, out=y)
        np.add(y, folded, out=y)

    for step in range(ROUNDS):
        # Below zero is a very large word, which ``size`` brings back.
        np.subtract(centres[:, step:step + 1], x, out=other)
        np.add(other, wide, out=high)
        np.minimum(other, high, out=other)
        np.maximum(x, other, out=high)
        np.multiply(high, square, out=y)
        np.add(y, linear[:, step:step + 1], out=y)
        fold()
        np.multiply(y, high, out=y)
        np.add(y, constant[:, step:step + 1], out=y)
        fold()
        if size > 1 << 24:  # else already below 2 M
            fold()
        # y is 1 to 2 M, one above the remainder or M more than that: the bit is
        # set where the coin is not.
        np.right_shift(y, bits, out=folded)
        np.add(y, folded, out=y)
        np.bitwise_and(y, one, out=y)
        np.subtract(x, other, out=x)
        np.multiply(x, y, out=x)
        np.add(x, other, out=x)
    return x.view(np.int64)


def _label_of(ends: np.ndarray, size: int):
    """Index of the label at a position. A table of at most 2**16 stretches of
    positions answers for those that hold one label; others are searched."""
    shift = max(0, int(size - 1).bit_length() - 16)
    first = np.arange(0, size, 1 << shift)
    label = np.searchsorted(ends, first, side="right")
    label[label != np.searchsorted(ends, np.minimum(first + (1 << shift), size) - 1, side="right")] = -1

    def find(x: np.ndarray) -> np.ndarray:
        at = label[x >> shift]
        mixed = np.flatnonzero(at < 0)
        at[mixed] = np.searchsorted(ends, x[mixed], side="right")
        return at
    return find


def _shuffled_sums(keys, draws, seed):
    def kernel(rows: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({**{k: [] for k in keys}, "_g": [], "_d": [], "_s": []})
        bounds = bounds.sort_values("_to")
        ends, labels = bounds["_to"].to_numpy(), bounds["_label"].to_numpy()
        size = int(bounds["_size"].iloc[0])
        pos, v = rows["_pos"].to_numpy(), rows["_v"].to_numpy()
        find = _label_of(ends, size)
        label, when, total = [], [], []
        # As many draws at a time as stay in a core's cache.
        some = max(1, 4 * CHUNK // len(pos))
        for first in range(1, draws + 1, some):
            block = np.arange(first, min(first + some, draws + 1))
            for draw, x in zip(block, permuted_grid(pos, size, block, seed)):
                at = find(x)
                hit = np.flatnonzero(np.bincount(at, minlength=len(labels)))
                label.append(labels[hit])
                total.append(np.bincount(at, weights=v, minlength=len(labels))[hit])
                when.append(np.full(len(hit), draw, dtype=np.int32))
        done = pd.DataFrame({"_g": np.concatenate(label), "_d": np.concatenate(when),
                             "_s": np.concatenate(total)})
        for k in keys:
            done[k] = rows[k].iloc[0]
        return done[[*keys, "_g", "_d", "_s"]]
    return kernel
