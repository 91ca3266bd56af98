"""Losses, calibration, bands and the model-versus-price report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators.resample import cluster_parts, interval


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(S.log_loss_term(p, y))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2.0)))


def roi(won: Column, price: Column) -> Column:
    return F.avg(won / price) - 1.0


def calibration_table(df: DataFrame, keys: list[str], p: str = "p", y: str = "y",
                      bins: int = 10, floor: int = 20) -> DataFrame:
    """Equal-width bins [low, high); p = 1 and thin bins are left out."""
    edges = [i / bins for i in range(bins + 1)]
    cell = F.coalesce(*[F.when((F.col(p) >= lo) & (F.col(p) < hi), i)
                        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))])
    out = (df.withColumn("bin", cell).where(F.col("bin").isNotNull()).groupBy(*keys, "bin")
           .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
           .where(F.col("n") >= floor))
    return out.select(*keys, "bin", "n", F.round("mp", 4).alias("predicted"),
                      F.round("my", 4).alias("realised"),
                      F.round(F.col("my") - F.col("mp"), 4).alias("error"))


def calibration_error(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.round(
        F.sum(F.abs("error") * F.col("n")) / F.sum("n"), 5).alias("calibration_error"))


def by_market(scored: DataFrame, outcomes: DataFrame, runline: float = -1.5,
              total: float = 8.5) -> DataFrame:
    """Long (game_pk, season, market, p, y) from long predictions and results."""
    joined = scored.join(outcomes.where(F.col("home_win").isNotNull()).select(
        "game_pk", "home_win", "run_diff", "total_runs"), "game_pk")
    y = (F.when(F.col("market") == "h2h", F.col("home_win"))
         .when(F.col("market") == "spreads", (F.col("run_diff") > -F.lit(runline)).cast("int"))
         .when(F.col("market") == "totals", (F.col("total_runs") > total).cast("int")))
    kept = ((F.col("market") == "h2h")
            | ((F.col("market") == "spreads") & (F.col("point") == runline))
            | ((F.col("market") == "totals") & (F.col("point") == total)))
    return joined.where(kept).select("game_pk", "season", "market",
                                     F.col("prob").alias("p"), y.cast("double").alias("y"))


def evaluate(scored: DataFrame, draws: int = 4000, seed: int = 11) -> DataFrame:
    """Per market: rate, losses, baseline, calibration error, season interval."""
    p, y = F.col("p"), F.col("y")
    parts = cluster_parts(scored.withColumn("_t", S.log_loss_term(p, y)), ["market"], "season", "_t",
                          sums={"_y": y, "_b": F.pow(p - y, F.lit(2.0))})
    n, rate = F.sum("_n"), F.sum("_y") / F.sum("_n")
    r = S.clip(rate, 1e-9, 1 - 1e-9)
    core = parts.groupBy("market").agg(
        n.alias("games"), F.round(rate, 5).alias("rate"), F.round(F.sum("_s") / n, 5).alias("log_loss"),
        F.round(-(rate * F.log(r) + (1.0 - rate) * F.log(1.0 - r)), 5).alias("log_loss_baseline"),
        F.round(F.sum("_b") / n, 5).alias("brier"))
    error = calibration_error(calibration_table(scored, ["market"]), ["market"])
    ends = interval(parts, ["market"], False, draws, seed, min_clusters=2)
    return (core.join(error, "market", "left")
            .join(ends.select("market", F.col("low").alias("log_loss_low"),
                              F.col("high").alias("log_loss_high")), "market", "left"))


def expected_run_accuracy(expected: DataFrame) -> DataFrame:
    """(side, predicted, actual) to mean, error and bias per side."""
    miss = F.col("predicted") - F.col("actual")
    return expected.groupBy("side").agg(
        F.round(F.avg("predicted"), 4).alias("mean_predicted"),
        F.round(F.avg("actual"), 4).alias("mean_actual"),
        F.round(F.avg(F.abs(miss)), 4).alias("mae"), F.round(F.avg(miss), 4).alias("bias"))


def compare(frame: DataFrame, draws: int = 2000, seed: int = 11, floor: int = 50,
            min_clusters: int = 10) -> DataFrame:
    """Forecast against price per market on the same outcomes.

    ``frame`` has market, official_date, model, price and y, without nulls.
    """
    model, price, y = F.col("model"), F.col("price"), F.col("y")
    lm, lp = S.log_loss_term(model, y), S.log_loss_term(price, y)
    # One pass over the rows; totals and resamples both start from the days.
    parts = cluster_parts(frame.withColumn("_gap", lm - lp), ["market"], "official_date", "_gap", "y",
                          {"_lm": lm, "_lp": lp, "_dis": F.abs(model - price)})
    n = F.sum("_n")
    core = parts.groupBy("market").agg(
        n.alias("games"), (F.sum("_lm") / n).alias("_lm"), (F.sum("_lp") / n).alias("_lp"),
        (F.sum("_dis") / n * 100.0).alias("_dis"))
    ends = interval(parts, ["market"], True, draws, seed, min_clusters)

    enough = F.col("games") >= floor

    def shown(column, places):
        return F.when(enough, F.round(column, places))

    low, high = F.when(enough, F.col("low")), F.when(enough, F.col("high"))
    return core.join(ends, "market", "left").select(
        "market", "games",
        shown(F.col("_lm"), 5).alias("log_loss_model"),
        shown(F.col("_lp"), 5).alias("log_loss_market"),
        shown(F.col("_lm") - F.col("_lp"), 5).alias("delta"),
        low.alias("ci_low"), high.alias("ci_high"),
        shown(F.col("_dis"), 3).alias("mean_abs_disagreement_pts"),
        F.when(enough, (F.col("_lm") < F.col("_lp")).cast("int")).alias("model_beats_market"),
        F.when(enough, S.verdict(low, high)).otherwise("insufficient sample").alias("verdict"))


def oriented_frame(frame: DataFrame) -> DataFrame:
    """Turn (market, model, price, y) to the side the model backs."""
    gap = F.col("model") - F.col("price")
    return frame.select(
        *[c for c in frame.columns if c not in ("model", "price", "y")],
        (F.abs(gap) * 100.0).alias("gap_pts"),
        S.oriented(gap, F.col("model")).alias("model_prob"),
        S.oriented(gap, F.col("price")).alias("market_prob"),
        S.oriented(gap, F.col("y")).alias("won"))


def band_table(frame: DataFrame, bands=C.BANDS) -> DataFrame:
    """Disjoint disagreement bands [low, high); empty ones do not appear."""
    label = F.coalesce(*[
        F.when((F.col("gap_pts") >= lo) & (F.col("gap_pts") < hi),
               f"{lo}-{hi}" if hi < 100 else f"{lo}+") for lo, hi in bands])
    return (frame.withColumn("band", label).where(F.col("band").isNotNull()).groupBy("band")
            .agg(F.count(F.lit(1)).alias("games"),
                 F.round(F.avg("model_prob") * 100, 1).alias("model_says"),
                 F.round(F.avg("market_prob") * 100, 1).alias("market_says"),
                 F.round(F.avg("won") * 100, 1).alias("actually_won"),
                 F.round(roi(F.col("won"), F.col("market_prob")) * 100, 1).alias("no_vig_roi_pct")))


def wide_disagreements(frame: DataFrame, threshold: float = 10.0) -> DataFrame:
    return frame.where(F.col("gap_pts") >= threshold).agg(
        F.lit(threshold).alias("threshold_pts"), F.count(F.lit(1)).alias("games"),
        F.round(F.avg("model_prob") * 100, 1).alias("model_says"),
        F.round(F.avg("market_prob") * 100, 1).alias("market_says"),
        F.round(F.avg("won") * 100, 1).alias("actually_won"))
