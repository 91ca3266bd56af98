"""Forecasts against prices: from raw quotes to a verdict per market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators import metrics, quotes as Q
from fungo.operators.match import match_events, unmatched
from fungo.session import cut_lineage

c = F.col


def matchable_events(quotes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    events = Q.first_per_event(quotes, ["home_team", "away_team", "commence"], ordinal)
    return events.select("event_id", S.team_key(c("home_team")).alias("home_key"),
                         S.team_key(c("away_team")).alias("away_key"), "commence")


def matchable_games(games: DataFrame) -> DataFrame:
    return games.select("game_pk", S.team_key(c("home_team_name")).alias("home_key"),
                        S.team_key(c("away_team_name")).alias("away_key"),
                        c("game_date_utc").try_cast("timestamp").alias("start"))


def priced_games(quotes: DataFrame, games: DataFrame, min_books: int = C.MIN_BOOKS,
                 ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(entry and close price per game and line, unmatched events)."""
    live = Q.before_start(quotes)
    matches = match_events(matchable_events(live, ordinal), matchable_games(games))
    found = matches.where(c("game_pk").isNotNull()).select(
        "event_id", c("game_pk").cast(games.schema["game_pk"].dataType).alias("game_pk"))
    dated = found.join(games.select("game_pk", "official_date"), "game_pk")
    return Q.entry_close(live, min_books).join(dated, "event_id"), unmatched(matches)


def comparison_frame(priced: DataFrame, predictions: DataFrame, games: DataFrame,
                     price_column: str = "close_prob") -> DataFrame:
    """(market, official_date, model, price, y) of finished, priced games."""
    results = games.where(c("home_win").isNotNull() & c("total_runs").isNotNull()
                          & c("run_diff").isNotNull()).select("game_pk", "home_win", "total_runs", "run_diff")
    y = (F.when(c("market") == "h2h", c("home_win"))
         .when(c("market") == "spreads", (c("run_diff") > -c("point")).cast("int"))
         .when(c("market") == "totals", (c("total_runs") > c("point")).cast("int")))
    lines = predictions.select("game_pk", "market", c("point").alias("_line"), c("prob").alias("model"))
    joined = priced.where(c(price_column).isNotNull()).join(lines, ["game_pk", "market"])
    joined = joined.where(c("point").eqNullSafe(c("_line")) & c("model").isNotNull())
    books = price_column.split("_")[0] + "_books"
    return joined.join(results, "game_pk").select(
        "game_pk", "market", "official_date", "model", c(price_column).alias("price"),
        y.cast("double").alias("y"), c(books).alias("books"))


def market_report(quotes: DataFrame, games: DataFrame, predictions: DataFrame,
                  draws: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(coverage, verdict per price and market)."""
    # A few rows per game, read four times below: written once.
    priced, missing = (cut_lineage(df) for df in priced_games(quotes, games))
    cover = Q.coverage(quotes, missing, priced)
    parts = [metrics.compare(comparison_frame(priced, predictions, games, p), draws)
             .withColumn("price", F.lit(p)) for p in ("close_prob", "entry_prob")]
    return cover, parts[0].unionByName(parts[1])


def beaten_markets(report: DataFrame) -> DataFrame:
    """Markets whose whole interval says the model is better."""
    return report.where(c("ci_high") < 0).select("market")


def verdict_rows(report: DataFrame) -> DataFrame:
    label = (F.when(c("market") == "h2h", "moneyline").when(c("market") == "spreads", "run line")
             .when(c("market") == "totals", "total").otherwise(c("market")))
    return report.select(label.alias("market"), "games", "delta", "ci_low", "ci_high", "verdict",
                         F.coalesce((c("ci_high") < 0).cast("int"), F.lit(0)).alias("beaten"))


def live_gate(report: DataFrame) -> DataFrame:
    """Why nothing is live: one row of status and reason, whatever the report says."""
    n = report.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("ci_high") < 0).alias("b"))
    reason = F.when(c("n") == 0, "no market comparison has been produced").otherwise(F.format_string(
        "the model beats the closing price on %d of %d markets with an interval excluding zero; "
        "that is necessary, not sufficient, and no wager is placed", c("b"), c("n")))
    return n.select(F.lit("research_only").alias("status"),
                    F.when(c("n") == 0, "unavailable").otherwise("available").alias("comparison"),
                    reason.alias("reason"))


def umpire_frame(games: DataFrame, umpires: DataFrame, predictions: DataFrame,
                 pitching: DataFrame | None = None) -> DataFrame:
    """Finished games with their plate umpire, residuals and strikeouts."""
    p = predictions.where(c("market") == "h2h").select("game_pk", "prob", "expected_home", "expected_away")
    out = (games.where(c("home_score").isNotNull())
           .select("game_pk", "season", "official_date", "home_win", "total_runs")
           .join(umpires.select("game_pk", "hp_umpire_id", "hp_umpire_name"), "game_pk")
           .join(p, "game_pk", "left"))
    out = out.select(
        "game_pk", "season", "official_date", "hp_umpire_id", "hp_umpire_name",
        (c("home_win") - c("prob")).alias("resid_win"),
        (c("total_runs") - (c("expected_home") + c("expected_away"))).alias("resid_total"))
    if pitching is not None:
        ks = pitching.groupBy("game_pk").agg(F.sum("strike_outs").alias("game_strikeouts"))
        out = out.join(ks, "game_pk", "left")
    return out


def umpire_report(frame: DataFrame, draws: int = 2000) -> DataFrame:
    """Pooled (season null) and per-season permutation tests of each measure."""
    from fungo.operators.resample import permutation_test
    names = {"game_strikeouts": "strikeouts_per_game", "resid_total": "residual_total_runs",
             "resid_win": "residual_home_win"}
    have = [n for n in names if n in frame.columns]
    long = frame.select("game_pk", "season", "hp_umpire_id", F.explode(F.array(*[
        F.struct(F.lit(names[n]).alias("measure"), c(n).cast("double").alias("value")) for n in have])).alias("m")
    ).select("game_pk", "season", "hp_umpire_id", "m.*")
    pooled = permutation_test(long, ["measure"], "season", "hp_umpire_id", "value", "game_pk", draws)
    yearly = permutation_test(long.withColumn("one", c("season")), ["measure", "season"], "one",
                              "hp_umpire_id", "value", "game_pk", draws // 2)
    return pooled.withColumn("season", F.lit(None).cast("int")).unionByName(
        yearly.withColumn("season", c("season").cast("int")))
