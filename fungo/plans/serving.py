"""Pricing the games still to come, and the board shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators import quotes as Q
from fungo.operators.match import match_events, unmatched
from fungo.plans.comparison import matchable_events, matchable_games
from fungo.plans.modelling import fit_runs

c = F.col


def quoted_points(lines: DataFrame) -> DataFrame:
    """(market, points): the distinct quoted lines of each market that has a line, in order."""
    quoted = lines.where(c("market").isin("spreads", "totals") & c("point").isNotNull())
    return quoted.groupBy("market").agg(F.sort_array(F.collect_set("point")).alias("points"))


def offered_points(lines: DataFrame) -> list[tuple[str, float | None]]:
    """Distinct quoted lines, with the usual ones where none is quoted. A line
    is a score in half steps, so there are few."""
    found = {r["market"]: r["points"] for r in quoted_points(lines).collect()}
    return [("h2h", None), *(("spreads", p) for p in found.get("spreads", [-1.5])), *(("totals", p) for p in found.get("totals", [8.5]))]


def build_card(lines: DataFrame, games: DataFrame, features: DataFrame, now: Column,
               kind: str = "glm", columns=C.FEATURE_COLUMNS, ordinal: str = "ordinal",
               model=None) -> tuple[DataFrame, DataFrame]:
    """(card rows, unmatched events): board lines beside the model's price."""
    board = lines.where(S.is_future(c("commence_time"), now)).withColumn(
        "commence", c("commence_time").try_cast("timestamp"))
    matches = match_events(matchable_events(board, ordinal), matchable_games(games))
    found = matches.where(c("game_pk").isNotNull()).select(
        "event_id", c("game_pk").cast(games.schema["game_pk"].dataType).alias("game_pk"))
    if model is None:
        played = games.where(c("home_score").isNotNull()).select("game_pk")
        model = fit_runs(features.join(played, "game_pk", "left_semi"), games, kind, columns)
    ahead = features.join(found, "game_pk", "left_semi")
    prices = model.price(ahead, games, offered_points(board)).select(
        "game_pk", c("market").alias("_m"), c("point").alias("_p"),
        S.push_adjusted(c("prob"), c("push")).alias("model_prob"), "expected_home", "expected_away")
    rows = (board.join(found, "event_id").join(games.select("game_pk", "official_date"), "game_pk")
            .join(prices, "game_pk")
            .where((c("market") == c("_m")) & c("point").eqNullSafe(c("_p"))))
    return rows.select(
        "game_pk", "official_date", c("commence").alias("commence_time"), "home_team", "away_team",
        "market", "point", F.round("model_prob", 6).alias("model_prob_home"),
        F.round("consensus_prob_home", 6).alias("market_prob_home"),
        F.round(c("model_prob") - c("consensus_prob_home"), 6).alias("disagreement"),
        "market_books", "market_spread", "consensus_price_home", "consensus_price_away",
        "best_price_home", "best_book_home", "best_price_away", "best_book_away",
        F.round("expected_home", 4).alias("expected_home_runs"),
        F.round("expected_away", 4).alias("expected_away_runs"),
        S.lead_minutes(c("commence"), now).alias("lead_minutes"), c("fetched_at").alias("odds_fetched_at"),
        F.lit(C.MODEL_VERSION).alias("model_version"), F.lit(kind).alias("model_kind"),
        now.alias("priced_at"), ordinal), unmatched(matches)


def largest(card: DataFrame, n: int = 8) -> DataFrame:
    return card.orderBy(F.abs("disagreement").desc(), "game_pk", "market", "point").limit(n)


def board_lines(paired: DataFrame, fetched_at: Column) -> DataFrame:
    """Consensus lines with their event's names, in reading order."""
    lines = Q.consensus_lines(paired)
    events = Q.first_per_event(paired, ["home_team", "away_team", "commence_time"], "ordinal")
    return (lines.join(events, "event_id")
            .withColumns({"date": F.to_date("commence_time"), "fetched_at": fetched_at,
                          "odds_source": F.lit(C.CONSENSUS_VERSION)})
            .orderBy("event_id", "market", F.coalesce("point", F.lit(0.0))))


def build_board(card: DataFrame, ledger: DataFrame, rejected: DataFrame) -> DataFrame:
    """Card, locked wager and latest gate per (game, market, point). A locked
    wager is shown as struck. ``rejected`` comes from ``latest_gate``."""
    keep = ("side", "model_prob", "market_prob", "disagreement", "price", "book", "market_books",
            "market_spread", "lead_minutes", "stake")
    # The backed side may have changed between runs: the last wager struck on a
    # line stands for it.
    struck = F.max_by(F.struct(*keep), F.struct("placed_at", "wager_id")).alias("_w")
    locked = ledger.groupBy(c("game_pk").alias("_g"), c("market").alias("_m"), c("point").alias("_p")).agg(struck).select(
        "_g", "_m", "_p", F.lit(True).alias("_bet"), *[c(f"_w.{k}").alias(f"w_{k}") for k in keep])
    gates = rejected.select(c("game_pk").alias("_rg"), c("market").alias("_rm"), c("point").alias("_rp"), "last_gate")
    rows = card.where(c("model_prob_home").isNotNull() & c("market_prob_home").isNotNull())
    rows = rows.join(locked, (c("game_pk") == c("_g")) & (c("market") == c("_m"))
                     & c("point").eqNullSafe(c("_p")), "left")
    rows = rows.join(gates, (c("game_pk") == c("_rg")) & (c("market") == c("_rm"))
                     & c("point").eqNullSafe(c("_rp")), "left")
    gap = c("model_prob_home") - c("market_prob_home")
    lean = S.backed_side(gap)
    side = F.coalesce("w_side", lean)

    def best(what):
        return F.when(lean == "home", c(f"best_{what}_home")).otherwise(c(f"best_{what}_away"))

    bet = F.coalesce("_bet", F.lit(False))
    pct = F.coalesce("w_disagreement", F.abs(gap))
    return rows.select(
        "game_pk", F.concat_ws(" @ ", "away_team", "home_team").alias("game"), "market", "point",
        S.market_label(c("market"), c("point")).alias("market_label"),
        S.side_label(c("market"), side, c("home_team"), c("away_team"), c("point")).alias("pick"),
        F.round(F.coalesce("w_model_prob", S.oriented(gap, c("model_prob_home"))) * 100, 1).alias("model"),
        F.round(F.coalesce("w_market_prob", S.oriented(gap, c("market_prob_home"))) * 100, 1).alias("consensus"),
        F.round(F.abs(pct) * 100, 1).alias("gap"), F.coalesce("w_price", best("price")).alias("price"),
        F.coalesce("w_book", best("book")).alias("book"),
        F.coalesce("w_market_books", "market_books").alias("books"),
        F.round(F.coalesce("w_market_spread", "market_spread") * 100, 1).alias("spread"),
        F.coalesce("w_lead_minutes", "lead_minutes").alias("lead"),
        c("commence_time").alias("commence"), c("official_date").alias("date"),
        F.format_string("%.2f-%.2f", F.coalesce("expected_away_runs", F.lit(0.0)),
                        F.coalesce("expected_home_runs", F.lit(0.0))).alias("runs"),
        bet.cast("int").alias("bet"), F.coalesce("w_stake", F.lit(0.0)).alias("stake"),
        F.coalesce(S.gate_label(c("last_gate")), F.when(bet, "").otherwise("not taken")).alias("reason"))


def in_reading_order(board: DataFrame) -> DataFrame:
    return board.orderBy(c("bet").desc(), c("gap").desc())


def settled_rows(ledger: DataFrame) -> DataFrame:
    done = ledger.where(~S.unset(c("outcome")))
    return done.select(
        c("official_date").alias("date"),
        S.side_label(c("market"), c("side"), c("home_team"), c("away_team"), c("point")).alias("pick"),
        S.market_label(c("market"), c("point")).alias("market"),
        F.round(F.coalesce("model_prob", F.lit(0.0)) * 100, 1).alias("model"),
        F.round(F.coalesce("disagreement", F.lit(0.0)) * 100, 1).alias("gap"), "price", "outcome",
        F.round(F.coalesce("profit", F.lit(0.0)), 3).alias("profit")).orderBy(c("date").desc())


def headline(ledger: DataFrame, report: DataFrame, credits: DataFrame, board: DataFrame) -> DataFrame:
    """Counts and sums shown at the top, one row."""
    done = ~S.unset(c("outcome"))
    return ledger.agg(
        F.count(F.lit(1)).alias("wagers"), F.count_if(done).alias("settled"),
        F.coalesce(F.sum(F.when(done, c("stake"))), F.lit(0.0)).alias("staked"),
        F.coalesce(F.sum(F.when(done, c("profit"))), F.lit(0.0)).alias("profit"),
        F.max(F.when(done, c("official_date"))).alias("latest_settled")).withColumns({
            "markets_beaten": report.agg(F.count_if(c("ci_high") < 0).alias("v")).scalar(),
            "board_rows": board.agg(F.count(F.lit(1)).alias("v")).scalar(),
            "captured_at": board.agg(F.max("odds_fetched_at").alias("v")).scalar(),
            "credits_remaining": credits.agg(F.max_by("credits_remaining", "fetched_at").alias("v")).scalar()})


def archive_coverage(games: DataFrame, weather: DataFrame) -> DataFrame:
    """Share of finished games with weather, and rows per roof category."""
    played = games.where(c("home_score").isNotNull()).select("game_pk")
    rows = played.join(weather.select("game_pk", "roof_category").dropDuplicates(["game_pk"]), "game_pk", "left")
    return rows.rollup("roof_category").agg(F.count(F.lit(1)).alias("games"), F.grouping("roof_category").alias("is_total"))
