"""Gates, day cap, settlement and summaries of the paper ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S

REJECTION = ["screened_at", "game_pk", "market", "point", "side", "disagreement", "gate", "detail"]


def staked_by_day(ledger: DataFrame) -> DataFrame:
    return (ledger.where(~S.unset(F.col("official_date"))).groupBy("official_date")
            .agg(F.coalesce(F.sum(S.number(F.col("stake"))), F.lit(0.0)).alias("prior")))


def gate(locked: Column, now: Column) -> Column:
    """First failing gate of an oriented card row; null for a candidate."""
    gap = F.abs("disagreement")
    age = (F.unix_micros(now) - F.unix_micros(F.col("odds_fetched_at"))) / 60e6
    slip = S.american_to_prob(F.col("consensus")) - S.american_to_prob(F.col("price"))
    return (F.when(locked, "already_locked")
            .when(gap < C.EDGE_RULE, "below_edge_rule")
            .when(F.col("market_books") < C.MIN_BOOKS, "too_few_books")
            .when(~F.col("lead_minutes").between(C.MIN_LOCK_MINUTES, C.MAX_LOCK_MINUTES),
                  "outside_lock_window")
            .when(age > C.MAX_QUOTE_AGE_MINUTES, "stale_quote")
            .when(F.col("price").isNull() | F.col("consensus").isNull(), "no_executable_price")
            .when(slip > C.MAX_EXECUTION_GAP, "execution_deviation"))


def detail(now: Column) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(F.col("odds_fetched_at"))) / 60e6
    slip = S.american_to_prob(F.col("consensus")) - S.american_to_prob(F.col("price"))
    g = F.col("gate")
    return (F.when(g == "below_edge_rule",
                   F.format_string("%.4f < %s", F.abs("disagreement"), F.lit(str(C.EDGE_RULE))))
            .when(g == "too_few_books", F.col("market_books").cast("string"))
            .when(g == "outside_lock_window", F.concat(F.col("lead_minutes").cast("string"), F.lit(" min")))
            .when(g == "stale_quote", F.format_string("%.0f min old", age))
            .when(g == "execution_deviation",
                  F.format_string("%.4f > %s", slip, F.lit(str(C.MAX_EXECUTION_GAP))))
            .otherwise(""))


def screen(card: DataFrame, now: Column, locked: DataFrame | None = None,
           prior: DataFrame | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Every card row with its side, ``wager_id`` and ``gate``; a null gate is a
    wager. ``locked`` has wager_id, ``prior`` has official_date and prior."""
    gap = F.col("disagreement")
    rows = card.withColumn("side", S.backed_side(gap))
    rows = rows.withColumns({
        "wager_id": S.wager_id(F.col("game_pk"), F.col("market"), F.col("point"), F.col("side")),
        "price": F.when(F.col("side") == "home", F.col("best_price_home")).otherwise(F.col("best_price_away")),
        "book": F.when(F.col("side") == "home", F.col("best_book_home")).otherwise(F.col("best_book_away")),
        "consensus": F.when(F.col("side") == "home", F.col("consensus_price_home"))
        .otherwise(F.col("consensus_price_away"))})
    if locked is None:
        held = F.lit(False)
    else:
        rows = rows.join(locked.select("wager_id").distinct().withColumn("_held", F.lit(True)),
                         "wager_id", "left")
        held = F.coalesce(F.col("_held"), F.lit(False))
    rows = rows.withColumn("gate", gate(held, now)).drop("_held")
    rows = rows.withColumn("detail", detail(now)).drop("consensus")
    return day_cap(rows, prior, ordinal)


def day_cap(rows: DataFrame, prior: DataFrame | None = None, ordinal: str = "ordinal",
            cap: float = C.DAY_CAP, stake: float = C.STAKE) -> DataFrame:
    """Turn candidates beyond the day's stake into ``day_cap`` rejections.

    The stake is constant, so at most cap // stake rows of a day can be taken.
    A rank filter with a constant bound is cut down inside every input task
    before the shuffle, so one crowded day does not gather in one task.
    """
    most = int(cap // stake)
    widest = W.partitionBy("official_date").orderBy(
        F.round(F.abs("disagreement"), 6).desc(), F.col(ordinal))
    free = rows.where(F.col("gate").isNull()).select(
        "official_date", "disagreement", ordinal, "wager_id")
    top = free.withColumn("_rank", F.row_number().over(widest)).where(F.col("_rank") <= most)
    if prior is None:
        top = top.withColumn("prior", F.lit(0.0))
    else:
        top = top.join(prior.select("official_date", "prior"), "official_date", "left")
    taken = top.where(F.coalesce(F.col("prior"), F.lit(0.0)) + F.col("_rank") * stake <= cap)
    taken = taken.select("wager_id", ordinal, F.lit(True).alias("_taken"))
    over = F.col("gate").isNull() & F.col("_taken").isNull()
    return rows.join(taken, ["wager_id", ordinal], "left").withColumns({
        "detail": F.when(over, F.format_string("%s at %su", F.col("official_date").cast("string"),
                                               F.lit(f"{cap:g}"))).otherwise(F.col("detail")),
        "gate": F.when(over, "day_cap").otherwise(F.col("gate"))}).drop("_taken")


def wagers(screened: DataFrame, now: Column) -> DataFrame:
    gap = F.col("disagreement")
    return screened.where(F.col("gate").isNull()).select(
        "wager_id", now.alias("placed_at"), "game_pk", "official_date", "commence_time",
        "home_team", "away_team", "market", "point", "side",
        F.round(S.oriented(gap, F.col("model_prob_home")), 6).alias("model_prob"),
        F.round(S.oriented(gap, F.col("market_prob_home")), 6).alias("market_prob"),
        F.round(F.abs(gap), 6).alias("disagreement"),
        "price", "book", F.lit(C.STAKE).alias("stake"), "market_books", "market_spread",
        "lead_minutes", (F.col("market_spread") > C.WIDE_MARKET).cast("int").alias("wide_market"),
        "model_version", "model_kind", F.lit(C.STAKING_POLICY).alias("staking_policy_version"),
        F.lit(None).cast("timestamp").alias("settled_at"), F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("double").alias("profit"))


def rejections(screened: DataFrame, now: Column) -> DataFrame:
    capped = F.col("gate") == "day_cap"
    shown = F.when(capped, F.abs("disagreement")).otherwise(F.col("disagreement"))
    return (screened.where(F.col("gate").isNotNull())
            .withColumns({"screened_at": now, "disagreement": F.round(shown, 6)})
            .select(*REJECTION))


def settle(ledger: DataFrame, games: DataFrame, now: Column) -> DataFrame:
    """Score open wagers of finished games; everything else passes unchanged.

    ``games`` must hold one row per game_pk.
    """
    results = games.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).select(
        "game_pk", F.col("home_score").alias("_h"), F.col("away_score").alias("_a"))
    rows = ledger.join(results, "game_pk", "left")
    fresh = F.when(S.unset(F.col("outcome")), S.outcome(
        F.col("market"), F.col("side"), F.col("point"), F.col("_h"), F.col("_a")))
    rows = rows.withColumn("_new", fresh)
    stake = F.col("stake").cast("double")
    gain = (F.when(F.col("_new") == "win", S.payout(F.col("price"), stake))
            .when(F.col("_new") == "loss", -stake).when(F.col("_new") == "push", F.lit(0.0)))
    new = F.col("_new").isNotNull()
    return rows.withColumns({
        "profit": F.when(new, F.round(gain, 4)).otherwise(F.col("profit")),
        "settled_at": F.when(new, now).otherwise(F.col("settled_at")),
        "outcome": F.when(new, F.col("_new")).otherwise(
            F.when(~S.unset(F.col("outcome")), F.col("outcome")))}).select(*ledger.columns)


def summarise(ledger: DataFrame, by: str = "market") -> DataFrame:
    """Counts, record and return in total (null ``by``) and per market."""
    done = ~S.unset(F.col("outcome"))
    stake, profit = (F.when(done, S.number(F.col(c))) for c in ("stake", "profit"))
    out = ledger.rollup(by).agg(
        F.count(F.lit(1)).alias("wagers"), F.count_if(~done).alias("open"),
        F.count_if(done).alias("settled"), F.sum(stake).alias("_s"), F.sum(profit).alias("_p"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("win", "loss", "push")])
    return out.select(by, "wagers", "open", "settled", "win", "loss", "push",
                      F.round("_s", 2).alias("units_staked"), F.round("_p", 4).alias("units_profit"),
                      F.round(F.try_divide("_p", "_s"), 5).alias("roi"))


def rejections_by_gate(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def latest_gate(rejected: DataFrame, ordinal: str) -> DataFrame:
    return rejected.groupBy("game_pk", "market", "point").agg(
        F.max_by("gate", ordinal).alias("last_gate"))
