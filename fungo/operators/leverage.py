"""Win expectancy by state, leverage of a plate appearance, reliever workload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators.prefix import id_order, running

STATE = ["late", "is_top", "outs_before", "diff"]


def state_before(plays: DataFrame, keys: list[str], turn: str, half: list[str],
                 outs: str, scores: dict[str, str], bounded: bool = False) -> DataFrame:
    """State before each play: scores of the previous play, and the last
    non-zero out count since the half changed, at most two.

    ``bounded`` says that a key's plays came out of one document, so plain
    windows over the key are safe and need a single shuffle.
    """
    order = id_order(turn)

    def before(df, over, sums=None, lasts=None):
        if not bounded:
            return running(df, over, order, sums, lasts)
        w = W.partitionBy(*over).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({
            **{k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in (sums or {}).items()},
            **{k: F.last(v, ignorenulls=True).over(w) for k, v in (lasts or {}).items()}})

    marked = before(plays.withColumn("_half", F.struct(*half)), keys, lasts={
        "_was": F.col("_half"),
        **{name: F.coalesce(F.col(source), F.lit(0)) for name, source in scores.items()}})
    changed = F.coalesce(F.col("_half") != F.col("_was"), F.lit(True)).cast("int")
    marked = before(marked.withColumn("_cut", changed), keys, sums={"_earlier": F.col("_cut")})
    marked = marked.withColumn("_stint", F.col("_earlier") + F.col("_cut"))
    marked = before(marked, [*keys, "_stint"], lasts={"_outs": F.when(F.col(outs) != 0, F.col(outs))})
    return marked.withColumns({
        "outs_before": F.least(F.coalesce(F.col("_outs"), F.lit(0)), F.lit(2)).cast("int"),
        **{name: F.coalesce(F.col(name), F.lit(0)) for name in scores},
    }).drop("_half", "_was", "_cut", "_earlier", "_stint", "_outs")


def with_state(plays: DataFrame, games: DataFrame) -> DataFrame:
    results = games.where(F.col("home_win").isNotNull()).select("game_pk", "home_win")
    gap = F.col("home_score_before") - F.col("away_score_before")
    return plays.join(results, "game_pk").withColumns({
        "late": F.least(F.col("inning"), F.lit(C.LATE_INNING)),
        "diff": S.clip(gap, -C.MAX_SCORE_DIFF, C.MAX_SCORE_DIFF).cast("int")})


def win_expectancy(staged: DataFrame, state=tuple(STATE), won: str = "home_win",
                   min_rows: int = C.MIN_STATE_ROWS) -> DataFrame:
    """(state, n, we): observed rate, or the overall one for rare states."""
    table = staged.groupBy(*state).agg(F.count(F.lit(1)).alias("n"), F.sum(won).alias("w"))
    overall = table.agg((F.sum("w") / F.sum("n")).alias("o")).scalar()
    return table.withColumn("overall", overall).select(
        *state, "n", "overall",
        F.when(F.col("n") >= min_rows, F.col("w") / F.col("n")).otherwise(F.col("overall")).alias("we"))


def leverage_table(expectancy: DataFrame, limit: int = C.MAX_SCORE_DIFF) -> DataFrame:
    """Leverage per state: reach of one run and one out, over the average reach.

    Works on states, of which there are at most late x half x outs x diff, not
    on plays; that bound is what makes the lookups broadcastable.
    """
    towards = F.when(F.col("is_top") == 0, 1).otherwise(-1)
    here = expectancy.withColumns({
        "diff_run": S.clip(F.col("diff") + towards, -limit, limit).cast("int"),
        "outs_out": F.least(F.col("outs_before") + 1, F.lit(2))})
    look = expectancy.select(*[F.col(c).alias(f"_{c}") for c in STATE], F.col("we").alias("_we"))

    def lookup(df, outs, diff, name):
        on = ((F.col("late") == F.col("_late")) & (F.col("is_top") == F.col("_is_top"))
              & (F.col(outs) == F.col("_outs_before")) & (F.col(diff) == F.col("_diff")))
        return df.join(F.broadcast(look), on, "left").withColumn(
            name, F.coalesce(F.col("_we"), F.col("overall"))).drop(*look.columns)

    here = lookup(here, "outs_before", "diff_run", "we_run")
    here = lookup(here, "outs_out", "diff", "we_out")
    swing = here.withColumn("swing", F.abs(F.col("we_run") - F.col("we"))
                            + F.abs(F.col("we_out") - F.col("we")))
    average = swing.agg((F.sum(F.col("swing") * F.col("n")) / F.sum("n")).alias("a")).scalar()
    swing = swing.withColumn("average", average)
    return swing.select(*STATE, "n", "we", (F.col("swing") / F.when(
        F.col("average") == 0, 1.0).otherwise(F.col("average"))).alias("leverage"))


def workload(staged: DataFrame, table: DataFrame) -> DataFrame:
    """Batters faced and leverage carried per (game, date, pitcher)."""
    rated = staged.join(F.broadcast(table.select(*STATE, "leverage")), STATE)
    return rated.groupBy("game_pk", "official_date", "pitcher_id").agg(
        F.count(F.lit(1)).alias("batters"),
        F.round(F.sum("leverage"), 4).alias("leverage_sum"),
        F.count_if(F.col("leverage") >= C.HIGH_LEVERAGE).alias("high_leverage_batters"))


def bullpen_leverage(plays: DataFrame, games: DataFrame) -> DataFrame:
    staged = with_state(plays, games)
    return workload(staged, leverage_table(win_expectancy(staged)))
