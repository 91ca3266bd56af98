"""Everything known about a game the moment before it starts.

Each state is a running total over its own key (side, starter, staff, plate
umpire, venue, league) strictly before (date, game). Games are narrowed to the
few columns a state needs before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators.dedup import keep_first
from fungo.operators.elo import elo_ratings
from fungo.operators.prefix import day_order, last_n_before, running
from fungo.session import bucketed, erase, joined_parts, passing, written

c = F.col
ORDER = day_order("official_date", "game_pk")
PROBE_ORDER = day_order("official_date", "game_pk", "kind")


def _id(df: DataFrame, name: str) -> Column:
    """An id as text; what is a whole number already needs no cleaning."""
    whole = dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint")
    return c(name).cast("string") if whole else S.id_key(c(name))


def _narrow(games: DataFrame) -> DataFrame:
    played = c("home_score").isNotNull() & c("away_score").isNotNull()
    return games.select(
        "game_pk", "official_date", c("season").cast("int").alias("season"),
        *[_id(games, k).alias(k) for k in (
            "home_team_id", "away_team_id", "home_sp_id", "away_sp_id", "venue_id")],
        *[F.when(played, c(k)).cast("double").alias(k) for k in ("home_score", "away_score")],
        played.alias("played"))


def _sides(games: DataFrame) -> DataFrame:
    def side(us, them):
        return F.struct(F.lit(us).alias("side"), c(f"{us}_team_id").alias("team"),
                        c(f"{us}_sp_id").alias("starter"), c(f"{us}_score").alias("scored"),
                        c(f"{them}_score").alias("allowed"), c(f"{us}_relief_outs").alias("relief_outs"),
                        c(f"{us}_relief_runs").alias("relief_runs"))
    return games.select("game_pk", "official_date", "season", "played", F.explode(
        F.array(side("home", "away"), side("away", "home"))).alias("s")).select(
        "game_pk", "official_date", "season", "played", "s.*")


def team_state(sides: DataFrame) -> DataFrame:
    done = c("played")
    rows = running(sides, ["team", "season"], ORDER, sums={
        "games": done.cast("int"), "runs_for": c("scored"), "runs_against": c("allowed")})
    rows = last_n_before(rows, ["team", "season"], "games", C.FORM_GAMES,
                         {"recent_for": c("scored"), "recent_against": c("allowed")})
    return rows.select("game_pk", "side", "games", "runs_for", "runs_against",
                       c("recent_for").alias("recent_off"), c("recent_against").alias("recent_def"))


def staff_state(sides: DataFrame) -> DataFrame:
    """Days of rest, relief record and relief outs of the last three days."""
    rows = running(
        sides, ["team"], ORDER,
        sums={"bp_runs": F.when(c("played"), c("relief_runs")), "bp_outs": F.when(c("played"), c("relief_outs"))},
        lasts={"last_played": F.when(c("played"), c("official_date"))},
        trailing={"workload": (F.when(c("played"), c("relief_outs")), C.WORKLOAD_DAYS)})
    return rows.select("game_pk", "side", "bp_runs", "bp_outs", c("workload").cast("double").alias("bp_workload"),
                       S.rest_days(c("last_played"), c("official_date"), 10).alias("rest"))


def starter_proxy(sides: DataFrame) -> DataFrame:
    """Runs allowed in the games a starter was announced for."""
    known = sides.where(c("starter").isNotNull())
    rows = running(known, ["starter"], ORDER,
                   sums={"starts": c("played").cast("int"), "sp_allowed": c("allowed")},
                   lasts={"last_start": F.when(c("played"), c("official_date"))})
    rows = last_n_before(rows, ["starter"], "starts", C.STARTER_FORM, {"sp_recent": c("allowed")})
    return rows.select(
        "game_pk", "side", c("starts").alias("sp_starts"), "sp_allowed", "sp_recent",
        S.rest_days(c("last_start"), c("official_date"), 15).alias("sp_rest"))


LINE_SUMS = ("batters", "ks", "walks", "homers", "outs")


def starter_lines(sides: DataFrame, lines: DataFrame) -> DataFrame:
    """The announced starter's own record. The lookup key is the announced
    starter, the record folded belongs to whoever threw, so the two are
    interleaved: kind 0 asks, kind 1 adds."""
    asks = sides.where(c("starter").isNotNull()).select(
        c("starter").alias("player"), "official_date", "game_pk", "side", F.lit(0).alias("kind"),
        *[F.lit(None).cast("double").alias(k) for k in LINE_SUMS])
    adds = (lines.where((c("is_starter") == 1) & c("player").isNotNull())
            .groupBy("player", "official_date", "game_pk")
            .agg(*[F.sum(k).alias(k) for k in LINE_SUMS], F.count(F.lit(1)).alias("n")))
    both = asks.withColumn("n", F.lit(None).cast("bigint")).unionByName(
        adds.withColumns({"side": F.lit(None).cast("string"), "kind": F.lit(1)}))
    rows = running(both, ["player"], PROBE_ORDER,
                   sums={**{f"sp_{k}": c(k) for k in LINE_SUMS}, "sp_lines": c("n")})
    return rows.where(c("kind") == 0).select(
        "game_pk", "side", *[f"sp_{k}" for k in LINE_SUMS], "sp_lines")


def pitching_lines(pitching: DataFrame, games: DataFrame) -> DataFrame:
    """Lines of finished games, numeric, one per (game, player), and whose staff it is."""
    rows = pitching.select(
        "game_pk", _id(pitching, "team_id").alias("team"), _id(pitching, "player_id").alias("player"),
        F.coalesce(c("is_starter").try_cast("int"), F.lit(0)).alias("is_starter"),
        S.number_or_zero(c("batters_faced")).alias("batters"), S.number_or_zero(c("strike_outs")).alias("ks"),
        (S.number_or_zero(c("walks")) + S.number_or_zero(c("hit_batsmen"))).alias("walks"),
        S.number_or_zero(c("home_runs")).alias("homers"), S.number_or_zero(c("outs")).alias("outs"),
        S.number_or_zero(c("runs")).alias("runs"))
    sides = {f"for_{side}": c("team") == c(f"{side}_team_id") for side in ("home", "away")}
    return rows.join(games.where(c("played")).select("game_pk", "official_date", "home_team_id", "away_team_id"),
                     "game_pk").withColumns(sides).drop("team", "home_team_id", "away_team_id")


GAME_SUMS = ("g_batters", "g_ks", "g_walks", "g_homers", "g_relief_outs", "g_relief_runs",
             "home_relief_outs", "home_relief_runs", "away_relief_outs", "away_relief_runs")


def game_sums(lines: DataFrame) -> DataFrame:
    """What all pitchers of a game add up to, and each side's relief."""
    relief = c("is_starter") == 0
    return lines.groupBy("game_pk").agg(
        *[F.sum(k).alias(f"g_{k}") for k in ("batters", "ks", "walks", "homers")],
        *[F.sum(F.when(relief, c(k))).alias(f"g_relief_{k}") for k in ("outs", "runs")],
        *[F.sum(F.when(relief & c(f"for_{side}"), c(k))).alias(f"{side}_relief_{k}")
          for side in ("home", "away") for k in ("outs", "runs")])


def league_state(games: DataFrame) -> DataFrame:
    """Running league rates, with evidence floors. The key is empty; only the
    day totals meet in one place."""
    rows = running(games, [], ORDER, sums={
        "lg_runs": c("home_score") + c("away_score"), "lg_games": c("played").cast("int"),
        "lg_batters": c("g_batters"), "lg_ks": c("g_ks"), "lg_bb": c("g_walks"), "lg_hr": c("g_homers"),
        "lg_outs": c("g_relief_outs"), "lg_rruns": c("g_relief_runs"),
        "lg_kgames": c("g_batters").isNotNull().cast("int")})

    def rate(total, name):
        return F.when(c("lg_batters") > C.LEAGUE_BATTERS_FLOOR, c(total) / c("lg_batters")).otherwise(
            C.LEAGUE_RATES[name])

    return rows.select(
        "game_pk",
        F.when(c("lg_games") > 0, F.try_divide("lg_runs", "lg_games")).otherwise(
            C.PRIOR_RUNS * 2).alias("lg_mean"),
        rate("lg_ks", "k").alias("lg_k"), rate("lg_bb", "bb").alias("lg_bb_rate"),
        rate("lg_hr", "hr").alias("lg_hr_rate"),
        F.when(c("lg_kgames") >= C.LEAGUE_KS_FLOOR, F.try_divide("lg_ks", "lg_kgames")).otherwise(
            C.LEAGUE_KS_PER_GAME).alias("lg_kpg"),
        F.when(c("lg_outs") >= C.LEAGUE_RELIEF_FLOOR, F.try_divide("lg_rruns", "lg_outs") * 27.0).otherwise(
            C.LEAGUE_RELIEF).alias("lg_relief"))


def park_factor(runs: Column, games: Column, league_mean: Column) -> Column:
    raw = F.try_divide(runs, games) / league_mean
    weight = games / (games + C.PARK_REGRESSION_GAMES)
    return F.when((games >= C.PARK_FLOOR_GAMES) & (league_mean > 0), 1.0 + (raw - 1.0) * weight).otherwise(1.0)


def build_features(games: DataFrame, parks: DataFrame, weather: DataFrame | None = None,
                   pitching: DataFrame | None = None, umpires: DataFrame | None = None,
                   league: str | None = None, finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per game with the model's columns and the umpire environment.

    ``games`` must hold one row per game_pk. Absent inputs give priors, and so
    does a side without an id or a game without a date: it has no earlier
    state. Of several weather or umpire rows of a game the last one wins, by
    ``ordinal`` where the input has it. ``finish`` is what to make of each model
    column, done as soon as the column is known.
    """
    spark = games.sparkSession

    def by_game(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "game_pk")

    def state(of, *inputs) -> DataFrame:
        with passing(spark):
            rows = of(*inputs)
            if "side" not in rows.columns:
                rows = by_game(rows)
            else:
                # Written first, so that its shuffles are gone when it is dealt by game.
                fields = [f for f in rows.columns if f not in ("game_pk", "side")]
                rows = by_game(written(rows)).groupBy("game_pk").agg(*[
                    F.max(F.when(c("side") == s, c(f))).alias(f"{s}_{f}") for s in ("home", "away") for f in fields])
            return bucketed(rows, parts, "game_pk", stays=True)

    # Each state is written out by itself: the plans stay small, and a lost
    # executor costs one state rather than the whole frame. All have the same
    # buckets by game, so the frame joins them as they lie on disk. What a state
    # is computed from is deleted as soon as nothing reads it, and what moves
    # most comes while little is kept.
    with passing(spark):
        place = parks.select(_id(parks, "venue_id").alias("venue_id"), "elevation_m").dropDuplicates(["venue_id"])
        base = written(_narrow(games).join(place, "venue_id", "left"), stays=True)
        parts = joined_parts(spark, base.count())
        full = base.withColumns({k: F.lit(None).cast("double") for k in GAME_SUMS})
        lines, states = None, {}
        if pitching is not None:
            # Every state of pitchers reads these, so they are computed once.
            lines = bucketed(by_game(pitching_lines(pitching, base)), parts, "game_pk")
            full = written(by_game(base).join(game_sums(lines).hint("merge"), "game_pk", "left"))
        if weather is not None:
            states[weather_columns] = state(last_row, weather, tuple(SKY))
        states[elo_columns] = state(elo_ratings, games, league)
        states |= {league_columns: state(league_state, full), venue_columns: state(venue_state, full)}
        if umpires is not None:
            states[umpire_columns] = state(umpire_state, full, umpires)
        sides = written(_sides(full))
        if lines is not None:
            erase(full)
            states[line_columns] = state(starter_lines, sides, lines)
            erase(lines)
        states |= {starter_columns: state(starter_proxy, sides), team_columns: state(team_state, sides),
                   staff_columns: state(staff_state, sides)}

    # The first table of a chain of joins sets the number of their tasks.
    out = by_game(base.select("game_pk", "official_date", "season", "elevation_m"))
    finished: set[str] = set()
    for step in STEPS:
        if step in states:
            out = out.join(states[step].hint("merge"), "game_pk", "inner" if step is elo_columns else "left")
        out = step(out)
        if finish is not None:
            known = [k for k in MODEL_COLUMNS if k in out.columns and k not in finished]
            out = out.withColumns({k: finish(c(k)) for k in known})
            finished.update(known)
    return out.select("game_pk", "official_date", "season", *MODEL_COLUMNS)


def venue_state(games: DataFrame) -> DataFrame:
    known = games.where(c("venue_id").isNotNull()).select(
        "game_pk", "venue_id", "official_date", "played", (c("home_score") + c("away_score")).alias("both"))
    return running(known, ["venue_id"], ORDER, sums={
        "pk_runs": c("both"), "pk_games": c("played").cast("int")}).select("game_pk", "pk_runs", "pk_games")


def umpire_state(games: DataFrame, umpires: DataFrame) -> DataFrame:
    worked = last_row(umpires.withColumn("ump", _id(umpires, "hp_umpire_id")), ["ump"])
    worked = written(games.join(worked.where(c("ump").isNotNull()), "game_pk").select(
        "game_pk", "official_date", "played", "ump", "g_ks", (c("home_score") + c("away_score")).alias("both")))
    return running(worked, ["ump"], ORDER, sums={
        "um_runs": c("both"), "um_games": c("played").cast("int"),
        "um_ks": F.when(c("played"), c("g_ks")),
        "um_kgames": (c("played") & c("g_ks").isNotNull()).cast("int")}).select(
        "game_pk", "um_runs", "um_games", "um_ks", "um_kgames")


def last_row(df: DataFrame, columns) -> DataFrame:
    """The columns of the last row of each game: of the greatest ordinal, ties and
    tables without one by the greatest values."""
    values = F.struct(*columns)
    order = F.struct(c("ordinal"), values) if "ordinal" in df.columns else values
    return df.groupBy("game_pk").agg(F.max_by(values, order).alias("_last")).select("game_pk", "_last.*")


MODEL_COLUMNS = (*C.FEATURE_COLUMNS, "ump_run_rate", "ump_k_rate")


def or_(name: str, default) -> Column:
    return F.coalesce(c(name), F.lit(default))


# What the states mean before the first game, and the columns they give. A step comes
# right after the join that brings its state: one projection of all would be a
# method too large for the JVM to compile, and rows would be wider in every join.
def league_columns(f: DataFrame) -> DataFrame:
    return f.withColumns({
        "lg_mean": or_("lg_mean", C.PRIOR_RUNS * 2), "lg_k": or_("lg_k", C.LEAGUE_RATES["k"]),
        "lg_bb_rate": or_("lg_bb_rate", C.LEAGUE_RATES["bb"]), "lg_hr_rate": or_("lg_hr_rate", C.LEAGUE_RATES["hr"]),
        "lg_kpg": or_("lg_kpg", C.LEAGUE_KS_PER_GAME), "lg_relief": or_("lg_relief", C.LEAGUE_RELIEF),
        "elevation_km": or_("elevation_m", 0.0) / 1000.0}).drop("elevation_m")


def line_columns(f: DataFrame) -> DataFrame:
    f = _present(f, {f"{side}_sp_{k}": "bigint" if k == "lines" else "double"
                     for side in ("home", "away") for k in (*LINE_SUMS, "lines")})

    def rates(side):
        def rate(k, lg):
            return (or_(f"{side}_sp_{k}", 0.0) + c(lg) * C.PRIOR_BATTERS) / (
                or_(f"{side}_sp_batters", 0.0) + C.PRIOR_BATTERS)

        n = or_(f"{side}_sp_lines", 0)
        return {f"{side}_sp_k_rate": rate("ks", "lg_k"), f"{side}_sp_bb_rate": rate("walks", "lg_bb_rate"),
                f"{side}_sp_hr_rate": rate("homers", "lg_hr_rate"),
                f"{side}_sp_depth": F.when(n < 2, C.DEFAULT_DEPTH).otherwise(F.try_divide(c(f"{side}_sp_outs"), n))}

    return f.withColumns({**rates("home"), **rates("away")}).drop(
        "lg_k", "lg_bb_rate", "lg_hr_rate", *[f"{side}_sp_{k}" for side in ("home", "away") for k in (*LINE_SUMS, "lines")])


def staff_columns(f: DataFrame) -> DataFrame:
    f = f.withColumns({k: v for side in ("home", "away") for k, v in {
        f"{side}_bp_rate": (or_(f"{side}_bp_runs", 0.0) + c("lg_relief") * (C.PRIOR_RELIEF_OUTS / 27.0))
        / (or_(f"{side}_bp_outs", 0.0) + C.PRIOR_RELIEF_OUTS) * 27.0,
        f"{side}_bp_workload": or_(f"{side}_bp_workload", 0.0), f"{side}_rest": or_(f"{side}_rest", 10)}.items()})
    return f.withColumn("rest_diff", c("home_rest") - c("away_rest")).drop(
        "lg_relief", "home_bp_runs", "away_bp_runs", "home_bp_outs", "away_bp_outs")


def starter_columns(f: DataFrame) -> DataFrame:
    return f.withColumns({k: v for side in ("home", "away") for k, v in {
        f"{side}_sp_rate": S.shrunk(c(f"{side}_sp_allowed"), c(f"{side}_sp_starts"), C.PRIOR_RUNS, C.PRIOR_STARTS),
        f"{side}_sp_recent": or_(f"{side}_sp_recent", C.PRIOR_RUNS),
        f"{side}_sp_starts": or_(f"{side}_sp_starts", 0),
        f"{side}_sp_rest": or_(f"{side}_sp_rest", 5)}.items()}).drop("home_sp_allowed", "away_sp_allowed")


def venue_columns(f: DataFrame) -> DataFrame:
    factor = park_factor(or_("pk_runs", 0.0), or_("pk_games", 0), c("lg_mean"))
    return f.withColumns({"park_factor": factor, "_park": factor}).drop("pk_runs", "pk_games")


def team_columns(f: DataFrame) -> DataFrame:
    f = f.withColumns({k: v for side in ("home", "away") for k, v in {
        f"{side}_off": S.shrunk(c(f"{side}_runs_for"), c(f"{side}_games"), C.PRIOR_RUNS, C.PRIOR_TEAM_GAMES),
        f"{side}_def": S.shrunk(c(f"{side}_runs_against"), c(f"{side}_games"), C.PRIOR_RUNS, C.PRIOR_TEAM_GAMES),
        f"{side}_recent_off": or_(f"{side}_recent_off", C.PRIOR_RUNS),
        f"{side}_recent_def": or_(f"{side}_recent_def", C.PRIOR_RUNS),
        f"{side}_games_played": or_(f"{side}_games", 0)}.items()})
    return f.withColumns({
        "expected_home_runs_prior": c("home_off") * c("away_def") / C.PRIOR_RUNS * c("_park"),
        "expected_away_runs_prior": c("away_off") * c("home_def") / C.PRIOR_RUNS * c("_park")}).drop(
        "_park", *[f"{side}_{k}" for side in ("home", "away") for k in ("runs_for", "runs_against", "games")])


def umpire_columns(f: DataFrame) -> DataFrame:
    f = _present(f, dict.fromkeys(("um_runs", "um_games", "um_ks", "um_kgames"), "double"))
    return f.withColumns({
        "ump_run_rate": S.shrunk(c("um_runs"), c("um_games"), c("lg_mean"), C.PRIOR_UMPIRE_GAMES) - c("lg_mean"),
        "ump_k_rate": S.shrunk(c("um_ks"), c("um_kgames"), c("lg_kpg"), C.PRIOR_UMPIRE_GAMES) - c("lg_kpg")}).drop(
        "um_runs", "um_games", "um_ks", "um_kgames", "lg_mean", "lg_kpg")


SKY = {**dict.fromkeys(("temp_c", "pressure_hpa", "humidity_pct", "wind_out_to_center_ms", "wind_left_to_right_ms",
                        "precip_mm"), "double"), "roof_category": "string"}


def weather_columns(f: DataFrame) -> DataFrame:
    density = S.air_density_index(c("temp_c"), c("pressure_hpa"), c("humidity_pct"))
    return _present(f, SKY).withColumns({
        "temp_c": or_("temp_c", 20.0), "air_density_index": F.coalesce(density, F.lit(1.0)),
        **{k: or_(k, 0.0) for k in ("wind_out_to_center_ms", "wind_left_to_right_ms", "precip_mm")},
        "roof_retractable": F.coalesce(c("roof_category") == "retractable", F.lit(False)).cast("int"),
        "roof_dome": F.coalesce(c("roof_category") == "dome", F.lit(False)).cast("int")}).drop(
        "pressure_hpa", "humidity_pct", "roof_category")


def elo_columns(f: DataFrame) -> DataFrame:
    return f.withColumn("elo_diff", c("home_elo") - c("away_elo") + C.ELO_HOME_EDGE)


STEPS = (league_columns, line_columns, staff_columns, starter_columns, venue_columns, team_columns, umpire_columns,
         weather_columns, elo_columns)


def _present(f: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns of a state that was not given are null."""
    return f.withColumns({k: F.lit(None).cast(t) for k, t in types.items() if k not in f.columns})


def combined_weather(archive: DataFrame, forecast: DataFrame) -> DataFrame:
    """Archive readings win over forecasts for the same game."""
    both = archive.withColumn("_o", F.lit(0)).unionByName(forecast.withColumn("_o", F.lit(1)))
    return keep_first(both, ["game_pk"], "_o").drop("_o")
