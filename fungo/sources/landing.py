"""Landed JSON documents to typed tables. One scan, explodes and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators.leverage import state_before
from fungo.operators.quotes import paired_book_quotes
from fungo.schemas import LANDED
from fungo.session import dealt
from fungo.sources.tables import exists

c = F.col


def landed_documents(spark: SparkSession, kind: str, path: str, lines: bool = False) -> DataFrame:
    """The fields of each document, its file, and ``broken``: the text of a
    document that is no JSON of its kind, else null. A file is one document, or
    with ``lines`` each line is one, so that a large file is read by many tasks."""
    text = spark.read.text(path, wholetext=not lines).select("value", c("_metadata.file_path").alias("source_file"))
    schema = StructType.fromDDL(LANDED[kind]).add("_broken", "string")
    read = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # A row of a generator: filters on the fields stay above it, where as a plain
    # column the document would be parsed again in each of them.
    rows = text.where(F.trim("value") != "").select("*", F.explode(F.array(read)).alias("d"))
    broken = F.when(c("d").isNull() | c("d._broken").isNotNull(), c("value"))
    return rows.select(*[c(f"d.{f.name}") for f in schema.fields[:-1]], "source_file", broken.alias("broken"))


def read_landed(spark: SparkSession, kind: str, path: str, quarantine: str | None = None, lines: bool = False) -> DataFrame:
    """Documents that can be read; the others are added to ``quarantine``, once
    each, where they can be looked at and landed again."""
    rows = landed_documents(spark, kind, path, lines)
    if quarantine is not None:
        bad = rows.where(c("broken").isNotNull()).select(F.lit(kind).alias("kind"), "source_file", "broken")
        if exists(spark, quarantine):
            bad = bad.join(spark.read.parquet(quarantine), ["kind", "source_file", "broken"], "left_anti")
        bad.write.mode("append").parquet(quarantine)
    return rows.where(c("broken").isNull()).drop("source_file", "broken")


def schedule_games(landed: DataFrame) -> DataFrame:
    """Schedule pages to game rows; a game short of final keeps no result."""
    g = landed.select(F.explode("dates.games").alias("gs")).select(F.explode("gs").alias("g"))
    final = ((c("g.status.abstractGameState") == "Final") & c("g.teams.home.score").isNotNull()
             & c("g.teams.away.score").isNotNull())
    home, away = c("g.teams.home.score"), c("g.teams.away.score")
    innings = c("g.linescore.innings")
    last_home = F.try_element_at(innings, F.lit(-1))["home"]["runs"]
    played = F.size(innings) > 0

    def result(value: Column) -> Column:
        return F.when(final, value)

    return g.where(c("g.gamePk").isNotNull()).select(
        c("g.gamePk").alias("game_pk"),
        c("g.officialDate").try_cast("date").alias("official_date"),
        c("g.gameDate").try_cast("timestamp").alias("game_date_utc"),
        c("g.season").try_cast("int").alias("season"), c("g.gameType").alias("game_type"),
        F.coalesce("g.doubleHeader", F.lit("N")).alias("double_header"),
        F.coalesce("g.gameNumber", F.lit(1)).alias("game_number"),
        c("g.seriesGameNumber").alias("series_game_number"), c("g.dayNight").alias("day_night"),
        F.coalesce("g.scheduledInnings", F.lit(9)).alias("scheduled_innings"),
        c("g.status.abstractGameState").alias("status"),
        c("g.teams.home.team.id").alias("home_team_id"), c("g.teams.home.team.name").alias("home_team_name"),
        c("g.teams.away.team.id").alias("away_team_id"), c("g.teams.away.team.name").alias("away_team_name"),
        result(home).alias("home_score"), result(away).alias("away_score"),
        result((home > away).cast("int")).alias("home_win"),
        result(home + away).alias("total_runs"), result(home - away).alias("run_diff"),
        c("g.teams.home.probablePitcher.id").alias("home_sp_id"),
        c("g.teams.home.probablePitcher.fullName").alias("home_sp_name"),
        c("g.teams.away.probablePitcher.id").alias("away_sp_id"),
        c("g.teams.away.probablePitcher.fullName").alias("away_sp_name"),
        c("g.venue.id").alias("venue_id"), c("g.venue.name").alias("venue_name"),
        c("g.weather.condition").alias("reported_condition"), c("g.weather.temp").alias("reported_temp_f"),
        c("g.weather.wind").alias("reported_wind"),
        F.when(played, F.size(innings)).alias("innings_played"),
        result(F.when(played, last_home.isNotNull().cast("int"))).alias("home_batted_ninth"))


def boxscore_pitching(landed: DataFrame) -> DataFrame:
    """One row per pitcher with a line; the first to appear is the starter."""
    sides = landed.select("game_pk", "official_date",
                          F.explode(F.array("teams.home", "teams.away")).alias("t"))
    # The line is looked up beside the list, so that no row carries all players.
    thrown = F.transform("t.pitchers", lambda p: F.struct(p.alias("player_id"), F.try_element_at(
        c("t.players"), F.concat(F.lit("ID"), p.cast("string")))["stats"]["pitching"].alias("s")))
    seen = sides.select("game_pk", "official_date", c("t.team.id").alias("team_id"),
                        F.posexplode(thrown).alias("at", "p")).select("*", "p.player_id", "p.s").drop("p")
    # An empty pitching object and an absent one both mean no appearance.
    fields = ("outs", "battersFaced", "hits", "runs", "earnedRuns", "homeRuns", "baseOnBalls",
              "hitByPitch", "strikeOuts", "numberOfPitches", "strikes")
    return seen.where(F.coalesce(*[c(f"s.{f}") for f in fields]).isNotNull()).select(
        "game_pk", "official_date", "team_id", "player_id", (c("at") == 0).cast("int").alias("is_starter"),
        c("s.outs").alias("outs"), c("s.battersFaced").alias("batters_faced"), c("s.hits").alias("hits"),
        c("s.runs").alias("runs"), c("s.earnedRuns").alias("earned_runs"),
        c("s.homeRuns").alias("home_runs"), c("s.baseOnBalls").alias("walks"),
        c("s.hitByPitch").alias("hit_batsmen"), c("s.strikeOuts").alias("strike_outs"),
        c("s.numberOfPitches").alias("pitches"), c("s.strikes").alias("strikes"))


def boxscore_umpires(landed: DataFrame) -> DataFrame:
    plate = F.filter("officials", lambda o: (F.lower(F.trim(o["officialType"])) == "home plate")
                     & (F.coalesce(o["official"]["id"], F.lit(0)) != 0))
    first = F.try_element_at(plate, F.lit(1))["official"]
    return landed.withColumn("u", first).where(c("u").isNotNull()).select(
        "game_pk", "official_date", c("u.id").alias("hp_umpire_id"), c("u.fullName").alias("hp_umpire_name"))


def play_states(landed: DataFrame, plays: int = 0) -> DataFrame:
    """State before each usable plate appearance. ``plays`` is about how many there
    are, if that is known, and sets the number of tasks."""
    p = landed.select("game_pk", "official_date", F.posexplode("allPlays").alias("at", "p"))
    usable = c("p.about.inning").isNotNull() & (F.coalesce(c("p.matchup.pitcher.id"), F.lit(0)) != 0)
    p = p.where(usable).select(
        "game_pk", "official_date", "at", c("p.about.inning").alias("inning"),
        F.coalesce(c("p.about.isTopInning"), F.lit(False)).cast("int").alias("is_top"),
        F.coalesce(c("p.count.outs"), F.lit(0)).alias("outs"),
        c("p.result.homeScore").alias("hs"), c("p.result.awayScore").alias("as"),
        c("p.matchup.pitcher.id").alias("pitcher_id"))
    # A play without a score repeats the last one known; one document holds a
    # whole game, so this window is bounded by the document.
    p = dealt(p, plays, "game_pk")
    upto = W.partitionBy("game_pk").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumns({k: F.coalesce(F.last(k, ignorenulls=True).over(upto), F.lit(0))
                       for k in ("hs", "as")})
    out = state_before(p, ["game_pk"], "at", ["inning", "is_top"], "outs",
                       {"home_score_before": "hs", "away_score_before": "as"}, bounded=True)
    return out.select("game_pk", "official_date", "at", "inning", "is_top", "outs_before",
                      "home_score_before", "away_score_before", "pitcher_id")


def venue_parks(landed: DataFrame) -> DataFrame:
    """Venues with coordinates; a later season's record replaces an earlier one."""
    v = landed.select("season", F.explode("venues").alias("v"))
    at = c("v.location.defaultCoordinates")
    rows = v.where(at["latitude"].isNotNull() & at["longitude"].isNotNull()).select(
        "season", S.id_key(c("v.id")).alias("venue_id"), c("v.name").alias("name"),
        at["latitude"].alias("latitude"), at["longitude"].alias("longitude"),
        S.feet_to_metres(c("v.location.elevation")).alias("elevation_m"),
        c("v.location.azimuthAngle").alias("azimuth_angle"), c("v.fieldInfo.roofType").alias("roof_type"),
        c("v.fieldInfo.turfType").alias("turf_type"), c("v.fieldInfo.capacity").alias("capacity"),
        c("v.fieldInfo.leftLine").alias("left_line"), c("v.fieldInfo.center").alias("center"),
        c("v.fieldInfo.rightLine").alias("right_line"))
    kept = [f for f in rows.columns if f != "season"]
    return rows.groupBy(c("venue_id").alias("_k")).agg(
        F.max_by(F.struct(*kept), "season").alias("r")).select("r.*")


def hourly_rows(landed: DataFrame) -> DataFrame:
    """Parallel hourly arrays to rows; a short or absent array gives nulls."""
    names = ("temperature_2m", "relative_humidity_2m", "surface_pressure",
             "wind_speed_10m", "wind_direction_10m", "precipitation")
    at = F.posexplode("hourly.time").alias("i", "stamp")
    rows = landed.select("venue_id", "hourly", at)
    return rows.select("venue_id", c("stamp").try_cast("timestamp").alias("hour"),
                       *[F.get(c(f"hourly.{n}"), c("i")).alias(n) for n in names])


def game_weather(games: DataFrame, hourly: DataFrame, parks: DataFrame, archive: bool = True) -> DataFrame:
    """First-pitch weather on the park's axes. Games whose hour is missing stay
    with null readings, so they can be counted before they are dropped."""
    g = games.select("game_pk", S.id_key(c("venue_id")).alias("venue_id"),
                     S.utc_hour(c("game_date_utc")).alias("hour"))
    park = parks.select("venue_id", "azimuth_angle", "roof_type")
    rows = g.join(park, "venue_id").join(
        hourly.withColumn("found", F.lit(1)), ["venue_id", "hour"], "left")
    out, across = S.wind_components(c("wind_speed_10m"), c("wind_direction_10m"), c("azimuth_angle"))
    category = S.roof_category(c("roof_type"))

    def wind(value):
        return F.when(category == "dome", 0.0).otherwise(F.round(value, 3))

    return rows.select(
        "game_pk", F.lit("open-meteo-archive" if archive else "open-meteo-forecast").alias("weather_source"),
        c("hour").alias("weather_hour_utc"), c("temperature_2m").alias("temp_c"),
        c("relative_humidity_2m").alias("humidity_pct"), c("surface_pressure").alias("pressure_hpa"),
        c("wind_speed_10m").alias("wind_speed_ms"), c("wind_direction_10m").alias("wind_direction_deg"),
        c("precipitation").alias("precip_mm"), wind(out).alias("wind_out_to_center_ms"),
        wind(across).alias("wind_left_to_right_ms"), category.alias("roof_category"), "found")


def service_window(today: Column, archive: bool) -> tuple[Column | None, Column]:
    """Dates the service answers for; an open end is None."""
    if archive:
        return None, F.date_sub(today, C.ARCHIVE_LAG_DAYS)
    return F.date_sub(today, 1), F.date_add(today, C.FORECAST_HORIZON_DAYS)


def servable(games: DataFrame, today: Column, archive: bool) -> Column:
    low, high = service_window(today, archive)
    inside = c("official_date") <= high
    if low is not None:
        inside = inside & (c("official_date") >= low)
    return F.coalesce(inside, F.lit(False))


def weather_for_games(games: DataFrame, hourly: DataFrame, parks: DataFrame, today: Column,
                      archive: bool = True, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(weather rows, one row of counts) for games not done yet.

    A forecast is never resumed: with ``archive`` false, ``done`` is ignored and
    the caller replaces the whole forecast table.
    """
    known = parks.select("venue_id", F.lit(1).alias("_known"))
    g = games.withColumn("_venue", S.id_key(c("venue_id"))).join(
        known.withColumnRenamed("venue_id", "_venue"), "_venue", "left")
    if archive and done is not None:
        g = g.join(done.select("game_pk").distinct(), "game_pk", "left_anti")
    inside = servable(g, today, archive)
    rows = game_weather(g.where(c("_known").isNotNull() & inside), hourly, parks, archive)
    counts = g.agg(F.count_if(c("_known").isNull()).alias("unknown_park"),
                   F.count_if(c("_known").isNotNull() & ~inside).alias("outside_window"))
    missing = rows.agg(F.count_if(c("found").isNull()).alias("v")).scalar()
    return rows.where(c("found").isNotNull()).drop("found"), counts.withColumn("missing_hour", missing)


def odds_outcomes(landed: DataFrame) -> DataFrame:
    """Nested odds to one row per quoted outcome, in document order."""
    b = landed.select(c("id").alias("event_id"), "commence_time", "home_team", "away_team", "region",
                      "fetched_at", F.posexplode("bookmakers").alias("bi", "b"))
    m = b.select("*", F.posexplode("b.markets").alias("mi", "m"))
    o = m.select("*", F.posexplode("m.outcomes").alias("oi", "o"))
    return o.select(
        "event_id", "commence_time", "home_team", "away_team", "region", "fetched_at",
        c("b.key").alias("book_key"), F.coalesce("b.title", "b.key").alias("book_title"),
        c("b.last_update").alias("book_updated_at"), c("m.key").alias("market"),
        c("o.name").alias("name"), c("o.price").alias("price"), c("o.point").alias("point"),
        ((c("bi").cast("bigint") * 1000 + c("mi")) * 1000 + c("oi")).alias("ordinal"))


def history_outcomes(landed: DataFrame) -> DataFrame:
    events = landed.select("requested_date", c("timestamp").alias("fetched_at"), "region",
                           F.explode("data").alias("e")).select("fetched_at", "region", "e.*")
    return odds_outcomes(events)


def history_quotes(landed: DataFrame) -> DataFrame:
    quotes = paired_book_quotes(history_outcomes(landed))
    ident = F.concat_ws("|", c("fetched_at"), c("event_id"), c("book_key"), c("market"),
                        F.coalesce(c("point").cast("string"), F.lit("None")))
    return quotes.withColumn("snapshot_id", ident).withColumn("date", F.to_date("commence_time"))


def history_manifest(landed: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per requested day: events seen, quotes paired, credits spent."""
    n = quotes.groupBy("fetched_at").agg(F.count(F.lit(1)).alias("quotes"))
    base = landed.select(
        "requested_date", c("timestamp").alias("stamp"), "previous_timestamp",
        F.coalesce(F.size("data"), F.lit(0)).cast("bigint").alias("events"), "credits_used",
        "credits_remaining", c("fetched_at").alias("done_at"))
    return base.join(n, base["stamp"] == n["fetched_at"], "left").select(
        "requested_date", c("stamp").try_cast("timestamp").alias("snapshot_timestamp"),
        c("previous_timestamp").try_cast("timestamp").alias("previous_timestamp"), "events",
        F.coalesce("quotes", F.lit(0)).alias("quotes"), "credits_used", "credits_remaining",
        c("done_at").try_cast("timestamp").alias("fetched_at"))
