"""Landed documents, built as nested rows out of the given tables, flattened by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.checks.base import query, table
from fungo.operators import quotes as Q
from fungo.sources import landing

c = F.col


def named(**fields):
    return F.struct(*[v.alias(k) for k, v in fields.items()])


@query("landed_schedule", """WITH i AS (SELECT l_orderkey, count(*) AS innings,
    arg_max(CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 5 END IS NOT NULL, (l_linenumber, l_partkey, l_suppkey)) AS batted FROM lineitem GROUP BY 1),
  g AS (SELECT *, o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AS done, CAST(floor(o_totalprice / 40000e0) AS BIGINT) AS hs, o_orderkey % 9 AS aws
        FROM orders LEFT JOIN i ON l_orderkey = o_orderkey)
SELECT o_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS official_date, year(o_orderdate) AS season, o_custkey AS home_team_id,
  o_orderkey % 30 AS away_team_id, CASE WHEN done THEN hs END AS home_score, CASE WHEN done THEN aws END AS away_score,
  CASE WHEN done THEN CAST(hs > aws AS INTEGER) END AS home_win, CASE WHEN done THEN hs + aws END AS total_runs, CASE WHEN done THEN hs - aws END AS run_diff,
  CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 9 END AS scheduled_innings, innings AS innings_played,
  CASE WHEN done AND innings > 0 THEN CAST(batted AS INTEGER) END AS home_batted_ninth FROM g""")
def landed_schedule(spark, d):
    """One page per order date; a game short of final, or without a score, keeps no result."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    inning = named(home=named(runs=F.when(c("l_returnflag") != "N", (c("l_suppkey") % 5).cast("int"))))
    innings = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), inning.alias("i")))), lambda x: x["i"]).alias("innings"))
    o = table(spark, d, "orders").join(innings, c("l_orderkey") == c("o_orderkey"), "left")
    none = F.lit(None).cast("string")

    def side(team, score):
        return named(team=named(id=team, name=none), score=score, probablePitcher=named(id=F.lit(None).cast("bigint"), fullName=none))
    seen = c("o_orderkey") % 7 != 0
    game = named(
        gamePk=c("o_orderkey"), officialDate=F.date_format("o_orderdate", "yyyy-MM-dd"), gameDate=none, season=F.year("o_orderdate").cast("string"),
        gameType=none, doubleHeader=none, gameNumber=F.lit(None).cast("int"), seriesGameNumber=F.lit(None).cast("int"), dayNight=none,
        scheduledInnings=F.when(c("o_orderkey") % 5 == 0, 7), status=named(abstractGameState=F.when(c("o_orderstatus") == "F", "Final").otherwise("Live")),
        teams=named(home=side(c("o_custkey"), F.when(seen, F.floor(c("o_totalprice") / 40000.0))), away=side(c("o_orderkey") % 30, c("o_orderkey") % 9)),
        venue=named(id=c("o_custkey"), name=none), weather=named(condition=none, temp=none, wind=none), linescore=named(innings=c("innings")))
    pages = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.array(named(games=F.collect_list(game))).alias("dates"))
    return landing.schedule_games(pages).select(
        "game_pk", "official_date", "season", "home_team_id", "away_team_id", "home_score", "away_score", "home_win", "total_runs", "run_diff",
        "scheduled_innings", "innings_played", "home_batted_ninth")


@query("landed_parks", """SELECT CAST(id AS VARCHAR) AS venue_id, lat AS latitude, elevation_m, roof_type FROM (
  SELECT c_custkey % 40 AS id, max((c_custkey, c_acctbal / 100e0, round(c_acctbal * 0.3048e0, 2),
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Dome' ELSE 'Open' END)) AS w, w[2] AS lat, w[3] AS elevation_m, w[4] AS roof_type
  FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1)""")
def landed_parks(spark, d):
    """Every customer is a season's record of one of forty venues; those without coordinates do not count."""
    known = c("c_mktsegment") != "MACHINERY"
    none = F.lit(None).cast("int")
    venue = named(
        id=c("c_custkey") % 40, name=F.lit("v"), location=named(
            defaultCoordinates=named(latitude=F.when(known, c("c_acctbal") / 100.0), longitude=F.lit(1.0)), elevation=c("c_acctbal"),
            azimuthAngle=F.lit(0.0)),
        fieldInfo=named(roofType=F.when(c("c_mktsegment") == "BUILDING", "Dome").otherwise("Open"), turfType=F.lit("g"), capacity=none,
                        leftLine=none, center=none, rightLine=none))
    pages = table(spark, d, "customer").select(c("c_custkey").alias("season"), F.array(venue).alias("venues"))
    return landing.venue_parks(pages).select("venue_id", "latitude", "elevation_m", "roof_type")


@query("landed_umpires", """SELECT l_orderkey AS game_pk, w[2] AS hp_umpire_id FROM (
  SELECT l_orderkey, min((l_linenumber, l_suppkey, l_partkey)) AS w FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey > 0 GROUP BY 1)""")
def landed_umpires(spark, d):
    """Lines as the officials of an order; the first one at the plate with an id counts."""
    official = named(officialType=F.when(c("l_returnflag") == "A", " Home Plate").otherwise("First Base"),
                     official=named(id=c("l_suppkey"), fullName=F.lit("u")))
    games = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("game_pk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", official.alias("o")))), lambda x: x["o"]).alias("officials"))
    return landing.boxscore_umpires(games.withColumn("official_date", F.lit(None).cast("date"))).select("game_pk", "hp_umpire_id")


@query("landed_quotes", """WITH o AS (SELECT l_orderkey AS event_id, l_suppkey AS book, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'totals' WHEN 1 THEN 'h2h' ELSE 'spreads' END AS market,
    CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE l_linenumber + 0.5e0 END AS point, 100e0 + l_quantity AS ph, -100e0 - l_partkey % 50 AS pa FROM lineitem)
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(book AS VARCHAR) AS book_key, market, point, ph AS price_home, pa AS price_away,
  round((100e0 / (ph + 100)) / (100e0 / (ph + 100) + -pa / (-pa + 100)), 8) AS devig FROM (
  SELECT event_id, book, market, point, arg_max(ph, (l_linenumber, l_partkey, ph)) AS ph, arg_max(pa, (l_linenumber, l_partkey, ph)) AS pa FROM o GROUP BY ALL)""")
def landed_quotes(spark, d):
    """Each line a market of a book with both sides quoted; the last price of a side wins."""
    third = c("l_linenumber") % 3
    market = F.when(third == 0, "totals").when(third == 1, "h2h").otherwise("spreads")
    point = F.when(third != 1, c("l_linenumber") + 0.5)
    home, away = F.when(third == 0, "Over").otherwise("H"), F.when(third == 0, "Under").otherwise("A")
    stamp = F.lit("2020-01-01T00:00:00Z")
    outcomes = F.array(named(name=home, price=c("l_quantity") + 100.0, point=point),
                       named(name=away, price=-100.0 - c("l_partkey") % 50, point=F.when(third == 2, -point).otherwise(point)))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", named(
        key=c("l_suppkey").cast("string"), title=F.lit(None).cast("string"), last_update=stamp,
        markets=F.array(named(key=market, outcomes=outcomes))).alias("b")).alias("x"))
    events = lines.groupBy(c("l_orderkey").cast("string").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("bookmakers")).select(
        "id", stamp.alias("commence_time"), F.lit("H").alias("home_team"), F.lit("A").alias("away_team"), F.lit("us").alias("region"),
        stamp.alias("fetched_at"), "bookmakers")
    return Q.paired_book_quotes(landing.odds_outcomes(events)).select(
        "event_id", "book_key", "market", "point", "price_home", "price_away", F.round("devig_prob_home", 8).alias("devig"))
