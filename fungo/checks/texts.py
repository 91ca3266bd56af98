"""Landed documents as text: written as JSON lines, some of them cut short, read back by the sources and flattened."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.checks.base import query, scratch, table
from fungo.checks.landed import named
from fungo.operators.dedup import finished, pending
from fungo.session import dealt
from fungo.sources import landing

c = F.col
#: Documents of these orders are cut in the middle.
TORN = 50


def landed(spark, kind, rows, key):
    """``rows`` as text, read again; what cannot be read must be in quarantine."""
    home = scratch(spark)
    fields = [f for f in rows.columns if f != key]
    text = F.to_json(F.struct(*fields))
    torn = F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))
    rows.select(F.when(c(key) % TORN == 0, torn).otherwise(text).alias("value")).write.text(f"{home}/{kind}")
    good = landing.read_landed(spark, kind, f"{home}/{kind}", f"{home}/quarantine", lines=True)
    landing.read_landed(spark, kind, f"{home}/{kind}", f"{home}/quarantine", lines=True)  # landed twice, kept once
    return good, spark.read.parquet(f"{home}/quarantine")


@query("landed_pitching", f"""WITH s AS (SELECT l_orderkey AS game_pk, l_linenumber % 2 AS team_id, l_suppkey AS player_id, l_linenumber, l_partkey, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS spot FROM lineitem WHERE l_orderkey % {TORN} <> 0),
  p AS (SELECT game_pk, team_id, player_id, arg_max((l_partkey % 10, l_quantity), spot) AS st FROM s GROUP BY ALL)
SELECT s.game_pk, s.team_id, s.player_id, CAST(s.spot = 1 AS INTEGER) AS is_starter, CAST(st[1] AS INTEGER) AS outs, CAST(st[2] AS INTEGER) AS strike_outs
FROM s JOIN p USING (game_pk, team_id, player_id)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CAST(count(DISTINCT l_orderkey) AS INTEGER) FROM lineitem WHERE l_orderkey % {TORN} = 0""")
def landed_pitching(spark, d):
    """Lines of odd and even number as the pitchers of two sides; the last row counts the documents in quarantine."""
    none = F.lit(None).cast("int")
    stats = named(pitching=named(outs=(c("l_partkey") % 10).cast("int"), battersFaced=none, strikeOuts=c("l_quantity").cast("int")))
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", (c("l_linenumber") % 2).alias("team"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"),
        c("l_suppkey").alias("player"), named(stats=stats).alias("line"))
    # One exchange by order serves the three groupings.
    lines = dealt(lines, table(spark, d, "lineitem").count(), "l_orderkey")
    last = lines.groupBy("l_orderkey", "team", "player").agg(
        F.max_by("line", "o").alias("line"), F.collect_list(F.struct("o", "player")).alias("seen"))
    sides = last.groupBy("l_orderkey", "team").agg(
        F.transform(F.array_sort(F.flatten(F.collect_list("seen"))), lambda x: x["player"]).alias("pitchers"),
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("ID"), c("player").cast("string")), "line"))).alias("players"))
    side = named(team=named(id=c("team")), pitchers=c("pitchers"), players=c("players"))
    games = sides.groupBy("l_orderkey").agg(*[
        F.max_by(side, F.when(c("team") == at, 1)).alias(name) for name, at in (("h", 1), ("a", 0))])
    docs = games.select(c("l_orderkey").alias("key"), c("l_orderkey").alias("game_pk"), F.lit("2025-04-11").alias("official_date"),
                        named(home=c("h"), away=c("a")).alias("teams"))
    good, bad = landed(spark, "boxscore", docs, "key")
    rows = landing.boxscore_pitching(good).select("game_pk", "team_id", "player_id", "is_starter", "outs", "strike_outs")
    kinds = dict(rows.dtypes)
    return rows.unionByName(bad.agg(F.count(F.lit(1)).cast("int").alias("strike_outs")).select(
        *[c(k) if k == "strike_outs" else F.lit(None).cast(kinds[k]).alias(k) for k in rows.columns]))


@query("landed_plays", f"""WITH p AS (SELECT l_orderkey AS game_pk, row_number() OVER w - 1 AS spot, (row_number() OVER w + 3) // 4 AS inning,
    CAST(row_number() OVER w % 4 IN (1, 2) AS INTEGER) AS is_top, l_partkey % 4 AS outs, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber * 2 END AS hs,
    CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber END AS aws, l_suppkey AS pitcher_id
  FROM lineitem WHERE l_orderkey % {TORN} <> 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
  q AS (SELECT *, coalesce(last_value(hs IGNORE NULLS) OVER w, 0) AS h, coalesce(last_value(aws IGNORE NULLS) OVER w, 0) AS a FROM p
        WHERE pitcher_id <> 0 WINDOW w AS (PARTITION BY game_pk ORDER BY spot))
SELECT game_pk, CAST(spot AS INTEGER) AS spot, CAST(inning AS INTEGER) AS inning, is_top,
  CAST(least(2, coalesce(last_value(nullif(outs, 0) IGNORE NULLS) OVER (PARTITION BY game_pk, inning, is_top ORDER BY spot
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS INTEGER) AS outs_before,
  CAST(coalesce(lag(h) OVER w, 0) AS INTEGER) AS home_score_before, CAST(coalesce(lag(a) OVER w, 0) AS INTEGER) AS away_score_before, pitcher_id
FROM q WINDOW w AS (PARTITION BY game_pk ORDER BY spot)""")
def landed_plays(spark, d):
    """Lines as plays, four to an inning; some have no score."""
    known = c("x.l_suppkey") % 3 > 0
    play = named(about=named(inning=F.floor((c("at") + 4) / 4).cast("int"), isTopInning=(c("at") % 4).isin(0, 1)),
                 result=named(homeScore=F.when(known, c("x.l_linenumber") * 2).cast("int"), awayScore=F.when(known, c("x.l_linenumber")).cast("int")),
                 count=named(outs=(c("x.l_partkey") % 4).cast("int")), matchup=named(pitcher=named(id=c("x.l_suppkey"))))
    n = table(spark, d, "lineitem").count()
    lines = dealt(table(spark, d, "lineitem"), n, "l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("xs"))
    plays = lines.select("l_orderkey", F.posexplode("xs").alias("at", "x")).select("l_orderkey", "at", play.alias("p"))
    docs = plays.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda y: y["p"]).alias("allPlays")).select(
        c("l_orderkey").alias("key"), c("l_orderkey").alias("game_pk"), F.lit("2025-04-11").alias("official_date"), "allPlays")
    good, _ = landed(spark, "playbyplay", docs, "key")
    return landing.play_states(good, n).drop("official_date").withColumnRenamed("at", "spot")


@query("landed_hourly", f"""WITH h AS (SELECT o_custkey AS venue, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_totalprice
  FROM orders WHERE o_custkey % {TORN} <> 0), n AS (SELECT venue, count(*) AS n FROM h GROUP BY 1)
SELECT CAST(venue AS VARCHAR) AS venue_id, TIMESTAMP '2025-04-01 00:00:00' + CAST(i AS INTEGER) * INTERVAL 1 HOUR AS hour, o_totalprice / 1000e0 AS temperature_2m,
  CASE WHEN i + 1 < n THEN o_totalprice / 500e0 END AS precipitation FROM h JOIN n USING (venue)""")
def landed_hourly(spark, d):
    """A venue's orders as its hours; the array of precipitation is one short."""
    days = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    start = F.unix_timestamp(F.lit("2025-04-01 00:00:00").cast("timestamp"))
    times = F.transform("x", lambda _, i: F.date_format(F.timestamp_seconds(start + i * 3600), "yyyy-MM-dd'T'HH:mm"))
    short = F.slice("x", F.lit(1), F.size("x") - 1)
    docs = days.select(c("o_custkey").alias("key"), c("o_custkey").cast("string").alias("venue_id"), named(
        time=times, temperature_2m=F.transform("x", lambda r: r["o_totalprice"] / 1000.0),
        precipitation=F.transform(short, lambda r: r["o_totalprice"] / 500.0)).alias("hourly"))
    good, _ = landed(spark, "hourly", docs, "key")
    return landing.hourly_rows(good).select("venue_id", "hour", "temperature_2m", "precipitation")


@query("landed_history", f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_custkey, o_totalprice FROM orders),
  days AS (SELECT day, count(*) AS events, min(o_orderkey) AS first FROM o GROUP BY 1)
SELECT days.day AS requested_date, days.day + INTERVAL 22 HOUR AS snapshot_timestamp, CAST(events AS BIGINT) AS events,
  (SELECT count(*) FROM o WHERE o.day = days.day AND o_custkey % 4 <> 0) AS quotes, CAST(first % 90 AS INTEGER) AS credits_used
FROM days WHERE first % {TORN} <> 0""")
def landed_history(spark, d):
    """A day's orders as the events of one snapshot; a quarter of them have one side only. The manifest of the days that can be read."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T22:00:00Z"))
    home = named(name=F.lit("H"), price=F.lit(-110.0), point=F.lit(None).cast("double"))
    away = named(name=F.lit("A"), price=100.0 + F.floor(c("o_totalprice") / 5000.0), point=F.lit(None).cast("double"))
    both = F.when(c("o_custkey") % 4 != 0, F.array(home, away)).otherwise(F.array(home))
    event = named(id=c("o_orderkey").cast("string"), commence_time=F.lit("2035-01-01T00:00:00Z"), home_team=F.lit("H"), away_team=F.lit("A"),
                  bookmakers=F.array(named(key=F.lit("b"), title=F.lit("B"), last_update=stamp, markets=F.array(named(key=F.lit("h2h"), outcomes=both)))))
    days = table(spark, d, "orders").select("o_orderkey", "o_orderdate", stamp.alias("stamp"), event.alias("e")).groupBy("stamp").agg(
        F.min("o_orderkey").alias("key"), F.sort_array(F.collect_list("e")).alias("data"))
    docs = days.select("key", F.substring("stamp", 1, 10).alias("requested_date"), c("stamp").alias("timestamp"), F.lit("us").alias("region"),
                       (c("key") % 90).cast("int").alias("credits_used"), c("stamp").alias("fetched_at"), "data")
    good, _ = landed(spark, "odds_history", docs, "key")
    return landing.history_manifest(good, landing.history_quotes(good)).select(
        "requested_date", "snapshot_timestamp", "events", "quotes", "credits_used")


@query("finished_pending", """SELECT o_orderkey AS game_pk, year(o_orderdate) AS season FROM orders
WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def finished_pending(spark, d):
    """Games stored by season; finished ones of the wanted seasons that have no line yet."""
    home = scratch(spark)
    orders = table(spark, d, "orders")
    orders.select(c("o_orderkey").alias("game_pk"), F.when(c("o_orderstatus") == "F", "Final").otherwise("Live").alias("status"),
                  F.year("o_orderdate").alias("season")).write.partitionBy("season").parquet(f"{home}/games")
    wanted = orders.where((c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 450000)).select(F.year("o_orderdate").alias("season"))
    done = table(spark, d, "lineitem").where(c("l_returnflag") == "R").select(c("l_orderkey").alias("game_pk"))
    return pending(finished(spark.read.parquet(f"{home}/games"), wanted), done, ["game_pk"]).select("game_pk", "season")
