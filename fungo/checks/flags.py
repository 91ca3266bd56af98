"""Screens, flags and reports that read a row at a time, and small reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo import config as C
from fungo.checks.base import query, scratch, table
from fungo.checks.ledger import CARD, NOW, SETTLED, screened, settled
from fungo.functions import scalars as S
from fungo.operators import ledger as L
from fungo.operators import pricing
from fungo.plans import comparison, features, serving
from fungo.sources import landing, tables
from fungo.streaming import quotes as stream

c = F.col
SEEN = "2020-01-15 12:00:00"


@query("event_flags", f"""SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)
    > TIMESTAMP '{SEEN}', false) AS ahead, CAST(floor(epoch(date_trunc('second', ts) - TIMESTAMP '{SEEN}') / 60) AS INTEGER) AS lead,
  CAST(event_type IN ('click', 'view') AS INTEGER) AS closed FROM events""")
def event_flags(spark, d):
    """Start still ahead, minutes to it, and whether the roof was seen closed."""
    seen = F.lit(SEEN).cast("timestamp")
    at = F.date_trunc("second", c("ts"))
    said = F.when(c("event_id") % 11 == 0, "soon").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    roof = F.when(c("event_type") == "click", " Roof Closed ").when(c("event_type") == "view", "DOME").otherwise("clear")
    return table(spark, d, "events").select(
        "event_id", S.is_future(said, seen).alias("ahead"), S.lead_minutes(at.cast("timestamp"), seen).alias("lead"), S.roof_seen_closed(roof).alias("closed"))


@query("stream_filters", f"""SELECT event_id FROM events WHERE event_id % 11 <> 0 AND date_trunc('second', ts) + to_days(CAST(event_id % 3 AS INTEGER) - 1) > ts
  AND epoch(TIMESTAMP '{SEEN}' - ts) <= 30 * 24 * 3600""")
def stream_filters(spark, d):
    """A stream of quotes without those taken in play or too long ago."""
    home = scratch(spark)
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", c("ts").cast("timestamp"))
    start = F.date_trunc("second", c("ts")) + F.make_dt_interval((c("event_id") % 3 - 1).cast("int"))
    rows = rows.withColumn("commence", F.when(c("event_id") % 11 != 0, start.cast("string")))
    live = stream.fresh(stream.not_started(rows, "commence", "ts"), "ts", F.lit(SEEN).cast("timestamp"), 30 * 24 * 60)
    (live.select("event_id").writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("event_id bigint").parquet(f"{home}/out")


@query("wide_market", f"""WITH {CARD} SELECT game_pk, CAST(c_acctbal / 1e5 > {C.WIDE_MARKET!r} AS INTEGER) AS wide_market FROM g4
  JOIN orders ON game_pk = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE final IS NULL""")
def wide_market(spark, d):
    return L.wagers(screened(spark, d), F.lit(NOW).cast("timestamp")).select("game_pk", "wide_market")


@query("settled_rows", f"""WITH {SETTLED} SELECT day AS date, CASE market WHEN 'h2h' THEN CASE side WHEN 'home' THEN 'Home ML' ELSE 'Away ML' END
    WHEN 'spreads' THEN CASE side WHEN 'home' THEN 'Home -1.5' ELSE 'Away +1.5' END ELSE CASE side WHEN 'home' THEN 'Over 8' ELSE 'Under 8' END END AS pick,
  CASE market WHEN 'h2h' THEN 'moneyline' WHEN 'spreads' THEN 'run line' ELSE 'total 8' END AS market, price, outcome, CAST(round(CAST(coalesce(profit, 0) AS DECIMAL(18, 4)), 3) AS DOUBLE) AS profit
FROM t WHERE outcome IS NOT NULL""")
def settled_rows(spark, d):
    return serving.settled_rows(settled(spark, d)).select("date", "pick", "market", "price", "outcome", "profit")


@query("umpire_residuals", """WITH k AS (SELECT l_orderkey, sum(l_partkey % 10) AS ks FROM lineitem GROUP BY 1)
SELECT o_orderkey AS game_pk, user_id % 40 AS hp_umpire_id, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 2) - o_totalprice / 1e6 END AS resid_win,
  CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 15 - (o_totalprice / 1e5 + 4e0) END AS resid_total, ks AS game_strikeouts
FROM orders JOIN events ON event_id = o_orderkey LEFT JOIN k ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'""")
def umpire_residuals(spark, d):
    """Orders as games, events as assignments, three of four games with a forecast."""
    o = table(spark, d, "orders")
    key = c("o_orderkey")
    games = o.select(key.alias("game_pk"), F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("official_date"), (key % 2).alias("home_win"),
                     (key % 15).alias("total_runs"), F.when(c("o_orderstatus") != "O", key % 9).alias("home_score"))
    umpires = table(spark, d, "events").select(c("event_id").alias("game_pk"), (c("user_id") % 40).alias("hp_umpire_id"), F.lit("u").alias("hp_umpire_name"))
    said = o.where(key % 4 > 0).select(key.alias("game_pk"), (c("o_totalprice") / 1e6).alias("prob"), (c("o_totalprice") / 1e5).alias("expected_home"),
                                       F.lit(4.0).alias("expected_away"))
    both = [said.withColumn("market", F.lit(m)) for m in ("h2h", "totals")]
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("game_pk"), (c("l_partkey") % 10).alias("strike_outs"))
    return comparison.umpire_frame(games, umpires, both[0].unionByName(both[1]), lines).select(
        "game_pk", "hp_umpire_id", "resid_win", "resid_total", "game_strikeouts")


@query("live_gate", """SELECT 'research_only' AS status, 'available' AS comparison, 'the model beats the closing price on ' || count(*) FILTER (acc < 0)
  || ' of ' || count(*) || ' markets with an interval excluding zero; that is necessary, not sufficient, and no wager is placed' AS reason
FROM (SELECT avg(c_acctbal) - 4500 AS acc FROM customer GROUP BY c_nationkey)""")
def live_gate(spark, d):
    report = table(spark, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") - 4500).alias("ci_high"))
    return comparison.live_gate(report)


@query("weather_sources", """WITH a AS (SELECT o_orderkey AS game_pk, o_totalprice AS t FROM orders WHERE o_orderkey % 3 = 0),
  f AS (SELECT o_orderkey AS game_pk, -o_totalprice AS t FROM orders WHERE o_orderkey % 2 = 0)
SELECT game_pk, coalesce(a.t, f.t) AS temp_c FROM a FULL JOIN f USING (game_pk)""")
def weather_sources(spark, d):
    """Archive readings before forecasts."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("game_pk"), c("o_totalprice").alias("temp_c"))
    return features.combined_weather(o.where(c("game_pk") % 3 == 0), o.where(c("game_pk") % 2 == 0).withColumn("temp_c", -c("temp_c")))


TODAY = "1996-06-15"


@query("forecast_window", f"""WITH g AS (SELECT o_orderkey AS game_pk, o_custkey % 40 AS venue, CAST(o_orderdate AS DATE) AS day FROM orders),
  p AS (SELECT DISTINCT c_custkey % 40 AS venue FROM customer WHERE c_custkey % 40 <> 7)
SELECT game_pk, 'open-meteo-forecast' AS weather_source, date_diff('day', DATE '{TODAY}', day) * 1e0 AS temp_c FROM g SEMI JOIN p USING (venue)
WHERE day BETWEEN DATE '{TODAY}' - 1 AND DATE '{TODAY}' + {C.FORECAST_HORIZON_DAYS} AND venue % 5 <> 0
UNION ALL SELECT NULL, 'counts', count(*) FILTER (venue = 7) * 1e6 + count(*) FILTER (venue <> 7 AND NOT day BETWEEN DATE '{TODAY}' - 1 AND DATE '{TODAY}' + {C.FORECAST_HORIZON_DAYS})
FROM g""")
def forecast_window(spark, d):
    """Games the forecast service answers for; venue 7 is not known, some venues have no hours. A last row holds two counts."""
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders")
    games = o.select(c("o_orderkey").alias("game_pk"), (c("o_custkey") % 40).alias("venue_id"), day.alias("official_date"),
                     (day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(18), F.lit(10))).alias("game_date_utc"))
    parks = table(spark, d, "customer").select((c("c_custkey") % 40).alias("v")).distinct().where("v <> 7").select(
        S.id_key(c("v")).alias("venue_id"), F.lit(0.0).alias("azimuth_angle"), F.lit("Open").alias("roof_type"))
    null = F.lit(None).cast("double")
    hourly = games.where(c("venue_id") % 5 != 0).select("venue_id", "official_date").distinct().select(
        S.id_key(c("venue_id")).alias("venue_id"), (c("official_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(18))).alias("hour"),
        F.datediff("official_date", F.lit(TODAY).cast("date")).cast("double").alias("temperature_2m"),
        *[null.alias(k) for k in ("relative_humidity_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m", "precipitation")])
    rows, counts = landing.weather_for_games(games, hourly, parks, F.lit(TODAY).cast("date"), archive=False)
    return rows.select("game_pk", "weather_source", "temp_c").unionByName(counts.select(
        F.lit(None).cast("bigint").alias("game_pk"), F.lit("counts").alias("weather_source"),
        (c("unknown_park") * 1e6 + c("outside_window")).alias("temp_c")))


@query("finish_shares", """WITH g AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS innings, o_custkey % 2 AS ninth, CAST(floor(o_totalprice / 40000e0) AS BIGINT) AS h, o_custkey % 7 AS a FROM orders),
  w AS (SELECT least(h - a, 4) AS bucket, count(*) AS n FROM g WHERE ninth = 1 AND h > a GROUP BY 1),
  x AS (SELECT least(abs(h - a), 4) AS bucket, count(*) AS n FROM g WHERE innings > 5 AND h <> a GROUP BY 1)
SELECT 'walk_off' AS kind, CAST(bucket AS INTEGER) AS bucket, round(n / sum(n) OVER (), 9) AS share FROM w
UNION ALL SELECT 'extra', CAST(bucket AS INTEGER), round(n / sum(n) OVER (), 9) FROM x
UNION ALL SELECT 'edge', 0, round(least(greatest(avg(CAST(h > a AS INTEGER)), 0.4), 0.6), 9) FROM g WHERE innings > 5""")
def finish_shares(spark, d):
    """Winning margins of games the home side ended, and of those past their length, with its edge there."""
    h, a = F.floor(c("o_totalprice") / 40000.0), c("o_custkey") % 7
    games = table(spark, d, "orders").select(
        h.alias("home_score"), a.alias("away_score"), (c("o_custkey") % 2).alias("home_batted_ninth"), (h > a).cast("int").alias("home_win"),
        (c("o_orderkey") % 9 + 1).alias("innings_played"), F.lit(5).alias("scheduled_innings"))
    walk = pricing.calibrate_walk_off(games)
    edge, extra = pricing.calibrate_extra_innings(games)
    rows = [("walk_off", i, float(v)) for i, v in enumerate(walk, 1)] + [("extra", i, float(v)) for i, v in enumerate(extra, 1)] + [("edge", 0, float(edge))]
    return spark.createDataFrame(rows, "kind string, bucket int, share double").withColumn("share", F.round("share", 9))


@query("kept_tables", """SELECT c_custkey AS id, 'credit' AS kind, CAST(c_custkey % 500 AS DOUBLE) AS value FROM customer
UNION ALL SELECT NULL, 'lowest', CAST(min(c_custkey % 500) AS DOUBLE) FROM customer UNION ALL SELECT n_nationkey, 'report', n_regionkey * 1e0 FROM nation""")
def kept_tables(spark, d):
    """Spend appended in two runs and read back, a report written twice, a table that is not there."""
    home = scratch(spark)
    spend = table(spark, d, "customer").select(
        F.timestamp_seconds(c("c_custkey")).alias("fetched_at"), F.lit("us").alias("region"), F.lit(1).alias("credits_used"),
        (c("c_custkey") % 500).cast("string").alias("credits_remaining"))
    low = [tables.record_credits(spend.where(half), f"{home}/credit_log") for half in (c("credits_remaining") < "3", c("credits_remaining") >= "3")]
    nations = table(spark, d, "nation").select(c("n_nationkey").alias("id"), c("n_regionkey").alias("value"))
    tables.write_report(nations.limit(1), f"{home}/report")
    tables.write_report(nations, f"{home}/report")
    log = tables.read_or_empty(spark, "credit_log", f"{home}/credit_log").select(
        F.unix_timestamp("fetched_at").alias("id"), F.lit("credit").alias("kind"), c("credits_remaining").cast("double").alias("value"))
    none = tables.read_or_empty(spark, "credit_log", f"{home}/none").select(F.unix_timestamp("fetched_at").alias("id"), F.lit("none").alias("kind"), F.lit(0.0).alias("value"))
    report = tables.read_report(spark, f"{home}/report", "id bigint, value double").select("id", F.lit("report").alias("kind"), "value")
    lowest = spark.range(1).select(F.lit(None).cast("bigint").alias("id"), F.lit("lowest").alias("kind"), F.lit(float(min(low))).alias("value"))
    return log.unionByName(none).unionByName(report).unionByName(lowest)
