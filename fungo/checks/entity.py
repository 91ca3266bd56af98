"""Point-in-time state, deduplication, logs and flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo import config as C
from fungo.checks.base import query, table
from fungo.functions import scalars as S
from fungo.operators import dedup, elo
from fungo.operators.prefix import day_order, last_n_before, position, running
from fungo.plans import features
from fungo.session import dealt
from fungo.sources import landing

c = F.col
ORDER = day_order("day", "id")

PLAYED = """o AS (SELECT o_orderkey AS id, o_custkey AS who, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS season,
    o_orderpriority <> '5-LOW' AS played, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
EARLIER = "(PARTITION BY {0} ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def played_orders(spark, d):
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), c("o_custkey").alias("who"), F.to_date("o_orderdate").alias("day"),
        F.year("o_orderdate").alias("season"), (c("o_orderpriority") != "5-LOW").alias("played"),
        F.round(c("o_totalprice") * 100).cast("bigint").alias("cents"))


@query("pit_entity_state", f"""WITH {PLAYED}, s AS (SELECT *, count(*) FILTER (played) OVER {EARLIER.format('who, season')} AS games,
    coalesce(sum(cents) FILTER (played) OVER {EARLIER.format('who, season')}, 0) AS total FROM o),
  r AS (SELECT who, season, row_number() OVER w AS at, avg(cents) OVER (w ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS m
        FROM o WHERE played WINDOW w AS (PARTITION BY who, season ORDER BY day, id))
SELECT id, s.games, round((CAST(total AS DOUBLE) + 4.5e0 * 40e0) / (s.games + 40e0), 3) AS shrunk, round(coalesce(m, 4.5e0), 3) AS recent
FROM s LEFT JOIN r ON r.who = s.who AND r.season = s.season AND r.at = s.games""")
def pit_entity_state(spark, d):
    rows = running(played_orders(spark, d), ["who", "season"], ORDER, sums={
        "games": c("played").cast("bigint"), "total": F.when(c("played"), c("cents"))})
    rows = last_n_before(rows, ["who", "season"], "games", C.FORM_GAMES, {"recent": F.when(c("played"), c("cents"))})
    return rows.select("id", "games", F.round(S.shrunk(c("total"), c("games"), C.PRIOR_RUNS, C.PRIOR_TEAM_GAMES), 3).alias("shrunk"),
                       F.round(F.coalesce("recent", F.lit(C.PRIOR_RUNS)), 3).alias("recent"))


@query("pit_rest_days", f"""WITH {PLAYED}, s AS (SELECT id, day, max(day) FILTER (played) OVER {EARLIER.format('who')} AS prev FROM o)
SELECT id, CAST(CASE WHEN prev IS NULL THEN 5 ELSE greatest(least(day - prev, 10), 0) END AS INTEGER) AS rest FROM s""")
def pit_rest_days(spark, d):
    rows = running(played_orders(spark, d), ["who"], ORDER, lasts={"prev": F.when(c("played"), c("day"))})
    return rows.select("id", S.rest_days(c("prev"), c("day"), 10).alias("rest"))


@query("pit_workload", """WITH e AS (SELECT event_id AS id, user_id AS who, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT a.id, CAST(coalesce(sum(b.cents), 0) AS BIGINT) AS workload FROM e a LEFT JOIN e b
  ON a.who = b.who AND b.day > a.day - 3 AND (b.day < a.day OR (b.day = a.day AND b.id < a.id)) GROUP BY a.id""")
def pit_workload(spark, d):
    e = table(spark, d, "events").select(
        c("event_id").alias("id"), c("user_id").alias("who"), F.to_date("ts").alias("day"),
        F.round(c("value") * 100).cast("bigint").alias("cents"))
    return running(e, ["who"], ORDER, trailing={"workload": (c("cents"), C.WORKLOAD_DAYS)}).select("id", "workload")


@query("pit_global_rate", f"""WITH {PLAYED}, s AS (SELECT id, count(*) FILTER (played) OVER w AS n, sum(cents) FILTER (played) OVER w AS t FROM o
  WINDOW w AS (ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, n, round(CASE WHEN n < 200 THEN 16e0 ELSE CAST(t AS DOUBLE) / n END, 3) AS rate FROM s""")
def pit_global_rate(spark, d):
    rows = running(played_orders(spark, d), [], ORDER, sums={
        "n": c("played").cast("bigint"), "t": F.when(c("played"), c("cents"))})
    return rows.select("id", "n", F.round(F.when(c("n") < C.LEAGUE_KS_FLOOR, C.LEAGUE_KS_PER_GAME).otherwise(
        F.try_divide(c("t").cast("double"), c("n"))), 3).alias("rate"))


@query("pit_park_factor", f"""WITH {PLAYED}, v AS (SELECT o.*, c_nationkey AS venue FROM o JOIN customer ON who = c_custkey),
  s AS (SELECT id, count(*) FILTER (played) OVER w AS lg, CAST(sum(cents) FILTER (played) OVER w AS DOUBLE) AS lt,
               count(*) FILTER (played) OVER p AS n, CAST(sum(cents) FILTER (played) OVER p AS DOUBLE) AS t FROM v
        WINDOW w AS (ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               p AS (PARTITION BY venue ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, round(CASE WHEN n >= 30 THEN 1e0 + ((t / n) / (lt / lg) - 1e0) * (n / (n + 120e0)) ELSE 1e0 END, 6) AS factor FROM s""")
def pit_park_factor(spark, d):
    people = table(spark, d, "customer").select(c("c_custkey").alias("who"), c("c_nationkey").alias("venue"))
    sums = {"n": c("played").cast("bigint"), "t": F.when(c("played"), c("cents"))}
    rows = running(played_orders(spark, d), [], ORDER, sums={"lg": sums["n"], "lt": sums["t"]}).join(people, "who")
    rows = running(rows, ["venue"], ORDER, sums=sums)
    mean = F.try_divide(c("lt").cast("double"), c("lg"))
    return rows.select("id", F.round(F.coalesce(features.park_factor(
        c("t").cast("double"), c("n"), mean), F.lit(1.0)), 6).alias("factor"))


@query("pit_actor_vs_scheduled", """WITH l AS (SELECT l_orderkey AS id, l_suppkey AS who, CAST(l_quantity AS BIGINT) AS q,
    l_extendedprice, l_linenumber FROM lineitem),
  d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders),
  ask AS (SELECT d.id, d.day, arg_min(who, (l_extendedprice, l_linenumber, who)) AS who FROM l JOIN d USING (id) GROUP BY d.id, d.day),
  fact AS (SELECT who, id, day, sum(q) AS q, count(*) AS n FROM l JOIN d USING (id) GROUP BY ALL),
  u AS (SELECT who, day, id, 0 AS kind, NULL AS q, NULL AS n FROM ask UNION ALL SELECT who, day, id, 1, q, n FROM fact),
  s AS (SELECT *, coalesce(sum(q) OVER w, 0) AS total, coalesce(sum(n) OVER w, 0) AS lines FROM u
        WINDOW w AS (PARTITION BY who ORDER BY day, id, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, who, CAST(lines AS BIGINT) AS lines, round((total + 0.225e0 * 200e0) / (lines + 200e0), 6) AS rate FROM s WHERE kind = 0""")
def pit_actor_vs_scheduled(spark, d):
    l = table(spark, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_suppkey").alias("who"),
                                           c("l_quantity").cast("bigint").alias("q"), "l_extendedprice", "l_linenumber")
    days = table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    n = l.count()
    l = dealt(l, n, "id").join(dealt(days, n, "id"), "id")
    asks = l.groupBy("id", "day").agg(F.min_by("who", F.struct("l_extendedprice", "l_linenumber", "who")).alias("who"))
    facts = l.groupBy("who", "id", "day").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("kind"))
    both = asks.withColumn("kind", F.lit(0)).unionByName(facts, allowMissingColumns=True)
    rows = running(both, ["who"], day_order("day", "id", "kind"), sums={"total": c("q"), "lines": c("n")})
    return rows.where(c("kind") == 0).select("id", "who", "lines", F.round(
        (c("total") + C.LEAGUE_RATES["k"] * C.PRIOR_BATTERS) / (c("lines") + C.PRIOR_BATTERS), 6).alias("rate"))


@query("elo_ratings", f"""WITH RECURSIVE l AS (SELECT l_orderkey, arg_min(l_suppkey, (l_extendedprice, l_linenumber, l_suppkey)) AS sup,
    CAST(sum(l_quantity) AS INTEGER) AS hs, CAST(trunc(sum(l_discount * 400)) AS INTEGER) AS aws FROM lineitem GROUP BY 1),
  g AS (SELECT o_orderkey AS game_pk, year(o_orderdate) AS season, o_custkey AS home, -sup - 1 AS away, hs, aws, s_nationkey AS league,
          row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rk
        FROM orders JOIN l ON l_orderkey = o_orderkey JOIN supplier ON sup = s_suppkey),
  r AS (SELECT DISTINCT league, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS game_pk, CAST(NULL AS DOUBLE) AS rh, CAST(NULL AS DOUBLE) AS ra,
          CAST(MAP([], []) AS MAP(BIGINT, STRUCT(r DOUBLE, s BIGINT))) AS m FROM g
        UNION ALL
        SELECT league, rk, game_pk, rh, ra, map_concat(m, MAP([home, away], [{{'r': rh + mv, 's': season}}, {{'r': ra - mv, 's': season}}])) FROM (
          SELECT *, {C.ELO_K!r} * ln(1 + abs(hs - aws)) * (CAST(hs > aws AS DOUBLE) - 1e0 / (1e0 + pow(10e0, -(rh - ra + {C.ELO_HOME_EDGE!r}) / 400e0))) AS mv FROM (
            SELECT g.*, m, CASE WHEN m[home] IS NULL THEN {C.ELO_START!r} WHEN m[home].s = season THEN m[home].r
                     ELSE {C.ELO_START!r} + (m[home].r - {C.ELO_START!r}) * {C.ELO_CARRY!r} END AS rh,
                   CASE WHEN m[away] IS NULL THEN {C.ELO_START!r} WHEN m[away].s = season THEN m[away].r
                     ELSE {C.ELO_START!r} + (m[away].r - {C.ELO_START!r}) * {C.ELO_CARRY!r} END AS ra
            FROM r JOIN g ON g.league = r.league AND g.rk = r.rk + 1)))
SELECT game_pk, round(rh, 6) AS home_elo, round(ra, 6) AS away_elo FROM r WHERE game_pk IS NOT NULL""")
def elo_ratings(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.min_by("l_suppkey", F.struct("l_extendedprice", "l_linenumber", "l_suppkey")).alias("l_suppkey"),
        F.sum("l_quantity").cast("int").alias("home_score"), F.sum(c("l_discount") * 400).cast("int").alias("away_score"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    games = (o.join(l, o.o_orderkey == l.l_orderkey).join(s, c("l_suppkey") == c("s_suppkey")).select(
        c("o_orderkey").alias("game_pk"), F.to_date("o_orderdate").alias("official_date"),
        F.year("o_orderdate").alias("season"), c("o_custkey").alias("home_team_id"),
        (-c("l_suppkey") - 1).alias("away_team_id"), "home_score", "away_score", c("s_nationkey").alias("league")))
    return elo.elo_ratings(games, "league").withColumns({k: F.round(k, 6) for k in ("home_elo", "away_elo")})


@query("holdout_split", f"""WITH {PLAYED}, r AS (SELECT id, row_number() OVER (ORDER BY day, id) AS spot, count(*) OVER () AS n FROM o)
SELECT spot > (n * 3 // 4) AS held, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY 1""")
def holdout_split(spark, d):
    rows = played_orders(spark, d)
    total = rows.agg(F.count(F.lit(1)).alias("v")).scalar()
    placed = position(rows.select("id", "day"), [], ORDER, "at").withColumn("total", total)
    return placed.groupBy((c("at") > F.floor(c("total") * 3 / 4)).alias("held")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("dedup_ranked", """SELECT user_id, event_type, CAST(ts AS DATE) AS day,
  arg_max(event_id, (value > 10, CAST(json_extract(props, '$.k') AS INTEGER), -event_id)) AS kept, min(event_id) AS first_id
FROM events GROUP BY ALL""")
def dedup_ranked(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value",
                                         F.from_json("props", "k int")["k"].alias("k"))
    key = ["user_id", "event_type", "day"]
    best = dedup.keep_best(e, key, [c("value") > 10, c("k")], "event_id").withColumnRenamed("event_id", "kept")
    first = dedup.keep_first(e, key, "event_id").select(*key, c("event_id").alias("first_id"))
    return best.join(first, key).select(*key, "kept", "first_id")


@query("resumable_pending", """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders),
  done AS (SELECT DISTINCT day FROM o WHERE o_totalprice > 400000)
SELECT CAST(g AS DATE) AS requested_date FROM (SELECT unnest(generate_series((SELECT min(day) FROM o), (SELECT max(day) FROM o), INTERVAL 1 DAY)) AS g)
WHERE CAST(g AS DATE) NOT IN (SELECT day FROM done)""")
def resumable_pending(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("requested_date"), "o_totalprice")
    span = o.agg(F.min("requested_date").alias("a"), F.max("requested_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("requested_date"))
    return dedup.pending(days, o.where(c("o_totalprice") > 400000), ["requested_date"])


@query("keyed_union", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS added FROM orders""")
def keyed_union(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey")
    shown = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    theirs = o.where(c("o_orderstatus") != "P").select(*shown)
    ours = o.where(c("o_orderstatus") != "O").withColumn("o_totalprice", c("o_totalprice") + 1).select(
        *shown, c("o_custkey").alias("added"))
    return dedup.keyed_union(ours, theirs, ["o_orderkey"])


@query("json_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.absent') AS INTEGER) AS absent FROM events""")
def json_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int, absent int").alias("p")).select("event_id", "p.*")


@query("hourly_join", """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, avg(value) AS temp, max(value) AS speed, min(value) * 3e0 AS dir
    FROM events WHERE event_type = 'view' GROUP BY ALL),
  j AS (SELECT event_id, temp, speed, e.user_id % 3 AS roof, radians(fmod(dir + 180e0, 360e0) - e.user_id % 360) AS a
    FROM events e LEFT JOIN h ON e.user_id = h.user_id AND date_trunc('hour', e.ts) = h.hour WHERE e.event_type = 'click' AND e.user_id % 7 <> 0)
SELECT event_id AS game_pk, round(temp, 6) AS temp_c, CASE WHEN roof = 0 THEN 0e0 ELSE round(speed * cos(a), 3) + 0e0 END AS out_wind,
  CASE WHEN roof = 0 THEN 0e0 ELSE round(speed * sin(a), 3) + 0e0 END AS cross_wind,
  CASE roof WHEN 0 THEN 'dome' WHEN 1 THEN 'retractable' ELSE 'open' END AS roof_category, CASE WHEN temp IS NOT NULL THEN 1 END AS found FROM j""")
def hourly_join(spark, d):
    """Clicks as games at the user's park, views as its hourly readings; one park in seven is unknown."""
    e = table(spark, d, "events")
    hourly = e.where(c("event_type") == "view").groupBy(S.id_key(c("user_id")).alias("venue_id"), S.utc_hour(c("ts")).alias("hour")).agg(
        F.avg("value").alias("temperature_2m"), F.max("value").alias("wind_speed_10m"), (F.min("value") * 3.0).alias("wind_direction_10m"))
    hourly = hourly.withColumns({k: F.lit(None).cast("double") for k in ("relative_humidity_2m", "surface_pressure", "precipitation")})
    roof = F.when(c("user_id") % 3 == 0, "Dome").when(c("user_id") % 3 == 1, "Retractable").otherwise("Open")
    parks = e.where(c("user_id") % 7 != 0).select("user_id").distinct().select(
        S.id_key(c("user_id")).alias("venue_id"), (c("user_id") % 360).cast("double").alias("azimuth_angle"), roof.alias("roof_type"))
    games = e.where(c("event_type") == "click").select(c("event_id").alias("game_pk"), c("user_id").alias("venue_id"), c("ts").alias("game_date_utc"))
    return landing.game_weather(games, hourly, parks).select(
        "game_pk", F.round("temp_c", 6).alias("temp_c"), (c("wind_out_to_center_ms") + 0.0).alias("out_wind"),
        (c("wind_left_to_right_ms") + 0.0).alias("cross_wind"), "roof_category", "found")


@query("scalars", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS speed, l_quantity * 7e0 AS dir, l_tax * 1000e0 AS az,
    l_discount * 300e0 AS t, 950e0 + l_quantity AS hpa, l_tax * 1000e0 AS hum, l_extendedprice FROM lineitem),
  y AS (SELECT *, radians(fmod(dir + 180e0, 360e0) - az) AS a, 610.78e0 * exp(17.27e0 * t / (t + 237.3e0)) * hum / 100e0 AS vap FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(speed * cos(a), 3) + 0e0 AS out_wind, round(speed * sin(a), 3) + 0e0 AS cross_wind,
  round((101325e0 / (287.058e0 * 288.15e0)) / ((hpa * 100e0 - vap) / (287.058e0 * (t + 273.15e0)) + vap / (461.495e0 * (t + 273.15e0))), 5) AS density,
  CASE WHEN speed > 40 THEN 'dome' WHEN speed > 20 THEN 'retractable' ELSE 'open' END AS roof,
  round(speed * 0.3048e0, 2) AS metres, CAST(l_partkey AS VARCHAR) AS part_key,
  round(CASE WHEN l_extendedprice > 30000 THEN l_extendedprice / 10000e0 ELSE 100e0 / l_extendedprice END, 6) AS won
FROM y""")
def scalars(spark, d):
    q = c("l_quantity")
    rows = table(spark, d, "lineitem")
    out, across = S.wind_components(q, q * 7.0, c("l_tax") * 1000.0)
    roof = S.roof_category(F.when(q > 40, " Dome").when(q > 20, "Retractable").otherwise("Open"))
    signed = F.when(c("l_extendedprice") > 30000, c("l_extendedprice") / 100.0).otherwise(-c("l_extendedprice"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(out, 3) + 0.0).alias("out_wind"),
        (F.round(across, 3) + 0.0).alias("cross_wind"),
        S.air_density_index(c("l_discount") * 300.0, 950.0 + q, c("l_tax") * 1000.0).alias("density"), roof.alias("roof"),
        S.feet_to_metres(q).alias("metres"), S.id_key(c("l_partkey").cast("double")).alias("part_key"),
        F.round(S.payout(signed, F.lit(1.0)), 6).alias("won"))


@query("club_keys", """SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower('The ' || s_name || '  F.C.'), '[^a-z ]', '', 'g'), '\\s+', ' ', 'g')) AS club FROM supplier""")
def club_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.team_key(F.concat(F.lit("The "), "s_name", F.lit("  F.C."))).alias("club"))
