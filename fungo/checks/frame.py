"""The feature frame over orders as games, lines as pitching and customers as venues."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo import config as C
from fungo.checks.base import query, table
from fungo.plans import features
from fungo.session import dealt

c = F.col
SHOWN = [*C.FEATURE_COLUMNS, "ump_run_rate", "ump_k_rate"]

GAMES = """g AS (SELECT o_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS season, o_custkey % 12 AS home,
    (o_custkey % 12 + 1 + o_orderkey % 11) % 12 AS away, o_custkey % 12 * 10 + o_orderkey % 5 AS home_sp,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_custkey % 12 + 1 + o_orderkey % 11) % 12 * 10 + o_orderkey % 4 END AS away_sp,
    o_custkey AS venue, o_orderpriority <> '5-LOW' AS played,
    CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice / 40000e0) AS BIGINT) END AS hs,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 9 END AS aws FROM orders),
  s AS (SELECT game_pk, 'home' AS side, day, season, played, home AS team, home_sp AS sp, hs AS scored, aws AS allowed FROM g
        UNION ALL SELECT game_pk, 'away', day, season, played, away, away_sp, aws, hs FROM g),
  p AS (SELECT l_orderkey AS game_pk, CASE WHEN l_linenumber % 2 = 1 THEN home ELSE away END AS team,
          CASE WHEN l_linenumber = 1 THEN home_sp WHEN l_linenumber = 2 THEN away * 10 + game_pk % 4 ELSE 900 + l_linenumber END AS player,
          CAST(l_linenumber <= 2 AS INTEGER) AS starts, CAST(l_quantity AS BIGINT) AS batters, l_partkey % 10 AS ks, l_suppkey % 4 AS walks,
          l_partkey % 3 AS homers, l_suppkey % 19 AS outs, l_partkey % 5 AS runs, day
        FROM lineitem JOIN g ON l_orderkey = game_pk WHERE played)"""


def before(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"({part}ORDER BY day, game_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def recent(by: str, value: str, n: int) -> str:
    """Mean of the last n played values, for the row whose count of played rows is ``spot``."""
    return f"""SELECT {by}, row_number() OVER w AS spot, {value} FROM s WHERE played AND {by.split(',')[0]} IS NOT NULL
      WINDOW w AS (PARTITION BY {by} ORDER BY day, game_pk)""".replace("@", f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def side_sql(h: str) -> str:
    sums = f"coalesce(l_{h}.batters, 0)"
    lines = ", ".join(
        f"(coalesce(l_{h}.{k}, 0) + {lg} * 200e0) / ({sums} + 200e0) AS {h}_sp_{name}"
        for k, lg, name in (("ks", "lg_k", "k_rate"), ("walks", "lg_bb", "bb_rate"), ("homers", "lg_hr", "hr_rate")))
    return f"""t_{h}.off AS {h}_off, t_{h}.def AS {h}_def, t_{h}.ro AS {h}_recent_off, t_{h}.rd AS {h}_recent_def, b_{h}.rest AS {h}_rest,
  t_{h}.games AS {h}_games_played, coalesce(r_{h}.rate, 4.5e0) AS {h}_sp_rate, coalesce(r_{h}.form, 4.5e0) AS {h}_sp_recent,
  coalesce(r_{h}.starts, 0) AS {h}_sp_starts, coalesce(r_{h}.rest, 5) AS {h}_sp_rest, {lines},
  CASE WHEN coalesce(l_{h}.n, 0) < 2 THEN 16e0 ELSE l_{h}.outs * 1e0 / l_{h}.n END AS {h}_sp_depth,
  (b_{h}.runs + lg_relief * (300e0 / 27e0)) / (b_{h}.outs + 300e0) * 27e0 AS {h}_bp_rate, b_{h}.work AS {h}_bp_workload"""


ELO = f"""e0 AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY day, game_pk) AS rk FROM g),
  e AS (SELECT DISTINCT season, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS game_pk, CAST(NULL AS DOUBLE) AS rh, CAST(NULL AS DOUBLE) AS ra,
          CAST(MAP([], []) AS MAP(BIGINT, DOUBLE)) AS m FROM g
        UNION ALL
        SELECT season, rk, game_pk, rh, ra, map_concat(m, MAP([home, away], [rh + mv, ra - mv])) FROM (
          SELECT *, coalesce({C.ELO_K!r} * ln(1 + abs(hs - aws)) * (CAST(hs > aws AS DOUBLE)
                      - 1e0 / (1e0 + pow(10e0, -(rh - ra + {C.ELO_HOME_EDGE!r}) / 400e0))), 0e0) AS mv FROM (
            SELECT e0.*, m, coalesce(m[home], {C.ELO_START!r}) AS rh, coalesce(m[away], {C.ELO_START!r}) AS ra
            FROM e JOIN e0 ON e0.season = e.season AND e0.rk = e.rk + 1)))"""


SQL = f"""WITH RECURSIVE {GAMES},
  {ELO},
  t0 AS (SELECT *, count(*) FILTER (played) OVER w AS games, coalesce(sum(scored) OVER w, 0) AS rf, coalesce(sum(allowed) OVER w, 0) AS ra
         FROM s WINDOW w AS {before('team, season')}),
  form AS ({recent('team, season', 'avg(scored) @ AS ro, avg(allowed) @ AS rd', C.FORM_GAMES)}),
  t AS (SELECT game_pk, side, games, (rf + 4.5e0 * 40e0) / (games + 40e0) AS off, (ra + 4.5e0 * 40e0) / (games + 40e0) AS def,
          coalesce(ro, 4.5e0) AS ro, coalesce(rd, 4.5e0) AS rd
        FROM t0 LEFT JOIN form ON form.team = t0.team AND form.season = t0.season AND spot = games),
  rel AS (SELECT game_pk, team, sum(outs) AS outs, sum(runs) AS runs FROM p WHERE starts = 0 GROUP BY ALL),
  b0 AS (SELECT s.*, rel.outs AS o, rel.runs AS u FROM s LEFT JOIN rel ON rel.game_pk = s.game_pk AND rel.team = s.team),
  b1 AS (SELECT *, coalesce(sum(u) FILTER (played) OVER w, 0) AS runs, coalesce(sum(o) FILTER (played) OVER w, 0) AS outs,
           max(day) FILTER (played) OVER w AS last_day FROM b0 WINDOW w AS {before('team')}),
  work AS (SELECT a.game_pk, a.side, coalesce(sum(e.o), 0) * 1e0 AS work FROM b0 a LEFT JOIN b0 e ON e.team = a.team AND e.played AND e.day > a.day - 3
             AND (e.day < a.day OR (e.day = a.day AND e.game_pk < a.game_pk)) GROUP BY ALL),
  b AS (SELECT b1.game_pk, b1.side, runs, outs, work, CAST(CASE WHEN last_day IS NULL THEN 5 ELSE greatest(least(day - last_day, 10), 0) END AS INTEGER) AS rest
        FROM b1 JOIN work USING (game_pk, side)),
  r0 AS (SELECT *, count(*) FILTER (played) OVER w AS starts, coalesce(sum(allowed) OVER w, 0) AS total, max(day) FILTER (played) OVER w AS last_day
         FROM s WHERE sp IS NOT NULL WINDOW w AS {before('sp')}),
  rform AS ({recent('sp', 'avg(allowed) @ AS form', C.STARTER_FORM)}),
  r AS (SELECT game_pk, side, starts, (total + 4.5e0 * 10e0) / (starts + 10e0) AS rate, coalesce(form, 4.5e0) AS form,
          CAST(CASE WHEN last_day IS NULL THEN 5 ELSE greatest(least(day - last_day, 15), 0) END AS INTEGER) AS rest
        FROM r0 LEFT JOIN rform ON rform.sp = r0.sp AND spot = starts),
  l AS (SELECT s.game_pk, s.side, sum(batters) AS batters, sum(ks) AS ks, sum(walks) AS walks, sum(homers) AS homers, sum(outs) AS outs, count(*) AS n
        FROM s JOIN p ON p.player = s.sp AND p.starts = 1 AND (p.day < s.day OR (p.day = s.day AND p.game_pk < s.game_pk)) GROUP BY ALL),
  pg AS (SELECT game_pk, sum(batters) AS batters, sum(ks) AS ks, sum(walks) AS walks, sum(homers) AS homers,
           sum(outs) FILTER (starts = 0) AS ro, sum(runs) FILTER (starts = 0) AS rr FROM p GROUP BY 1),
  lg0 AS (SELECT g.game_pk, sum(hs + aws) OVER w AS runs, count(*) FILTER (played) OVER w AS games, sum(batters) OVER w AS bf, sum(ks) OVER w AS ks,
            sum(walks) OVER w AS bb, sum(homers) OVER w AS hr, sum(ro) OVER w AS ro, sum(rr) OVER w AS rr, count(batters) OVER w AS kg
          FROM g LEFT JOIN pg USING (game_pk) WINDOW w AS {before('')}),
  lg AS (SELECT game_pk, CASE WHEN games > 0 THEN runs * 1e0 / games ELSE 9e0 END AS lg_mean,
           CASE WHEN bf > 5000 THEN ks * 1e0 / bf ELSE 0.225e0 END AS lg_k, CASE WHEN bf > 5000 THEN bb * 1e0 / bf ELSE 0.09e0 END AS lg_bb,
           CASE WHEN bf > 5000 THEN hr * 1e0 / bf ELSE 0.033e0 END AS lg_hr, CASE WHEN kg >= 200 THEN ks * 1e0 / kg ELSE 16e0 END AS lg_kpg,
           CASE WHEN ro >= 3000 THEN rr * 1e0 / ro * 27e0 ELSE 4.2e0 END AS lg_relief FROM lg0),
  v AS (SELECT game_pk, coalesce(sum(hs + aws) OVER w, 0) AS runs, count(*) FILTER (played) OVER w AS games FROM g WINDOW w AS {before('venue')}),
  u0 AS (SELECT game_pk, day, played, hs + aws AS points, CASE WHEN played THEN ks END AS ks, arg_max(user_id % 40, (ts, event_id)) AS ump
         FROM g JOIN events ON event_id = game_pk LEFT JOIN pg USING (game_pk) GROUP BY ALL),
  u AS (SELECT game_pk, coalesce(sum(points) OVER w, 0) AS runs, count(*) FILTER (played) OVER w AS games, coalesce(sum(ks) OVER w, 0) AS ks,
          count(ks) OVER w AS kg FROM u0 WINDOW w AS {before('ump')}),
  x AS (SELECT game_pk, w[2] AS temp, w[3] AS hpa, w[4] AS hum, w[3] - 950e0 AS q, w[5] AS flag FROM (
    SELECT l_orderkey AS game_pk, max((l_linenumber, l_discount * 300e0, 950e0 + l_quantity, l_tax * 1000e0,
      CASE l_returnflag WHEN 'N' THEN 'dome' WHEN 'A' THEN 'retractable' ELSE 'open' END)) AS w FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1)),
  y AS (SELECT *, 610.78e0 * exp(17.27e0 * temp / (temp + 237.3e0)) * hum / 100e0 AS vap FROM x),
  f AS (SELECT g.game_pk, {side_sql('home')}, {side_sql('away')},
    CASE WHEN v.games >= 30 AND lg_mean > 0 THEN 1e0 + (v.runs * 1e0 / v.games / lg_mean - 1e0) * (v.games / (v.games + 120e0)) ELSE 1e0 END AS park_factor,
    coalesce(c_acctbal, 0e0) / 1000e0 AS elevation_km, coalesce(temp, 20e0) AS temp_c,
    coalesce(round((101325e0 / (287.058e0 * 288.15e0)) / ((hpa * 100e0 - vap) / (287.058e0 * (temp + 273.15e0)) + vap / (461.495e0 * (temp + 273.15e0))), 5), 1e0) AS air_density_index,
    coalesce(q, 0e0) AS wind_out_to_center_ms, coalesce(-q, 0e0) AS wind_left_to_right_ms, coalesce(q / 10e0, 0e0) AS precip_mm,
    CAST(coalesce(flag = 'retractable', false) AS INTEGER) AS roof_retractable, CAST(coalesce(flag = 'dome', false) AS INTEGER) AS roof_dome,
    (coalesce(u.runs, 0) + lg_mean * 60e0) / (coalesce(u.games, 0) + 60e0) - lg_mean AS ump_run_rate,
    (coalesce(u.ks, 0) + lg_kpg * 60e0) / (coalesce(u.kg, 0) + 60e0) - lg_kpg AS ump_k_rate,
    e.rh AS home_elo, e.ra AS away_elo, e.rh - e.ra + {C.ELO_HOME_EDGE!r} AS elo_diff
  FROM g JOIN e ON e.game_pk = g.game_pk {" ".join(f"JOIN {a} {a}_{h} ON {a}_{h}.game_pk = g.game_pk AND {a}_{h}.side = '{h}'" if a in "tb" else f"LEFT JOIN {a} {a}_{h} ON {a}_{h}.game_pk = g.game_pk AND {a}_{h}.side = '{h}'" for h in ("home", "away") for a in "tbrl")}
  JOIN lg ON lg.game_pk = g.game_pk JOIN v ON v.game_pk = g.game_pk LEFT JOIN u ON u.game_pk = g.game_pk LEFT JOIN y ON y.game_pk = g.game_pk
  LEFT JOIN customer ON c_custkey = venue AND c_custkey % 4 <> 0),
  z AS (SELECT *, home_rest - away_rest AS rest_diff, home_off * away_def / 4.5e0 * park_factor AS expected_home_runs_prior,
    away_off * home_def / 4.5e0 * park_factor AS expected_away_runs_prior FROM f)
SELECT game_pk, {", ".join(f"floor({k} * 1e5 + 0.5e0) / 1e5 AS {k}" for k in SHOWN)} FROM z"""


@query("feature_frame", SQL)
def feature_frame(spark, d):
    o = table(spark, d, "orders")
    rows = table(spark, d, "lineitem").count()
    played = c("o_orderpriority") != "5-LOW"
    home = (c("o_custkey") % 12)
    away = (home + 1 + c("o_orderkey") % 11) % 12
    hs, aws = (F.when(played, k).cast("int") for k in (F.floor(c("o_totalprice") / 40000.0), c("o_orderkey") % 9))
    games = o.select(
        c("o_orderkey").alias("game_pk"), F.to_date("o_orderdate").alias("official_date"), F.year("o_orderdate").alias("season"),
        home.alias("home_team_id"), away.alias("away_team_id"), (home * 10 + c("o_orderkey") % 5).alias("home_sp_id"),
        F.when(c("o_orderkey") % 13 != 0, away * 10 + c("o_orderkey") % 4).alias("away_sp_id"), c("o_custkey").alias("venue_id"),
        hs.alias("home_score"), aws.alias("away_score"))
    line = c("l_linenumber")
    player = (F.when(line == 1, c("home_sp_id")).when(line == 2, c("away_team_id") * 10 + c("game_pk") % 4).otherwise(900 + line))
    pitching = dealt(table(spark, d, "lineitem"), rows, "l_orderkey").join(games, c("l_orderkey") == c("game_pk")).select(
        "game_pk", F.when(line % 2 == 1, c("home_team_id")).otherwise(c("away_team_id")).alias("team_id"), player.alias("player_id"),
        (line <= 2).cast("int").alias("is_starter"), c("l_quantity").cast("int").alias("batters_faced"), (c("l_partkey") % 10).alias("strike_outs"),
        (c("l_suppkey") % 4).alias("walks"), F.lit(0).alias("hit_batsmen"), (c("l_partkey") % 3).alias("home_runs"),
        (c("l_suppkey") % 19).alias("outs"), (c("l_partkey") % 5).alias("runs"))
    parks = table(spark, d, "customer").where(c("c_custkey") % 4 != 0).select(c("c_custkey").alias("venue_id"), c("c_acctbal").alias("elevation_m"))
    umpires = table(spark, d, "events").select(
        c("event_id").alias("game_pk"), (c("user_id") % 40).alias("hp_umpire_id"), F.struct("ts", "event_id").alias("ordinal"))
    q = c("l_quantity")
    weather = dealt(table(spark, d, "lineitem").where(c("l_orderkey") % 3 != 0), rows, "l_orderkey").select(
        c("l_orderkey").alias("game_pk"), line.alias("ordinal"), (c("l_discount") * 300.0).alias("temp_c"), (q + 950.0).alias("pressure_hpa"),
        (c("l_tax") * 1000.0).alias("humidity_pct"), q.alias("wind_out_to_center_ms"), (-q).alias("wind_left_to_right_ms"),
        (q / 10.0).alias("precip_mm"), F.when(c("l_returnflag") == "A", "retractable").when(c("l_returnflag") == "N", "dome").otherwise("open").alias("roof_category"))
    frame = features.build_features(games, parks, weather, pitching, umpires, "season",
                                    lambda k: F.floor(k.cast("double") * 1e5 + 0.5) / 1e5)
    return frame.select("game_pk", *SHOWN)
