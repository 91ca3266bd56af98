"""Calibration, resampling and state studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo import config as C
from fungo.checks.base import query, table
from fungo.checks.market import FORECAST, LOSS, ORIENTED, bootstrap_sql, forecasts
from fungo.functions import rng, scalars as S
from fungo.operators import leverage, metrics, pricing, resample

c = F.col

GRADED = """d AS (SELECT lang, n_chars / (n_chars + 800e0) AS p, CAST(quality AS DOUBLE) AS y
  FROM documents JOIN labels USING (doc_id))"""


def graded(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select(
        "lang", (c("n_chars") / (c("n_chars") + 800.0)).alias("p"), c("quality").cast("double").alias("y"))


def calibration_sql(source, keys):
    k = "".join(f"{x}, " for x in keys)
    return f"""bins AS (SELECT {k}CASE {' '.join(f'WHEN p >= {i / 10!r} AND p < {(i + 1) / 10!r} THEN {i}' for i in range(10))} END AS bin, p, y FROM {source}),
  tab AS (SELECT {k}bin, count(*) AS n, round(avg(p), 4) AS predicted, round(avg(y), 4) AS realised, round(avg(y) - avg(p), 4) AS error
    FROM bins WHERE bin IS NOT NULL GROUP BY {k}bin HAVING count(*) >= 20)"""


@query("calibration", f"WITH {GRADED}, {calibration_sql('d', ['lang'])} SELECT * FROM tab")
def calibration(spark, d):
    return metrics.calibration_table(graded(spark, d), ["lang"])


EVAL = FORECAST.replace("strftime(o_orderdate, '%Y-%m') AS month", "year(o_orderdate) AS season")


@query("brier_logloss", f"""WITH {EVAL}, s AS (SELECT market, season, model AS p, y, {LOSS.format('model')} AS t FROM f),
  {calibration_sql('s', ['market'])},
  err AS (SELECT market, round(sum(abs(error) * n) / sum(n), 5) AS calibration_error FROM tab GROUP BY market),
  {bootstrap_sql('s', ['market'], 'season', 't', None, 4000, 11, 2)},
  core AS (SELECT market, count(*) AS games, avg(y) AS r, avg(t) AS ll, avg((p - y) * (p - y)) AS b FROM s GROUP BY market)
SELECT core.market, games, round(r, 5) AS rate, round(ll, 5) AS log_loss, round(-(r * ln(r) + (1 - r) * ln(1 - r)), 5) AS log_loss_baseline,
       round(b, 5) AS brier, calibration_error, low AS log_loss_low, high AS log_loss_high
FROM core LEFT JOIN err USING (market) LEFT JOIN ends USING (market)""")
def brier_logloss(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"))
    f = forecasts(spark, d).join(orders, c("id") == c("o_orderkey"))
    return metrics.evaluate(f.select("market", "season", c("model").alias("p"), "y"))


SEARCH_DRAWS = 5000


@query("search_correction", f"""WITH {ORIENTED}, cuts AS (SELECT cut FROM range(8, 21) AS r(cut)),
  usable AS (SELECT cut, count(*) AS n, sum(won / market_prob) AS w FROM g JOIN cuts ON gap_pts >= cut GROUP BY cut HAVING count(*) >= 5),
  banded AS (SELECT least(CAST(floor(gap_pts) AS INTEGER), 20) AS band, d,
               sum(CASE WHEN {rng.mix_sql('id', 'd', 3)} / {float(rng.M)!r} < market_prob THEN 1e0 / market_prob ELSE 0e0 END) AS w
             FROM g, range(1, {SEARCH_DRAWS + 1}) AS r(d) WHERE gap_pts >= 8 GROUP BY 1, 2),
  sim AS (SELECT d, cut, sum(b.w) / any_value(n) - 1 AS roi FROM banded b JOIN usable ON band >= cut GROUP BY d, cut),
  best AS (SELECT d, max(roi) AS best FROM sim GROUP BY d), o AS (SELECT max(w / n - 1) AS obs, max(cut) AS top FROM usable)
SELECT CAST(any_value(top) AS INTEGER) AS widest_usable_cut, round(any_value(obs) * 100, 1) AS best_observed_roi_pct,
       round(avg(CAST(best >= obs AS DOUBLE)), 4) AS p_value_after_search, round(avg(best) * 100, 1) AS null_best_cut_mean_roi_pct,
       round(avg(CAST(best > 0.3 AS DOUBLE)), 3) AS null_share_above_30pct, 13 AS cuts_searched FROM best, o""")
def search_correction(spark, d):
    return resample.search_correction(metrics.oriented_frame(forecasts(spark, d)), "id", SEARCH_DRAWS)


GROUPED = """b AS (SELECT o_orderkey AS id, year(o_orderdate) AS season, c_nationkey AS grp, o_totalprice AS v
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def grouped(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    p = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return o.join(p, o.o_custkey == p.c_custkey).select(
        c("o_orderkey").alias("id"), F.year("o_orderdate").alias("season"), c("c_nationkey").alias("grp"),
        c("o_totalprice").alias("v"))


@query("group_spread", f"""WITH {GROUPED}, m AS (SELECT season, grp, avg(v) AS m, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 15),
  k AS (SELECT season, sum(m * n) / sum(n) AS c FROM m GROUP BY season)
SELECT season, count(*) AS groups, round(CASE WHEN count(*) >= 5 THEN sqrt(sum(n * (m - c) * (m - c)) / sum(n)) END, 5) AS spread
FROM m JOIN k USING (season) GROUP BY season""")
def group_spread(spark, d):
    return resample.group_spread(grouped(spark, d), ["season"], "grp", "v").withColumn("spread", F.round("spread", 5))


PERM_DRAWS = 2000


def _permutation_sql():
    """All rounds of all draws; what depends on the draw alone is computed once per draw."""
    tick = f"(d * {resample.ROUNDS} + s)"
    steps = [f"""keys AS (SELECT d, list({rng.mix_sql(tick, '1', 5)} ORDER BY s) AS centre, list({rng.mix_sql(tick, '2', 6)} ORDER BY s) AS coin
    FROM range(1, {PERM_DRAWS + 1}) AS r(d), range({resample.ROUNDS}) AS q(s) GROUP BY d)""",
             "x0 AS (SELECT d, centre, coin, season, size, pos AS x, v FROM spots, keys)"]
    for s in range(resample.ROUNDS):
        steps.append(f"""y{s} AS (SELECT *, (centre[{s + 1}] % size - x + size) % size AS z FROM x{s}),
  x{s + 1} AS (SELECT d, centre, coin, season, size, CASE WHEN {rng.coin_sql('greatest(x, z)', f'coin[{s + 1}]')} = 1 THEN z ELSE x END AS x, v FROM y{s})""")
    return ",\n  ".join(steps)


@query("permutation_test", f"""WITH {GROUPED},
  laid AS (SELECT season, grp, v, row_number() OVER (PARTITION BY season ORDER BY grp, id) - 1 AS pos,
                  count(*) OVER (PARTITION BY season) AS size FROM b),
  spots AS (SELECT season, pos, size, v - (SELECT avg(v) FROM b) AS v FROM laid),
  {_permutation_sql()},
  sums AS (SELECT x.d, l.grp, sum(x.v) AS s, count(*) AS n FROM x{resample.ROUNDS} x JOIN laid l ON l.season = x.season AND l.pos = x.x GROUP BY ALL),
  kept AS (SELECT * FROM sums WHERE n >= 15),
  null_sd AS (SELECT d, sqrt(greatest(sum(s * s / n) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)), 0)) AS sd FROM kept GROUP BY d),
  m AS (SELECT grp, avg(v) AS m, count(*) AS n FROM b GROUP BY grp HAVING count(*) >= 15),
  k AS (SELECT sum(m * n) / sum(n) AS c FROM m),
  seen AS (SELECT count(*) AS groups, sqrt(sum(n * (m - c) * (m - c)) / sum(n)) AS spread FROM m, k),
  fin AS (SELECT any_value(groups) AS groups, any_value(spread) AS spread, median(sd) AS med, avg(CAST(sd >= spread AS DOUBLE)) AS p FROM null_sd, seen)
SELECT groups, (SELECT count(*) FROM b) AS rows, round(spread, 3) AS observed_spread, round(med, 3) AS null_spread_median, round(p, 4) AS p_value,
       round(spread - med, 3) AS excess, round(sqrt(greatest(spread * spread - med * med, 0)), 3) AS implied_true_sd FROM fin""")
def permutation_test(spark, d):
    out = resample.permutation_test(grouped(spark, d), [], "season", "grp", "v", "id", PERM_DRAWS)
    return out.withColumns({k: F.round(k, 3) for k in (
        "observed_spread", "null_spread_median", "excess", "implied_true_sd")})


STATES = """s AS (SELECT hour(ts) // 3 + 1 AS late, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS is_top,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS outs_before,
    CAST(greatest(least(floor(value / 10) - 4, 8), -8) AS INTEGER) AS diff, user_id, ts,
    CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 1 ELSE 0 END AS home_win FROM events)"""
WE = STATES + """, t AS (SELECT late, is_top, outs_before, diff, count(*) AS n, sum(home_win) AS w FROM s GROUP BY ALL),
  o AS (SELECT sum(w) / sum(n) AS overall FROM t),
  we AS (SELECT t.*, CASE WHEN n >= 30 THEN w / n ELSE overall END AS we, overall FROM t, o)"""
LEV = WE + """, sw AS (SELECT h.*, abs(coalesce(r.we, h.overall) - h.we) + abs(coalesce(q.we, h.overall) - h.we) AS swing FROM we h
   LEFT JOIN we r ON r.late = h.late AND r.is_top = h.is_top AND r.outs_before = h.outs_before
        AND r.diff = greatest(least(h.diff + CASE WHEN h.is_top = 0 THEN 1 ELSE -1 END, 8), -8)
   LEFT JOIN we q ON q.late = h.late AND q.is_top = h.is_top AND q.outs_before = least(h.outs_before + 1, 2) AND q.diff = h.diff),
  lev AS (SELECT late, is_top, outs_before, diff, n, we, swing / coalesce(nullif((SELECT sum(swing * n) / sum(n) FROM sw), 0), 1e0) AS leverage FROM sw)"""


def staged(spark, d):
    kind = c("event_type")
    props = F.from_json("props", "k int")
    return table(spark, d, "events").select(
        (F.floor(F.hour("ts") / 3) + 1).cast("int").alias("late"),
        kind.isin("click", "view").cast("int").alias("is_top"),
        F.when(kind == "error", 1).when(kind == "signup", 2).otherwise(0).alias("outs_before"),
        S.clip(F.floor(c("value") / 10) - 4, -C.MAX_SCORE_DIFF, C.MAX_SCORE_DIFF).cast("int").alias("diff"),
        "user_id", F.to_date("ts").alias("day"), (props["k"] >= 50).cast("int").alias("home_win"))


@query("win_expectancy", f"WITH {WE} SELECT late, is_top, outs_before, diff, n, round(we, 6) AS we FROM we")
def win_expectancy(spark, d):
    return leverage.win_expectancy(staged(spark, d)).select(
        *leverage.STATE, "n", F.round("we", 6).alias("we"))


@query("leverage_states", f"""WITH {LEV} SELECT late, is_top, outs_before, diff, n, round(leverage, 6) AS leverage FROM lev""")
def leverage_states(spark, d):
    return leverage.leverage_table(leverage.win_expectancy(staged(spark, d))).select(
        *leverage.STATE, "n", F.round("leverage", 6).alias("leverage"))


@query("leverage_workload", f"""WITH {LEV} SELECT user_id AS game_pk, CAST(ts AS DATE) AS official_date, is_top AS pitcher_id,
  count(*) AS batters, round(sum(leverage), 4) AS leverage_sum, count(*) FILTER (leverage >= 1.5) AS high_leverage_batters
FROM s JOIN lev USING (late, is_top, outs_before, diff) GROUP BY ALL""")
def leverage_workload(spark, d):
    s = staged(spark, d)
    table_ = leverage.leverage_table(leverage.win_expectancy(s))
    plays = s.select(c("user_id").alias("game_pk"), c("day").alias("official_date"),
                     c("is_top").alias("pitcher_id"), *leverage.STATE)
    return leverage.workload(plays, table_)


@query("play_state", """WITH x AS (SELECT conv_id, turn, role, length(text) // 100 AS outs, length(text) AS score FROM conversations),
  h AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS stint FROM (
    SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS ch FROM x))
SELECT conv_id, turn, role, CAST(least(coalesce(last_value(nullif(outs, 0) IGNORE NULLS) OVER (
         PARTITION BY conv_id, stint ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS INTEGER) AS outs_before,
       coalesce(lag(score) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS score_before FROM h""")
def play_state(spark, d):
    turns = table(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.floor(F.length("text") / 100).cast("int").alias("outs"), F.length("text").alias("score"))
    return leverage.state_before(turns, ["conv_id"], "turn", ["role"], "outs", {"score_before": "score"}).select(
        "conv_id", "turn", "role", "outs_before", "score_before")


@query("margin_shares", """WITH n AS (SELECT l_orderkey, count(*) AS margin FROM lineitem GROUP BY l_orderkey),
  b AS (SELECT least(margin, 4) AS bucket, count(*) AS n FROM n GROUP BY 1)
SELECT CAST(bucket AS INTEGER) AS bucket, n, round(n / (SELECT sum(n) FROM b), 6) AS share FROM b""")
def margin_shares(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("margin"))
    return pricing.margin_shares(counts, "margin").withColumn("share", F.round("share", 6))


SIZED = """z AS (SELECT o_orderpriority AS grp, sum(l_quantity) AS y, max(o_totalprice) / 3000e0 AS mu
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority)"""


def sized(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("y"))
    return o.join(n, o.o_orderkey == n.l_orderkey).select(
        c("o_orderpriority").alias("grp"), "y", (c("o_totalprice") / 3000.0).alias("mu"))


@query("dispersion", f"""WITH {SIZED}, a AS (SELECT grp, count(*) AS n, avg((y - mu) * (y - mu)) AS v, avg(mu) AS m FROM z WHERE mu > 0 GROUP BY grp)
SELECT grp, n, round(CASE WHEN n < 50 THEN 4e0 WHEN v - m <= 1e-6 THEN 50e0 ELSE greatest(least(m * m / (v - m), 50e0), 1e0) END, 6) AS dispersion FROM a""")
def dispersion(spark, d):
    return pricing.dispersion(sized(spark, d), "y", "mu", ["grp"]).withColumn("dispersion", F.round("dispersion", 6))


@query("expected_run_accuracy", f"""WITH {SIZED} SELECT grp AS side, round(avg(mu), 4) AS mean_predicted, round(avg(y), 4) AS mean_actual,
  round(avg(abs(mu - y)), 4) AS mae, round(avg(mu - y), 4) AS bias FROM z GROUP BY grp""")
def expected_run_accuracy(spark, d):
    return metrics.expected_run_accuracy(sized(spark, d).select(
        c("grp").alias("side"), c("mu").alias("predicted"), c("y").alias("actual")))


@query("shape_fit")
def shape_fit(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.count(F.lit(1)) - 1).alias("y"), (F.avg("l_quantity") / 8.0 + 0.5).alias("mu"))
    return pricing.fit_inning_shape(n, "y", "mu")


@query("price_games")
def price_games(spark, d):
    games = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("game_pk")).agg(
        S.clip(F.avg("l_quantity") / 6.0, 0.2, 20.0).alias("home_mean"),
        S.clip(F.avg("l_discount") * 90.0, 0.2, 20.0).alias("away_mean"),
        F.when(F.count(F.lit(1)) > 5, 7).otherwise(9).alias("innings"))
    out = pricing.price_games(games, pricing.Width(), (("h2h", None), ("spreads", -1.5), ("totals", 8.5), ("totals", 9.0)))
    return out.withColumns({k: F.round(k, 6) for k in ("prob", "push", "expected_home", "expected_away")})
