"""Prices, consensus, matching and verdicts over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.checks.base import query, table
from fungo import config as C
from fungo.functions import rng, scalars as S
from fungo.operators import match, metrics, quotes as Q
from fungo.plans import comparison
from fungo.session import cut_lineage
from fungo.sources.tables import capture_counts as capture

c = F.col

FORECAST = """f AS (
  SELECT o_orderkey AS id, c_mktsegment AS market, strftime(o_orderdate, '%Y-%m') AS month,
         greatest(least(0.1e0 + 0.8e0 * o_totalprice / 500000e0, 0.9e0), 0.1e0) AS model,
         greatest(least(0.1e0 + 0.8e0 * (c_acctbal + 1000e0) / 11000e0, 0.9e0), 0.1e0) AS price,
         CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

ORIENTED = FORECAST + """, g AS (
  SELECT id, market, abs(model - price) * 100e0 AS gap_pts,
         CASE WHEN model - price > 0 THEN model ELSE 1e0 - model END AS model_prob,
         CASE WHEN model - price > 0 THEN price ELSE 1e0 - price END AS market_prob,
         CASE WHEN model - price > 0 THEN y ELSE 1e0 - y END AS won FROM f)"""

AMERICAN = "CASE WHEN {0} < 0 THEN -({0}) / (-({0}) + 100e0) ELSE 100e0 / (({0}) + 100e0) END"

QUOTES = f"""q AS (
  SELECT *, {AMERICAN.format('price_home')} AS ph, {AMERICAN.format('price_away')} AS pa FROM (
    SELECT l_partkey AS event_id, l_returnflag AS market, l_suppkey AS book, l_shipdate, l_orderkey,
           CASE WHEN l_linestatus = 'O' THEN 'us' ELSE 'eu' END AS region,
           100e0 + l_quantity * 3e0 + l_linenumber AS price_home,
           -(110e0 + round(l_extendedprice / 1000e0, 0)) AS price_away,
           l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS ordinal
    FROM lineitem))"""


def forecasts(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return orders.join(people, orders.o_custkey == people.c_custkey).select(
        c("o_orderkey").alias("id"), c("c_mktsegment").alias("market"), S.month_of(c("o_orderdate")).alias("month"),
        S.clip(0.1 + 0.8 * c("o_totalprice") / 500000.0, 0.1, 0.9).alias("model"),
        S.clip(0.1 + 0.8 * (c("c_acctbal") + 1000.0) / 11000.0, 0.1, 0.9).alias("price"),
        (c("o_orderstatus") == "F").cast("double").alias("y"))


def book_quotes(spark, d) -> DataFrame:
    q = table(spark, d, "lineitem").select(
        c("l_partkey").alias("event_id"), c("l_returnflag").alias("market"),
        c("l_suppkey").alias("book"), "l_shipdate", "l_orderkey",
        F.when(c("l_linestatus") == "O", "us").otherwise("eu").alias("region"),
        (100.0 + c("l_quantity") * 3.0 + c("l_linenumber")).alias("price_home"),
        (-(110.0 + F.round(c("l_extendedprice") / 1000.0, 0))).alias("price_away"),
        (c("l_orderkey") * 10000000 + c("l_linenumber") * 1000000 + c("l_suppkey")).alias("ordinal"))
    return q.withColumns({
        "book_key": c("book").cast("string"), "book_title": F.concat(F.lit("book "), c("book").cast("string")),
        "point": F.lit(None).cast("double"), "devig_prob_home": S.devig(c("price_home"), c("price_away"))})


def bootstrap_sql(source: str, keys: list[str], cluster: str, value: str, outcome: str | None, draws: int,
                  seed: int, minimum: int) -> str:
    k = ", ".join(keys)
    y = outcome or "0e0"
    same = " AND ".join(f"s.{x} = p.{x}" for x in keys)
    only = "WHERE lo < hi" if outcome else ""
    return f"""parts AS (SELECT {k}, {cluster}, sum({value}) AS s, count({value}) AS n, min({y}) AS lo, max({y}) AS hi
    FROM {source} GROUP BY {k}, {cluster}),
  idx AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {cluster}) - 1 AS i,
                 count(*) OVER (PARTITION BY {k}) AS c FROM parts),
  slots AS (SELECT {k}, d, {rng.mix_sql('d', 'i', seed)} % c AS i FROM idx, range(1, {draws + 1}) AS r(d) WHERE c >= {minimum}),
  means AS (SELECT {", ".join("s." + x for x in keys)}, s.d, sum(p.s) / sum(p.n) AS m, min(p.lo) AS lo, max(p.hi) AS hi
            FROM slots s JOIN idx p ON {same} AND s.i = p.i GROUP BY ALL),
  ends AS (SELECT {k}, count(*) AS usable, round(quantile_cont(m, 0.05), 5) AS low, round(quantile_cont(m, 0.95), 5) AS high
           FROM means {only} GROUP BY {k} HAVING count(*) >= 100)"""


LOSS = "-(y * ln({0}) + (1e0 - y) * ln(1e0 - {0}))"


@query("market_verdict", f"""WITH {FORECAST}, t AS (SELECT *, ({LOSS.format('model')}) - ({LOSS.format('price')}) AS gap FROM f),
  {bootstrap_sql('t', ['market'], 'month', 'gap', 'y', 2000, 11, 10)},
  core AS (SELECT market, count(*) AS games, avg({LOSS.format('model')}) AS lm, avg({LOSS.format('price')}) AS lp,
                  avg(abs(model - price)) * 100e0 AS dis FROM t GROUP BY market)
SELECT core.market, games, round(lm, 5) AS log_loss_model, round(lp, 5) AS log_loss_market, round(lm - lp, 5) AS delta,
       low AS ci_low, high AS ci_high, round(dis, 3) AS mean_abs_disagreement_pts,
       CAST(lm < lp AS INTEGER) AS model_beats_market,
       CASE WHEN low IS NULL THEN 'insufficient sample for an interval'
            WHEN low > 0 THEN 'market better; interval excludes zero'
            WHEN high < 0 THEN 'model better; interval excludes zero'
            ELSE 'undecided; interval spans zero' END AS verdict
FROM core LEFT JOIN ends ON core.market = ends.market""")
def market_verdict(spark, d):
    frame = forecasts(spark, d).withColumnRenamed("month", "official_date")
    return metrics.compare(frame)


@query("consensus_lines", f"""WITH {QUOTES}, p AS (SELECT *, ph / (ph + pa) AS dv FROM q WHERE region = 'us'),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id, market ORDER BY price_home DESC) AS kh,
               row_number() OVER (PARTITION BY event_id, market ORDER BY price_away DESC) AS ka,
               count(*) OVER (PARTITION BY event_id, market) AS n FROM p)
SELECT event_id, market, count(*) AS market_books, round(median(dv), 8) AS consensus_prob_home,
       round(max(dv) - min(dv), 8) AS market_spread,
       max(price_home) FILTER (kh = (n + 1) // 2) AS consensus_price_home,
       max(price_away) FILTER (ka = (n + 1) // 2) AS consensus_price_away,
       max(price_home) AS best_price_home, max(price_away) AS best_price_away,
       'book ' || arg_max(book, (price_home, -ordinal)) AS best_book_home,
       'book ' || arg_max(book, (price_away, -ordinal)) AS best_book_away
FROM r GROUP BY event_id, market""")
def consensus_lines(spark, d):
    return Q.consensus_lines(book_quotes(spark, d)).select(
        "event_id", "market", "market_books", "consensus_prob_home", "market_spread", "consensus_price_home",
        "consensus_price_away", "best_price_home", "best_price_away", "best_book_home", "best_book_away")


LEADERS = tuple(str(i) for i in range(0, 100, 7))


@query("leader_follower", f"""WITH {QUOTES}, p AS (SELECT *, ph / (ph + pa) AS dv,
    CAST(book AS VARCHAR) IN {LEADERS} AS lead FROM q)
SELECT event_id, round(median(dv) FILTER (lead), 8) AS leader_prob_home, count(*) FILTER (lead) AS leader_books,
       round(median(dv) FILTER (NOT lead AND region = 'us'), 8) AS follower_prob_home,
       count(*) FILTER (NOT lead AND region = 'us') AS follower_books
FROM p GROUP BY event_id HAVING count(*) FILTER (region = 'us') > 0""")
def leader_follower(spark, d):
    return Q.consensus_lines(book_quotes(spark, d), keys=("event_id",), leaders=LEADERS).select(
        "event_id", "leader_prob_home", "leader_books", "follower_prob_home", "follower_books")


SIDED = """s AS (SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus AS side,
    CASE WHEN l_quantity > 25 THEN 100e0 + l_quantity ELSE -(95e0 + l_quantity) END AS price,
    (l_orderkey * 10 + l_linenumber) * 1000 + CAST(l_quantity AS BIGINT) AS ord FROM lineitem)"""


@query("two_sided_pairing", f"""WITH {SIDED}, g AS (SELECT l_partkey, l_suppkey, l_returnflag,
    arg_max(price, ord) FILTER (side = 'O') AS price_home, arg_max(price, ord) FILTER (side = 'F') AS price_away
  FROM s GROUP BY ALL), u AS (SELECT *, {AMERICAN.format('price_home')} AS ph, {AMERICAN.format('price_away')} AS pa FROM g
  WHERE abs(price_home) >= 100 AND abs(price_away) >= 100)
SELECT l_partkey, l_suppkey, l_returnflag, price_home, price_away, round(ph / (ph + pa), 6) AS devig_prob_home FROM u""")
def two_sided_pairing(spark, d):
    q = c("l_quantity")
    sided = table(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", "l_returnflag", F.when(c("l_linestatus") == "O", "home").otherwise("away").alias("side"),
        F.when(q > 25, 100.0 + q).otherwise(-(95.0 + q)).alias("price"),
        ((c("l_orderkey") * 10 + c("l_linenumber")) * 1000 + q.cast("bigint")).alias("ord"))
    return Q.pair_sides(sided, ["l_partkey", "l_suppkey", "l_returnflag"], [], "ord").select(
        "l_partkey", "l_suppkey", "l_returnflag", "price_home", "price_away",
        F.round("devig_prob_home", 6).alias("devig_prob_home"))


ENTRY = f"""{QUOTES}, e AS (SELECT book AS event_id, event_id % 5 AS book_key, date_trunc('month', l_shipdate) AS taken,
    TIMESTAMP '2001-06-30 12:00:00' AS commence,
    CASE market WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS line, ph / (ph + pa) AS dv FROM q),
  live AS (SELECT *, (epoch_us(commence) - epoch_us(taken)) / 3.6e9 AS lead FROM e WHERE taken < commence),
  i AS (SELECT event_id, min(taken) FILTER (lead >= 20) AS entry_at, max(taken) AS close_at,
               max(lead) FILTER (lead >= 20) AS entry_lead, min(lead) AS close_lead FROM live GROUP BY event_id),
  g AS (SELECT event_id, line, median(dv) FILTER (taken = entry_at) AS ep, count(DISTINCT book_key) FILTER (taken = entry_at) AS entry_books,
               median(dv) FILTER (taken = close_at) AS cp, count(DISTINCT book_key) FILTER (taken = close_at) AS close_books,
               round(any_value(entry_lead), 2) AS entry_lead_hours, round(any_value(close_lead), 2) AS close_lead_hours
        FROM live JOIN i USING (event_id) WHERE taken = entry_at OR taken = close_at GROUP BY event_id, line),
  p AS (SELECT event_id, CASE line WHEN 0 THEN 'h2h' WHEN 1 THEN 'spreads' ELSE 'totals' END AS market,
               CASE line WHEN 1 THEN -1.5e0 WHEN 2 THEN 8.5e0 END AS point,
               round(CASE WHEN entry_books >= 3 THEN ep END, 6) AS entry_prob, entry_books, entry_lead_hours,
               round(CASE WHEN close_books >= 3 THEN cp END, 6) AS close_prob, close_books, close_lead_hours
        FROM g WHERE entry_books >= 3 OR close_books >= 3)"""


def snapshot_quotes(spark, d) -> DataFrame:
    q = book_quotes(spark, d)
    market = F.when(c("market") == "A", "h2h").when(c("market") == "N", "spreads").otherwise("totals")
    return q.select(
        c("book").alias("event_id"), (c("event_id") % 5).cast("string").alias("book_key"),
        F.date_trunc("month", "l_shipdate").alias("fetched_at"),
        F.lit("2001-06-30 12:00:00").cast("timestamp_ntz").alias("commence_time"), market.alias("market"),
        F.when(c("market") == "N", -1.5).when(c("market") == "R", 8.5).alias("point"), "devig_prob_home")


@query("entry_close", f"WITH {ENTRY} SELECT * FROM p")
def entry_close(spark, d):
    return Q.entry_close(Q.before_start(snapshot_quotes(spark, d))).withColumns(
        {k: F.round(k, 6) for k in ("entry_prob", "close_prob")})


@query("coverage_report", f"""WITH {ENTRY} SELECT (SELECT count(DISTINCT event_id) FROM e) AS odds_events,
  (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT event_id FROM p)) AS unmatched_events,
  count(*) AS priced_game_markets, count(*) FILTER (entry_books >= 3) AS with_entry,
  count(*) FILTER (close_books >= 3) AS with_close, round(median(entry_lead_hours), 2) AS median_entry_lead_hours,
  round(median(close_lead_hours), 2) AS median_close_lead_hours FROM p""")
def coverage_report(spark, d):
    quotes = snapshot_quotes(spark, d)
    priced = Q.entry_close(Q.before_start(quotes))
    missing = table(spark, d, "supplier").select(c("s_suppkey").alias("event_id")).join(priced, "event_id", "left_anti")
    return Q.coverage(quotes, missing, priced)


@query("region_precedence", f"""WITH {QUOTES}, k AS (SELECT event_id, book, market,
    arg_min((region, price_home, price_away), (CASE region WHEN 'us' THEN 0 ELSE 1 END, ordinal, price_home, price_away)) AS w
  FROM q GROUP BY event_id, book, market)
SELECT event_id, book, market, w[1] AS region, w[2] AS price_home, w[3] AS price_away FROM k""")
def region_precedence(spark, d):
    q = book_quotes(spark, d).withColumn("priced", (c("region") == "us").cast("int")).select(
        "event_id", "book", "book_key", "market", "point", "region", "priced", "price_home", "price_away",
        "ordinal")
    return Q.merge_regions(q).select("event_id", "book", "market", "region", "price_home", "price_away")


@query("overround", f"""WITH {QUOTES} SELECT count(*) AS quotes, round(median(ph + pa - 1e0) * 100e0, 2)
  AS measured_overround_pct FROM q""")
def overround(spark, d):
    return Q.overround(book_quotes(spark, d))


@query("quote_ids", f"""WITH {QUOTES} SELECT snapshot_id, count(*) AS n FROM (
  SELECT substr(sha256(concat_ws('|', event_id, region, book, market, '', CAST(price_home AS BIGINT),
         CAST(price_away AS BIGINT))), 1, 20) AS snapshot_id FROM q) GROUP BY snapshot_id""")
def quote_ids(spark, d):
    ident = S.quote_id(c("event_id"), c("region"), c("book"), c("market"), F.lit(None).cast("string"),
                       c("price_home").cast("bigint"), c("price_away").cast("bigint"))
    return book_quotes(spark, d).groupBy(ident.alias("snapshot_id")).agg(F.count(F.lit(1)).alias("n"))


@query("nearest_match", """WITH RECURSIVE p AS (SELECT user_id, event_id, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase'),
  cand AS (SELECT p.user_id, p.k, c.event_id AS click, abs(epoch_us(p.ts) - epoch_us(c.ts)) AS gap, c.ts AS cts
           FROM p JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click'
           WHERE abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 43200000000),
  options AS (SELECT user_id, k, list(click ORDER BY gap, cts, click) AS clicks, list(gap ORDER BY gap, cts, click) AS gaps
              FROM cand GROUP BY user_id, k),
  walk AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS pick, NULL::BIGINT AS event_id, NULL::BIGINT AS gap
           FROM (SELECT DISTINCT user_id FROM p)
    UNION ALL
    SELECT user_id, k, list_append(taken, pick), pick, event_id, CASE WHEN pick IS NOT NULL THEN gaps[list_position(clicks, pick)] END FROM (
      SELECT w.user_id, p.k, w.taken, p.event_id, o.clicks, o.gaps,
             list_filter(o.clicks, lambda x: NOT list_contains(w.taken, x))[1] AS pick
      FROM walk w JOIN p ON p.user_id = w.user_id AND p.k = w.k + 1
      LEFT JOIN options o ON o.user_id = p.user_id AND o.k = p.k))
SELECT event_id, pick AS game_pk, round(gap / 3.6e9, 6) AS gap_hours FROM walk WHERE k > 0""")
def nearest_match(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    keys = [c("user_id").alias("home_key"), F.lit(0).alias("away_key")]
    bought = e.where(c("event_type") == "purchase").select(*keys, "event_id", c("ts").alias("commence"))
    clicked = e.where(c("event_type") == "click").select(*keys, c("event_id").alias("game_pk"), c("ts").alias("start"))
    return match.match_events(bought, clicked).select(
        c("event_id").cast("bigint").alias("event_id"), c("game_pk").cast("bigint").alias("game_pk"),
        F.round("gap_hours", 6).alias("gap_hours"))


@query("bands_roi", f"""WITH {ORIENTED}, b AS (SELECT *, CASE WHEN gap_pts < 3 THEN '0-3' WHEN gap_pts < 5 THEN '3-5'
    WHEN gap_pts < 8 THEN '5-8' WHEN gap_pts < 10 THEN '8-10' WHEN gap_pts < 12 THEN '10-12' WHEN gap_pts < 13 THEN '12-13'
    WHEN gap_pts < 14 THEN '13-14' WHEN gap_pts < 15 THEN '14-15' WHEN gap_pts < 17 THEN '15-17'
    WHEN gap_pts < 100 THEN '17+' END AS band FROM g)
SELECT band, count(*) AS games, round(avg(model_prob) * 100, 1) AS model_says, round(avg(market_prob) * 100, 1) AS market_says,
       round(avg(won) * 100, 1) AS actually_won, round((avg(won / market_prob) - 1) * 100, 1) AS no_vig_roi_pct
FROM b WHERE band IS NOT NULL GROUP BY band""")
def bands_roi(spark, d):
    return metrics.band_table(metrics.oriented_frame(forecasts(spark, d)))


@query("wide_disagreements", f"""WITH {ORIENTED} SELECT 10e0 AS threshold_pts, count(*) AS games,
  round(avg(model_prob) * 100, 1) AS model_says, round(avg(market_prob) * 100, 1) AS market_says,
  round(avg(won) * 100, 1) AS actually_won FROM g WHERE gap_pts >= 10""")
def wide_disagreements(spark, d):
    return metrics.wide_disagreements(metrics.oriented_frame(forecasts(spark, d)))


@query("verdict_summary", f"""WITH {FORECAST}, t AS (SELECT *, ({LOSS.format('model')}) - ({LOSS.format('price')}) AS gap FROM f),
  {bootstrap_sql('t', ['market'], 'month', 'gap', 'y', 2000, 11, 10)},
  core AS (SELECT market, count(*) AS games, round(avg({LOSS.format('model')}) - avg({LOSS.format('price')}), 5) AS delta FROM t GROUP BY market)
SELECT core.market, CASE WHEN games >= 50 THEN delta END AS delta, CAST(coalesce(high < 0, false) AS INTEGER) AS beaten
FROM core LEFT JOIN ends ON core.market = ends.market""")
def verdict_summary(spark, d):
    report = metrics.compare(forecasts(spark, d).withColumnRenamed("month", "official_date"))
    return comparison.verdict_rows(report).select("market", "delta", "beaten")


CHAIN = f"""o AS (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS official_date,
    epoch_us(o_orderdate) + 5184000000000 + o_orderkey * 1000000 AS start, o_totalprice,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS home_win, CAST(floor(o_totalprice / 50000e0) AS INTEGER) - 4 AS run_diff,
    CAST(floor(o_totalprice / 30000e0) AS INTEGER) AS total_runs FROM orders),
  {QUOTES}, z AS (SELECT id, official_date, start, epoch_us(l_shipdate) AS taken, book, ph / (ph + pa) AS dv,
    CASE market WHEN 'A' THEN 'h2h' WHEN 'N' THEN 'spreads' ELSE 'totals' END AS market FROM q JOIN o ON l_orderkey = id WHERE epoch_us(l_shipdate) < start),
  last AS (SELECT id, max(taken) AS close_at FROM z GROUP BY id),
  c AS (SELECT id, official_date, market, median(dv) AS price, count(DISTINCT book) AS books FROM z JOIN last USING (id)
        WHERE taken = close_at GROUP BY id, official_date, market HAVING count(DISTINCT book) >= 1),
  t AS (SELECT market, c.official_date, price, 0.1e0 + 0.8e0 * (o.o_custkey * 7919 % 1000) / 1000e0 AS model,
          CAST(CASE market WHEN 'h2h' THEN home_win WHEN 'spreads' THEN CAST(run_diff > 1.5 AS INTEGER) ELSE CAST(total_runs > 8.5 AS INTEGER) END AS DOUBLE) AS y
        FROM c JOIN o USING (id)),
  t2 AS (SELECT *, ({LOSS.format('model')}) - ({LOSS.format('price')}) AS gap FROM t)"""


@query("closing_line_report", f"""WITH {CHAIN},
  {bootstrap_sql('t2', ['market'], 'official_date', 'gap', 'y', 2000, 11, 10)},
  core AS (SELECT market, count(*) AS games, avg({LOSS.format('model')}) AS lm, avg({LOSS.format('price')}) AS lp FROM t2 GROUP BY market)
SELECT core.market, games, round(lm, 5) AS log_loss_model, round(lp, 5) AS log_loss_market, round(lm - lp, 5) AS delta,
       low AS ci_low, high AS ci_high, CAST(lm < lp AS INTEGER) AS model_beats_market FROM core LEFT JOIN ends USING (market) WHERE games >= 50""")
def closing_line_report(spark, d):
    """Quotes of every line, matched to orders by names and start, closed, and
    held against a forecast: the whole path from quote to verdict."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    start = F.timestamp_micros(F.unix_micros(c("o_orderdate").cast("timestamp")) + F.lit(5184000000000) + c("o_orderkey") * 1000000)
    club = F.translate(F.concat(F.lit("club "), c("o_custkey").cast("string")), "0123456789", "abcdefghij")
    games = o.select(
        c("o_orderkey").alias("game_pk"), F.to_date("o_orderdate").alias("official_date"), start.alias("game_date_utc"),
        club.alias("home_team_name"), F.lit("The Field").alias("away_team_name"),
        (c("o_orderstatus") == "F").cast("int").alias("home_win"),
        (F.floor(c("o_totalprice") / 50000.0) - 4).cast("int").alias("run_diff"),
        F.floor(c("o_totalprice") / 30000.0).cast("int").alias("total_runs"))
    market = F.when(c("market") == "A", "h2h").when(c("market") == "N", "spreads").otherwise("totals")
    quotes = book_quotes(spark, d).join(games, c("l_orderkey") == c("game_pk")).select(
        F.concat(F.lit("e"), c("l_orderkey").cast("string")).alias("event_id"), c("game_date_utc").alias("commence_time"),
        c("l_shipdate").cast("timestamp").alias("fetched_at"), F.upper("home_team_name").alias("home_team"),
        F.lit("the  field!").alias("away_team"), market.alias("market"),
        F.when(c("market") == "N", -1.5).when(c("market") == "R", 8.5).alias("point"), "book_key", "devig_prob_home", "ordinal")
    model = 0.1 + 0.8 * (c("o_custkey") * 7919 % 1000) / 1000.0
    lines = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(p).cast("double").alias("point"))
                      for m, p in C.USUAL_LINES])
    predictions = o.select(c("o_orderkey").alias("game_pk"), model.alias("prob"), F.explode(lines).alias("l")).select(
        "game_pk", "prob", "l.*")
    # Stands for the stored quote log, which is a table in practice.
    quotes = cut_lineage(quotes)
    priced, _ = comparison.priced_games(quotes, games, min_books=1)
    frame = comparison.comparison_frame(priced, predictions, games)
    return metrics.compare(frame).select(
        "market", "games", "log_loss_model", "log_loss_market", "delta", "ci_low", "ci_high", "model_beats_market")


@query("capture_counts", f"""WITH {QUOTES} SELECT count(*) FILTER (region = 'us') AS priced_quotes,
  count(*) FILTER (l_shipdate <= TIMESTAMP '1999-01-01') AS in_play, count(DISTINCT event_id) AS events,
  (SELECT CAST(sum(l_linenumber) AS BIGINT) FROM lineitem) AS credits FROM q""")
def capture_counts(spark, d):
    quotes = book_quotes(spark, d).select("event_id", (c("region") == "us").cast("int").alias("priced"),
                                          c("l_shipdate").cast("timestamp").alias("commence_time"))
    spend = table(spark, d, "lineitem").select(c("l_linenumber").cast("string").alias("credits_used"))
    return capture(quotes, F.lit("1999-01-01").cast("timestamp"), spend)
