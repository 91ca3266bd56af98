"""Gates, cap, settlement and board over orders and events; models; streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo import config as C
from fungo.checks.base import query, scratch, table
from fungo.functions import scalars as S
from fungo.operators import ledger as L
from fungo.plans import modelling, serving
from fungo.session import written
from fungo.streaming import quotes as stream

c = F.col
NOW = "2001-08-02 00:00:00"

CARD = """card AS (SELECT o_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS day, o_orderkey AS ordinal,
    CASE o_orderstatus WHEN 'F' THEN 'h2h' WHEN 'O' THEN 'spreads' ELSE 'totals' END AS market,
    CASE o_orderstatus WHEN 'O' THEN -1.5e0 WHEN 'P' THEN 8.0e0 END AS point,
    0.2e0 + 0.6e0 * o_totalprice / 500000e0 AS pm, 0.2e0 + 0.6e0 * (c_acctbal + 1000e0) / 11000e0 AS pk,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 1 AS books, CAST(floor(o_totalprice / 1500e0) AS INTEGER) AS lead,
    c_acctbal / 50e0 AS age, c_mktsegment AS seg,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 100e0 + floor(o_totalprice / 5000e0) END AS bh,
    -110e0 AS ba, 100e0 + floor(o_totalprice / 6000e0) AS ch, -115e0 AS ca
  FROM orders JOIN customer ON o_custkey = c_custkey),
 g0 AS (SELECT *, pm - pk AS dis, CASE WHEN pm - pk > 0 THEN 'home' ELSE 'away' END AS side FROM card),
 g1 AS (SELECT *, concat_ws('|', game_pk, market, CASE market WHEN 'h2h' THEN '' WHEN 'spreads' THEN '-1.5' ELSE '8.0' END, side) AS wager_id,
    CASE WHEN side = 'home' THEN bh ELSE ba END AS price, CASE WHEN side = 'home' THEN ch ELSE ca END AS cons FROM g0),
 g2 AS (SELECT *, CASE WHEN seg = 'HOUSEHOLD' AND market = 'totals' THEN 'already_locked' WHEN abs(dis) < 0.03 THEN 'below_edge_rule' WHEN books < 3 THEN 'too_few_books'
    WHEN lead < 20 OR lead > 240 THEN 'outside_lock_window' WHEN age > 180 THEN 'stale_quote'
    WHEN price IS NULL OR cons IS NULL THEN 'no_executable_price'
    WHEN (CASE WHEN cons < 0 THEN -cons / (-cons + 100e0) ELSE 100e0 / (cons + 100e0) END)
       - (CASE WHEN price < 0 THEN -price / (-price + 100e0) ELSE 100e0 / (price + 100e0) END) > 0.08 THEN 'execution_deviation' END AS gate FROM g1),
 prior AS (SELECT day, least(count(*), 2) AS prior FROM card WHERE seg = 'BUILDING' GROUP BY day),
 g3 AS (SELECT g2.*, row_number() OVER (PARTITION BY g2.day, gate IS NULL ORDER BY round(abs(dis), 6) DESC, ordinal) AS rk, coalesce(prior, 0) AS prior
        FROM g2 LEFT JOIN prior USING (day)),
 g4 AS (SELECT *, CASE WHEN gate IS NULL AND prior + rk > 3 THEN 'day_cap' ELSE gate END AS final FROM g3)"""


def card(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    p = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    t = c("o_totalprice")
    status = c("o_orderstatus")
    rows = o.join(p, o.o_custkey == p.c_custkey).select(
        c("o_orderkey").alias("game_pk"), F.to_date("o_orderdate").alias("official_date"), c("o_orderkey").alias("ordinal"),
        F.when(status == "F", "h2h").when(status == "O", "spreads").otherwise("totals").alias("market"),
        F.when(status == "O", -1.5).when(status == "P", 8.0).alias("point"),
        (0.2 + 0.6 * t / 500000.0).alias("model_prob_home"),
        (0.2 + 0.6 * (c("c_acctbal") + 1000.0) / 11000.0).alias("market_prob_home"),
        (F.substring("o_orderpriority", 1, 1).cast("bigint") + 1).alias("market_books"),
        (c("c_acctbal") / 1e5).alias("market_spread"),
        F.floor(t / 1500.0).cast("int").alias("lead_minutes"),
        F.timestamp_micros((F.unix_micros(F.lit(NOW).cast("timestamp")) - c("c_acctbal") / 50.0 * 60e6).cast("bigint")).alias("odds_fetched_at"),
        F.when(c("c_mktsegment") != "MACHINERY", 100.0 + F.floor(t / 5000.0)).alias("best_price_home"),
        F.lit(-110.0).alias("best_price_away"), (100.0 + F.floor(t / 6000.0)).alias("consensus_price_home"),
        F.lit(-115.0).alias("consensus_price_away"), F.lit("a").alias("best_book_home"), F.lit("b").alias("best_book_away"),
        c("c_mktsegment").alias("seg"), F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"),
        F.lit(4.5).alias("expected_home_runs"), F.lit(4.25).alias("expected_away_runs"),
        c("o_orderdate").cast("timestamp").alias("commence_time"), F.lit("v").alias("model_version"), F.lit("glm").alias("model_kind"))
    return rows.withColumn("disagreement", c("model_prob_home") - c("market_prob_home"))


def screened(spark, d):
    rows = card(spark, d)
    lean = S.backed_side(c("disagreement"))
    held = rows.where((c("seg") == "HOUSEHOLD") & (c("market") == "totals")).select(
        S.wager_id(c("game_pk"), c("market"), c("point"), lean).alias("wager_id"))
    prior = rows.where(c("seg") == "BUILDING").groupBy("official_date").agg(
        F.least(F.count(F.lit(1)), F.lit(2)).cast("double").alias("prior"))
    return L.screen(rows, F.lit(NOW).cast("timestamp"), held, prior)


@query("gate_screen", f"WITH {CARD} SELECT wager_id, side, final AS gate FROM g4")
def gate_screen(spark, d):
    return screened(spark, d).select("wager_id", "side", "gate")


@query("rejections_by_gate", f"WITH {CARD} SELECT final AS gate, count(*) AS n FROM g4 WHERE final IS NOT NULL GROUP BY final")
def rejections_by_gate(spark, d):
    return L.rejections_by_gate(L.rejections(screened(spark, d), F.lit(NOW).cast("timestamp")))


@query("day_cap", f"""WITH {CARD} SELECT wager_id, day AS official_date, round(CASE side WHEN 'home' THEN pm ELSE 1e0 - pm END, 6) AS model_prob,
  round(abs(dis), 6) AS disagreement, price, CASE side WHEN 'home' THEN 'a' ELSE 'b' END AS book FROM g4 WHERE final IS NULL""")
def day_cap(spark, d):
    return L.wagers(screened(spark, d), F.lit(NOW).cast("timestamp")).select(
        "wager_id", "official_date", "model_prob", "disagreement", "price", "book")


SETTLED = CARD + """, w AS (SELECT g4.*, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(floor(o_totalprice / 40000e0) AS INTEGER) END AS hs,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE books + 2 END AS aws FROM g4 JOIN orders ON game_pk = o_orderkey),
 s AS (SELECT *, CASE WHEN hs IS NULL THEN NULL ELSE (CASE market WHEN 'h2h' THEN (CASE WHEN hs > aws THEN 1 ELSE -1 END)
     WHEN 'spreads' THEN sign(hs - aws - 1.5e0) ELSE sign(hs + aws - 8e0) END) * (CASE side WHEN 'home' THEN 1 ELSE -1 END) END AS r FROM w),
 t AS (SELECT *, CASE WHEN r > 0 THEN 'win' WHEN r < 0 THEN 'loss' WHEN r = 0 THEN 'push' END AS outcome,
     round(CASE WHEN r > 0 THEN CASE WHEN price > 0 THEN price / 100e0 ELSE 100e0 / -price END WHEN r < 0 THEN -1e0 WHEN r = 0 THEN 0e0 END, 4) AS profit FROM s)"""


def settled(spark, d):
    now = F.lit(NOW).cast("timestamp")
    book = L.wagers(screened(spark, d).withColumn("gate", F.lit(None).cast("string")), now)
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    played = c("o_orderpriority") != "5-LOW"
    results = o.select(
        c("o_orderkey").alias("game_pk"),
        F.when(played, F.floor(c("o_totalprice") / 40000.0).cast("int")).alias("home_score"),
        F.when(played, F.substring("o_orderpriority", 1, 1).cast("int") + 3).alias("away_score"))
    return L.settle(book, results, now)


@query("settle_wagers", f"WITH {SETTLED} SELECT wager_id, outcome, profit FROM t")
def settle_wagers(spark, d):
    return settled(spark, d).select("wager_id", "outcome", "profit")


@query("settle_summary", f"""WITH {SETTLED} SELECT market, count(*) AS wagers, count(*) FILTER (outcome IS NULL) AS open, count(outcome) AS settled,
  count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'loss') AS loss, count(*) FILTER (outcome = 'push') AS push,
  CAST(count(outcome) AS DOUBLE) AS units_staked, round(sum(profit), 4) AS units_profit, round(sum(profit) / count(outcome), 5) AS roi
FROM t GROUP BY ROLLUP (market)""")
def settle_summary(spark, d):
    return L.summarise(settled(spark, d))


@query("staked_by_day", f"""WITH {SETTLED} SELECT day AS official_date, CAST(count(*) AS DOUBLE) AS prior FROM t GROUP BY day""")
def staked_by_day(spark, d):
    return L.staked_by_day(settled(spark, d))


@query("board_latest_gate", f"""WITH {SETTLED}, locked AS (SELECT game_pk, dis FROM g4 WHERE final IS NULL),
  gates AS (SELECT game_pk, market, final AS last_gate FROM g4 WHERE final IS NOT NULL)
SELECT c.game_pk, c.market, CASE c.market WHEN 'h2h' THEN CASE c.side WHEN 'home' THEN 'Home ML' ELSE 'Away ML' END
    WHEN 'spreads' THEN CASE c.side WHEN 'home' THEN 'Home -1.5' ELSE 'Away +1.5' END ELSE CASE c.side WHEN 'home' THEN 'Over 8' ELSE 'Under 8' END END AS pick,
  CASE c.market WHEN 'h2h' THEN 'moneyline' WHEN 'spreads' THEN 'run line' ELSE 'total 8' END AS market_label,
  round(coalesce(round(abs(l.dis), 6), abs(c.dis)) * 100, 1) AS gap, CAST(l.game_pk IS NOT NULL AS INTEGER) AS bet,
  CASE g.last_gate WHEN 'below_edge_rule' THEN 'below rule' WHEN 'too_few_books' THEN 'thin market' WHEN 'outside_lock_window' THEN 'outside lock window'
    WHEN 'stale_quote' THEN 'stale quote' WHEN 'execution_deviation' THEN 'broken quote' WHEN 'day_cap' THEN 'day cap'
    WHEN 'already_locked' THEN 'already locked' WHEN 'no_executable_price' THEN 'no price'
    ELSE CASE WHEN l.game_pk IS NOT NULL THEN '' ELSE 'not taken' END END AS reason
FROM g4 c LEFT JOIN locked l ON l.game_pk = c.game_pk LEFT JOIN gates g ON g.game_pk = c.game_pk""")
def board_latest_gate(spark, d):
    now = F.lit(NOW).cast("timestamp")
    seen = screened(spark, d)
    rejected = L.rejections(seen, now).withColumn("at", F.lit(2))
    # An earlier run rejected every line for another reason and struck the other side of each wager.
    earlier = rejected.withColumns({"gate": F.lit("stale_quote"), "at": F.lit(1)})
    struck = L.wagers(seen, now)
    flipped = struck.withColumns({
        "placed_at": now - F.expr("INTERVAL 1 DAY"), "side": F.when(c("side") == "home", "away").otherwise("home"),
        "disagreement": F.lit(0.5), "wager_id": F.concat("wager_id", F.lit("~"))})
    board = serving.build_board(card(spark, d), flipped.unionByName(struck), L.latest_gate(earlier.unionByName(rejected), "at"))
    return board.select("game_pk", "market", "pick", "market_label", "gap", "bet", "reason")


@query("largest_gaps", f"WITH {CARD} SELECT game_pk, round(dis, 6) AS disagreement FROM g4 ORDER BY abs(dis) DESC, game_pk LIMIT 8")
def largest_gaps(spark, d):
    return serving.largest(card(spark, d)).select("game_pk", F.round("disagreement", 6).alias("disagreement"))


@query("offered_points", """SELECT market, list(DISTINCT p ORDER BY p) AS points FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'spreads' ELSE 'totals' END AS market, l_quantity / 2e0 AS p FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1""")
def offered_points(spark, d):
    market = F.when(c("l_returnflag") == "A", "spreads").when(c("l_returnflag") == "N", "totals").otherwise("h2h")
    return serving.quoted_points(table(spark, d, "lineitem").select(market.alias("market"), (c("l_quantity") / 2.0).alias("point")))


@query("quote_to_model", f"""WITH {CARD} SELECT c.game_pk, round(CASE WHEN push < 1 THEN prob / (1 - push) ELSE prob END, 6) AS p FROM g4 c JOIN (
   SELECT l_orderkey AS game_pk, avg(l_discount) * 5 AS prob, avg(l_tax) * 5 AS push FROM lineitem GROUP BY 1) m ON m.game_pk = c.game_pk""")
def quote_to_model(spark, d):
    model = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("game_pk")).agg(
        (F.avg("l_discount") * 5).alias("prob"), (F.avg("l_tax") * 5).alias("push"))
    return card(spark, d).select("game_pk").join(model, "game_pk").select(
        "game_pk", F.round(S.push_adjusted(c("prob"), c("push")), 6).alias("p"))


@query("headline", f"""WITH {SETTLED} SELECT count(*) AS wagers, count(outcome) AS settled, CAST(count(outcome) AS DOUBLE) AS staked,
  round(sum(profit), 4) AS profit, max(day) FILTER (outcome IS NOT NULL) AS latest_settled, (SELECT count(*) FROM card) AS board_rows,
  (SELECT arg_max(user_id, ts) FROM events) AS credits_remaining, (SELECT count(*) FROM region WHERE r_regionkey % 2 = 1) AS markets_beaten,
  (SELECT max(TIMESTAMP '2001-08-02' - to_microseconds(CAST(trunc(age * 60e6) AS BIGINT))) FROM card) AS captured_at FROM t""")
def headline(spark, d):
    credits = table(spark, d, "events").select(c("user_id").alias("credits_remaining"), c("ts").alias("fetched_at"))
    report = table(spark, d, "region").select(c("r_name").alias("market"), (F.lit(0.5) - c("r_regionkey") % 2).alias("ci_high"))
    return serving.headline(settled(spark, d), report, credits, card(spark, d)).select(
        "wagers", "settled", "staked", F.round("profit", 4).alias("profit"), "latest_settled", "board_rows", "credits_remaining",
        "markets_beaten", "captured_at")


@query("archive_coverage", """WITH p AS (SELECT o_orderkey AS game_pk FROM orders WHERE o_orderpriority <> '5-LOW'),
  w AS (SELECT l_orderkey AS game_pk, min(l_returnflag) AS roof_category FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT roof_category, count(*) AS games, CAST(grouping(roof_category) AS INTEGER) AS is_total FROM p LEFT JOIN w USING (game_pk) GROUP BY ROLLUP (roof_category)""")
def archive_coverage(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("game_pk"), F.when(c("o_orderpriority") != "5-LOW", 1).alias("home_score"))
    w = table(spark, d, "lineitem").where(c("l_linestatus") == "O").groupBy(c("l_orderkey").alias("game_pk")).agg(
        F.min("l_returnflag").alias("roof_category"))
    return serving.archive_coverage(o, w).withColumn("is_total", c("is_total").cast("int"))


# ------------------------------------------------------------------ models

INPUTS = ("home_a", "away_a", "home_b", "away_b", "tilt")


def two_sided_orders(spark, d):
    """Lines per order split in two sides, with order attributes as inputs."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey")
    p = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(c("l_linestatus") == "O").cast("int").alias("home_score"),
        F.count_if(c("l_linestatus") == "F").cast("int").alias("away_score"))
    rows = o.join(l, o.o_orderkey == l.l_orderkey).join(p, c("o_custkey") == c("c_custkey"))
    return rows.select(
        c("o_orderkey").alias("game_pk"), F.to_date("o_orderdate").alias("official_date"),
        F.year("o_orderdate").alias("season"), (c("o_totalprice") / 1e5).alias("home_a"), (c("c_acctbal") / 1e4).alias("away_a"),
        F.month("o_orderdate").cast("double").alias("home_b"), F.dayofmonth("o_orderdate").cast("double").alias("away_b"),
        (c("o_totalprice") / 1e5 - c("c_acctbal") / 1e4).alias("tilt"), "home_score", "away_score",
        (c("home_score") > c("away_score")).cast("int").alias("home_win"), F.lit(9).alias("innings_played"),
        F.lit(9).alias("scheduled_innings"), F.lit(1).alias("home_batted_ninth"))


@query("poisson_glm")
def poisson_glm(spark, d):
    rows = two_sided_orders(spark, d)
    fit = modelling.fit_estimator(modelling.both_dugouts(rows, INPUTS), "glm", INPUTS)
    model = modelling.RunsModel(fit, modelling.Width(), "glm", INPUTS)
    return model.expected(rows).withColumns({k: F.round(k, 4) for k in ("home_mean", "away_mean")})


@query("poisson_conditions", """SELECT name, 2 * (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS rows, 0e0 AS gradient, 0e0 AS bias
FROM (VALUES ('home_a'), ('away_a'), ('home_b'), ('away_b'), ('tilt')) AS t(name)""")
def poisson_conditions(spark, d):
    """What a penalised Poisson fit must satisfy: no slope is left along any column, and fitted and observed totals agree."""
    train = modelling.both_dugouts(two_sided_orders(spark, d), INPUTS)
    fit = modelling.fit_estimator(train, "glm", INPUTS)
    seen = fit.transform(train).select("target", "mean", F.array(*fit.standardised()).alias("x"))
    slopes = F.array(*[F.struct(
        F.lit(name).alias("name"), (F.avg((c("mean") - c("target")) * c("x")[i]) + modelling.ALPHA * fit.coefficients[i]).alias("g"))
        for i, name in enumerate(INPUTS)])
    out = seen.agg(F.count(F.lit(1)).alias("rows"), (F.avg("mean") / F.avg("target") - 1).alias("bias"), slopes.alias("s"))
    return out.select(F.explode("s").alias("s"), "rows", "bias").select(
        "s.name", "rows", (F.round("s.g", 3) + 0.0).alias("gradient"), (F.round("bias", 4) + 0.0).alias("bias"))


@query("walk_forward")
def walk_forward(spark, d):
    # Stands for the stored feature table.
    rows = written(two_sided_orders(spark, d))
    seasons = [r[0] for r in rows.select("season").distinct().orderBy("season").collect()]
    out = modelling.walk_forward(rows.select("game_pk", "official_date", "season", *INPUTS), rows, seasons,
                                 columns=INPUTS, min_train=200)
    return out.withColumns({k: F.round(k, 4) for k in ("prob", "push", "expected_home", "expected_away")})


@query("mirror_views", """SELECT o_orderkey AS game_pk, round(c_acctbal / 1e4, 9) AS home_a, round(o_totalprice / 1e5, 9) AS away_a,
  round(-(o_totalprice / 1e5 - c_acctbal / 1e4), 9) + 0e0 AS tilt FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def mirror_views(spark, d):
    rows = two_sided_orders(spark, d).withColumnRenamed("tilt", "elo_diff")
    seen = modelling.mirror(rows, ("home_a", "away_a", "elo_diff"))
    return seen.select("game_pk", F.round("home_a", 9).alias("home_a"), F.round("away_a", 9).alias("away_a"),
                       (F.round("elo_diff", 9) + 0.0).alias("tilt"))


# ----------------------------------------------------------------- streams

def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
            .withColumn("ts", c("ts").cast("timestamp")))


@query("stream_dedup", "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m') AS month FROM events")
def stream_dedup(spark, d):
    """Two deliveries, each row in them twice; the second repeats the first and adds older events. The log keeps one of each."""
    home = scratch(spark)
    twice = event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    for delivery, rows in (("late", twice.where(F.dayofmonth("ts") > 10)), ("all", twice)):
        stream.log_quotes(rows, f"{home}/log", f"{home}/{delivery}", "event_id", "ts").awaitTermination()
    return spark.read.parquet(f"{home}/log").select("event_id", "user_id", "event_type", "month")


@query("stream_board", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL""")
def stream_board(spark, d):
    home = scratch(spark)
    rows = event_stream(spark, d).select("user_id", "event_type", "ts", "event_id")
    stream.keep_board(rows, f"{home}/board", f"{home}/state", ["user_id", "event_type"], "ts", "event_id").awaitTermination()
    return stream.read_board(spark, f"{home}/board").select("user_id", "event_type", "event_id")


@query("stream_screen", f"""WITH {CARD.replace("seg = 'HOUSEHOLD' AND market = 'totals'", "false").replace("least(count(*), 2)", "0")},
  r AS (SELECT *, day(day) % 2 = 0 AS early FROM g4)
SELECT game_pk, market, coalesce(final, 'wager') AS gate, CASE WHEN final IS NULL THEN price END AS price FROM r
UNION ALL SELECT game_pk, market, coalesce(final, 'already_locked'), NULL FROM r WHERE early""")
def stream_screen(spark, d):
    """The card as a stream of two batches: games of even days, then all games. What is struck and what is rejected are both
    kept; the second batch finds the wagers of the first locked and their days full."""
    home = scratch(spark)
    rows = card(spark, d)
    early = F.dayofmonth("official_date") % 2 == 0
    for part in (rows.where(early), rows):
        part.write.mode("append").parquet(f"{home}/cards")
        stream.screen_cards(spark.readStream.schema(rows.schema).parquet(f"{home}/cards"), f"{home}/ledger", f"{home}/rejected",
                            f"{home}/state", lambda batch: F.lit(NOW).cast("timestamp")).awaitTermination()
    struck = spark.read.parquet(f"{home}/ledger").select(c("game_pk").cast("bigint"), "market", F.lit("wager").alias("gate"), c("price").cast("double"))
    return struck.unionByName(spark.read.parquet(f"{home}/rejected").select("game_pk", "market", "gate", F.lit(None).cast("double").alias("price")))


@query("stream_workload", """WITH w AS (SELECT user_id, CAST(CAST(ts AS DATE) - off AS DATE) AS start_day, value FROM events, (SELECT unnest([0, 1, 2])::INTEGER AS off))
SELECT user_id, start_day, count(*) AS n, floor(sum(value) * 1e4 + 0.5e0) / 1e4 AS workload FROM w GROUP BY ALL""")
def stream_workload(spark, d):
    """Every window, closed or open, of events delivered in two halves by time."""
    home = scratch(spark)
    events = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    span = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("t")).first().t
    for part in (events.where(c("ts") < span), events.where(c("ts") >= span)):
        part.coalesce(1).write.mode("append").parquet(f"{home}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{home}/in")
        stream.keep_workload(rows, f"{home}/board", f"{home}/state", "user_id", "ts", c("value")).awaitTermination()
    return stream.read_board(spark, f"{home}/board").select(
        "user_id", F.to_date("start").alias("start_day"), "n", (F.floor(c("workload") * 1e4 + 0.5) / 1e4).alias("workload"))
