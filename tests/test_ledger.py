import datetime as dt

import pytest
from pyspark.sql import functions as F

from fungo.operators import ledger as L
from fungo.plans import serving
from fungo.schemas import DDL
from fungo.sources.tables import conform

NOW = "2025-04-17 20:00:00"
BASE = dict(game_pk=1, official_date=dt.date(2025, 4, 17), commence_time=dt.datetime(2025, 4, 17, 22), home_team="H",
            away_team="A", market="h2h", point=None, model_prob_home=0.60, market_prob_home=0.54, disagreement=0.06,
            market_books=5, market_spread=0.02, consensus_price_home=-115.0, consensus_price_away=105.0,
            best_price_home=-110.0, best_book_home="bh", best_price_away=110.0, best_book_away="ba",
            expected_home_runs=4.5, expected_away_runs=4.0, lead_minutes=120, odds_fetched_at=dt.datetime(2025, 4, 17, 19),
            model_version="v", model_kind="glm")


def now():
    return F.lit(NOW).cast("timestamp")


def card(spark, *changes):
    rows = [dict(BASE, ordinal=i, **c) for i, c in enumerate(changes)]
    ddl = DDL["card"] + ", ordinal bigint"
    names = [f.split()[0] for f in ddl.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


@pytest.mark.parametrize("change,gate,detail", [
    ({}, None, ""), (dict(disagreement=0.029), "below_edge_rule", "0.0290 < 0.03"), (dict(disagreement=-0.05), None, ""),
    (dict(market_books=2), "too_few_books", "2"), (dict(lead_minutes=19), "outside_lock_window", "19 min"),
    (dict(lead_minutes=241), "outside_lock_window", "241 min"), (dict(lead_minutes=20), None, ""),
    (dict(odds_fetched_at=dt.datetime(2025, 4, 17, 16)), "stale_quote", "240 min old"),
    (dict(best_price_home=None), "no_executable_price", ""), (dict(consensus_price_home=None), "no_executable_price", ""),
    (dict(best_price_home=130.0, consensus_price_home=-130.0), "execution_deviation", "0.1304 > 0.08"),
    (dict(market_spread=0.3), None, "")])
def test_gates(spark, change, gate, detail):
    row = L.screen(card(spark, change), now()).first()
    assert (row.gate, row.detail) == (gate, detail)


def test_locked_comes_first_and_ids_are_stable(spark):
    seen = L.screen(card(spark, {}, dict(disagreement=0.0)), now(), spark.createDataFrame([("1|h2h||home",)], "wager_id string"))
    got = {r.wager_id: r.gate for r in seen.collect()}
    assert got == {"1|h2h||home": "already_locked", "1|h2h||away": "below_edge_rule"}


def test_day_cap_takes_the_widest(spark):
    gaps = [dict(game_pk=i, disagreement=0.05 + i / 100) for i in range(6)]
    seen = L.screen(card(spark, *gaps), now())
    taken = L.wagers(seen, now())
    assert sorted(r.game_pk for r in taken.collect()) == [3, 4, 5]
    rejected = L.rejections(seen, now())
    assert {r.gate for r in rejected.collect()} == {"day_cap"} and rejected.first().detail == "2025-04-17 at 3u"
    assert taken.columns == [f.split()[0] for f in DDL["ledger"].split(", ")]
    assert {r.gate: r.n for r in L.rejections_by_gate(rejected).collect()} == {"day_cap": 3}


def test_prior_stake_counts_and_days_are_apart(spark):
    rows = card(spark, {}, dict(game_pk=2), dict(game_pk=3, official_date=dt.date(2025, 4, 18)))
    ledger = spark.createDataFrame([("2025-04-17", "1.0"), ("2025-04-17", "1.0"), ("2025-04-17", "x"), ("", "5")],
                                   "official_date string, stake string")
    prior = L.staked_by_day(ledger).withColumn("official_date", F.col("official_date").cast("date"))
    seen = L.screen(rows, now(), prior=prior)
    assert sorted(r.game_pk for r in seen.where("gate is null").collect()) == [1, 3]


def ledger(spark, *changes):
    base = dict(wager_id="w", game_pk=1, market="h2h", side="home", price=150.0, stake=1.0, official_date=dt.date(2025, 4, 17),
                home_team="H", away_team="A", model_prob=0.6, market_prob=0.5, disagreement=0.1, market_books=9, lead_minutes=30, book="x")
    names = [f.split()[0] for f in DDL["ledger"].split(", ")]
    return spark.createDataFrame([tuple(dict(base, **c).get(n) for n in names) for c in changes], DDL["ledger"])


GAMES = "game_pk bigint, home_score int, away_score int"


def test_settlement_and_summary(spark):
    book = ledger(spark, dict(wager_id="a"), dict(wager_id="b", side="away", price=-200.0), dict(wager_id="c", game_pk=2),
                  dict(wager_id="d", game_pk=3), dict(wager_id="e", outcome="win", profit=9.0),
                  dict(wager_id="f", market="totals", point=9.0), dict(wager_id="g", outcome=" "))
    games = spark.createDataFrame([(1, 5, 4), (2, None, None)], GAMES)
    done = L.settle(book, games, now())
    got = {r.wager_id: (r.outcome, r.profit) for r in done.collect()}
    assert got == {"a": ("win", 1.5), "b": ("loss", -1.0), "c": (None, None), "d": (None, None), "e": ("win", 9.0),
                   "f": ("push", 0.0), "g": ("win", 1.5)}
    assert done.columns == book.columns
    again = L.settle(done, spark.createDataFrame([(1, 0, 4)], GAMES), now())
    assert {r.wager_id: r.outcome for r in again.collect()} == {k: v[0] for k, v in got.items()}
    total = L.summarise(done).where("market is null").first()
    assert (total.wagers, total.open, total.settled, total.win, total.loss, total.push) == (7, 2, 5, 3, 1, 1)
    assert total.units_profit == 11.0 and total.roi == 2.2
    empty = L.summarise(ledger(spark, {}).where("false"))
    assert empty.count() <= 1
    assert serving.settled_rows(done).count() == 5


def test_board(spark):
    rows = card(spark, {}, dict(market="totals", point=8.5, disagreement=-0.06, model_prob_home=0.44, market_prob_home=0.5),
                dict(market="spreads", point=-1.5, model_prob_home=0.45, market_prob_home=0.5, disagreement=-0.05),
                dict(game_pk=9, model_prob_home=None))
    book = ledger(spark, dict(market_books=3, disagreement=0.2))
    gates = spark.createDataFrame([(1, "totals", 8.5, "below_edge_rule", 1), (1, "totals", 8.5, "day_cap", 2), (1, "h2h", None, "already_locked", 1)],
                                  "game_pk bigint, market string, point double, gate string, n int")
    got = {r.market: r for r in serving.in_reading_order(serving.build_board(rows, book, L.latest_gate(gates, "n"))).collect()}
    assert list(got) == ["h2h", "totals", "spreads"]
    assert got["h2h"].bet == 1 and got["h2h"].books == 3 and got["h2h"].gap == 20.0 and got["h2h"].pick == "H ML"
    assert got["h2h"].price == 150.0 and got["h2h"].runs == "4.00-4.50"
    assert got["totals"].pick == "Under 8.5" and got["totals"].reason == "day cap" and got["totals"].model == 56.0
    assert got["spreads"].pick == "A +1.5" and got["spreads"].reason == "not taken"
    report = spark.createDataFrame([("h2h", -0.01), ("totals", 0.01), ("spreads", None)], "market string, ci_high double")
    credits = spark.createDataFrame([(dt.datetime(2025, 1, 1), 90), (dt.datetime(2025, 1, 2), 60)], "fetched_at timestamp, credits_remaining int")
    head = serving.headline(book, report, credits, rows).first()
    assert (head.wagers, head.settled, head.markets_beaten, head.board_rows, head.credits_remaining) == (1, 0, 1, 4, 60)


def test_largest(spark):
    rows = card(spark, *[dict(game_pk=i, disagreement=(-1) ** i * i / 100) for i in range(12)])
    assert [r.game_pk for r in serving.largest(rows, 3).collect()] == [11, 10, 9]
    assert conform(rows, "card").columns == [f.split()[0] for f in DDL["card"].split(", ")]
