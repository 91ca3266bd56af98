import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fungo.operators import quotes as Q
from fungo.operators.quantiles import quantiles

OUT = ("event_id string, commence_time string, home_team string, away_team string, region string, fetched_at string, "
       "book_key string, book_title string, book_updated_at string, market string, name string, price double, "
       "point double, ordinal bigint")


def outcomes(spark, rows):
    full = [("e", "2025-04-17T23:00:00Z", "H", "A", r[0], "2025-04-17T12:00:00Z", r[1], r[1].upper(), "u", *r[2:], i)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, OUT)


def test_paired_totals_and_run_line(spark):
    rows = [("us", "b", "totals", "Over", -110.0, 8.5), ("us", "b", "totals", "Under", -110.0, 8.5),
            ("us", "b", "totals", "Over", 120.0, 9.5), ("us", "b", "totals", "Under", -140.0, 9.5),
            ("us", "b", "spreads", "H", 130.0, -1.5), ("us", "b", "spreads", "A", -150.0, 1.5),
            ("us", "b", "h2h", "H", -120.0, None), ("us", "c", "h2h", "A", 110.0, None),
            ("us", "d", "h2h", "H", 50.0, None), ("us", "d", "h2h", "A", 110.0, None),
            ("us", "d", "odd", "A", 110.0, None), ("us", "d", "h2h", "X", 110.0, None)]
    got = {(r.market, r.point): r for r in Q.paired_book_quotes(outcomes(spark, rows)).collect()}
    assert set(got) == {("totals", 8.5), ("totals", 9.5), ("spreads", -1.5)}
    assert got[("totals", 8.5)].devig_prob_home == pytest.approx(0.5)
    assert got[("spreads", -1.5)].price_away == -150.0 and got[("spreads", -1.5)].priced == 1


def test_last_price_of_a_side_wins(spark):
    rows = [("us", "b", "h2h", "H", -120.0, None), ("us", "b", "h2h", "A", 110.0, None), ("us", "b", "h2h", "H", -130.0, None)]
    assert Q.paired_book_quotes(outcomes(spark, rows)).first().price_home == -130.0


def test_unpriced_region_moves_leaders_only(spark):
    def book(region, key, home, away):
        return [(region, key, "h2h", "H", home, None), (region, key, "h2h", "A", away, None)]
    us = book("us", "x", -120.0, 110.0) + book("us", "y", -125.0, 115.0) + book("us", "lowvig", -118.0, 112.0)
    base = Q.consensus_lines(Q.merge_regions(Q.paired_book_quotes(outcomes(spark, us)))).first()
    both = Q.consensus_lines(Q.merge_regions(Q.paired_book_quotes(
        outcomes(spark, us + book("eu", "pinnacle", -400.0, 320.0) + book("eu", "x", -300.0, 240.0))))).first()
    assert both.consensus_prob_home == base.consensus_prob_home and both.market_books == 3
    assert base.leader_books == 1 and both.leader_books == 2 and both.follower_books == 2
    assert both.best_price_home == -118.0 and both.best_book_home == "LOWVIG"


def test_upper_median_of_prices(spark):
    def book(key, home):
        return [("us", key, "h2h", "H", home, None), ("us", key, "h2h", "A", -105.0, None)]
    rows = book("a", 100.0) + book("b", 110.0) + book("c", 120.0) + book("d", 130.0)
    line = Q.consensus_lines(Q.paired_book_quotes(outcomes(spark, rows))).first()
    assert line.consensus_price_home == 120.0


def test_only_unpriced_quotes_give_no_line(spark):
    rows = [("eu", "b", "h2h", "H", -120.0, None), ("eu", "b", "h2h", "A", 110.0, None)]
    assert Q.consensus_lines(Q.paired_book_quotes(outcomes(spark, rows))).count() == 0


def snapshots(spark, rows):
    ddl = "event_id string, commence_time string, fetched_at string, market string, point double, book_key string, devig_prob_home double"
    return Q.before_start(spark.createDataFrame(
        [("e", "2025-04-17T23:00:00Z", *r) for r in rows], ddl))


def test_thin_close_keeps_entry(spark):
    rows = [("2025-04-16T12:00:00Z", "h2h", None, b, 0.5 + i / 100) for i, b in enumerate("abc")]
    rows += [("2025-04-17T22:00:00Z", "h2h", None, "a", 0.6), ("2025-04-18T01:00:00Z", "h2h", None, "a", 0.9)]
    got = Q.entry_close(snapshots(spark, rows)).first()
    assert got.entry_prob == pytest.approx(0.51) and got.close_prob is None
    assert got.entry_books == 3 and got.close_books == 1
    assert got.entry_lead_hours == 35.0 and got.close_lead_hours == 1.0


def test_other_points_and_late_quotes_are_ignored(spark):
    rows = [("2025-04-17T22:00:00Z", "totals", 9.5, b, 0.5) for b in "abc"]
    rows += [("2025-04-17T22:00:00Z", "totals", 8.5, b, 0.4) for b in "abc"]
    rows += [("2025-04-17T23:00:00Z", "h2h", None, b, 0.4) for b in "abc"]
    got = Q.entry_close(snapshots(spark, rows)).collect()
    assert [(r.market, r.point, r.close_prob) for r in got] == [("totals", 8.5, 0.4)]
    assert got[0].entry_prob is None


def test_no_line_when_both_are_thin(spark):
    rows = [("2025-04-17T22:00:00Z", "h2h", None, "a", 0.5)]
    assert Q.entry_close(snapshots(spark, rows)).count() == 0


def test_quantiles_of_large_null_and_empty_groups(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 3.0, 3.0, 0.0, -0.0, 1e-300])) for k in ["hot"] * 3001 + ["warm"] * 400 + ["a", "a", "b"]]
    rows += [("hot", None), (None, 1.0), ("null", None), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    specs = {"m": (F.col("v"), "median"), "u": (F.col("v"), "upper"), "half": (F.when(F.col("v") > 0, F.col("v")), "median")}
    got = {r.k: r for r in quantiles(df, ["k"], specs, {"n": F.count("v")}).collect()}
    assert got.keys() == {"hot", "warm", "a", "b", None, "null"}
    assert (got["null"].m, got["null"].u, got["null"].half, got["null"].n) == (None, None, None, 0)
    for key in ("hot", "warm", "a", "b", None):
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key].m == pytest.approx(statistics.median(values))
        assert got[key].u == values[len(values) // 2] and got[key].n == len(values)
    whole = quantiles(df, [], {"m": (F.col("v"), "median")}).first()
    assert whole.m == pytest.approx(statistics.median([v for _, v in rows if v is not None]))
    empty = quantiles(df.limit(0), [], {"m": (F.col("v"), "median")}, {"n": F.count("v")}).collect()
    assert [tuple(r) for r in empty] == [(None, 0)]
    assert quantiles(df.limit(0), ["k"], specs).count() == 0


def test_reports_have_a_row_for_empty_input(spark):
    none = spark.createDataFrame([], "price_home double, price_away double")
    assert tuple(Q.overround(none).first()) == (0, None)


def test_overround(spark):
    df = spark.createDataFrame([(-110.0, -110.0), (-110.0, -110.0), (None, -110.0)], "price_home double, price_away double")
    row = Q.overround(df).first()
    assert row.quotes == 2 and row.measured_overround_pct == pytest.approx(4.76)


@pytest.mark.parametrize("large,few", [(1000, 20), (10, 5), (10**9, 1)])
def test_quantiles_of_narrow_ranges_are_refined(spark, large, few):
    """Nearly all values of a group lie within a millionth: one slice of the first level holds them."""
    rng = np.random.default_rng(3)
    groups = {1: 0.5 + rng.random(4001) * 1e-6, 2: np.concatenate([rng.random(3000), [np.inf, -np.inf, 0.0, -0.0, 1e-320, -1e300]]),
              3: np.concatenate([rng.random(40), [np.nan] * 3000]), 4: np.array([0.25] * 1200 + [0.75] * 1200), 5: np.array([1.0, 2.0, 4.0]),
              None: 1 + rng.integers(0, 3, 2000) * 2.0**-52}
    df = spark.createDataFrame([(k, float(v), i) for k, vs in groups.items() for i, v in enumerate(vs)], "k int, v double, i int")
    specs = {"m": (F.col("v"), "median"), "u": (F.col("v"), "upper"), "x": (F.when(F.col("i") % 2 == 0, F.col("v")), "upper")}
    got = {r.k: r for r in quantiles(df, ["k"], specs, {"n": F.count(F.lit(1))}, large, few).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        o, x = np.sort(vs), np.sort(vs[::2])
        want = ((o[(len(o) - 1) // 2] + o[len(o) // 2]) / 2, o[len(o) // 2], x[len(x) // 2])
        assert got[k].n == len(vs) and np.array_equal([got[k].m, got[k].u, got[k].x], want, equal_nan=True)
    whole = quantiles(df, [], {"u": (F.col("v"), "upper")}, {}, large, few).first()
    every = np.sort(np.concatenate(list(groups.values())))
    assert whole.u == every[len(every) // 2]
