import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fungo.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x, kind="double"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize("speed,direction,azimuth,out,across", [
    (10, 180, 0, 10, 0), (10, 0, 0, -10, 0), (10, 270, 0, 0, 10)])
def test_wind(spark, speed, direction, azimuth, out, across):
    a, b = S.wind_components(lit(speed), lit(direction), lit(azimuth))
    assert value(spark, a) == pytest.approx(out, abs=1e-9)
    assert value(spark, b) == pytest.approx(across, abs=1e-9)
    assert value(spark, S.wind_components(lit(10), lit(None), lit(0))[0]) is None


@pytest.mark.parametrize("roof,kind", [("Dome", "dome"), (" Retractable ", "retractable"), ("Open", "open"), (None, "open")])
def test_roofs(spark, roof, kind):
    assert value(spark, S.roof_category(lit(roof, "string"))) == kind


@pytest.mark.parametrize("raw,key", [("3313.0", "3313"), (" 15 ", "15"), ("15.5", "15.5"), ("100", "100")])
def test_id_key(spark, raw, key):
    assert value(spark, S.id_key(F.lit(raw))) == key


@pytest.mark.parametrize("odds,p", [(-110, 110 / 210), (150, 0.4), (100, 0.5), (-100, 0.5)])
def test_odds(spark, odds, p):
    assert value(spark, S.american_to_prob(lit(odds))) == pytest.approx(p)


@pytest.mark.parametrize("price,gain", [(150, 1.5), (-200, 0.5)])
def test_payout(spark, price, gain):
    assert value(spark, S.payout(lit(price), lit(1))) == pytest.approx(gain)


@pytest.mark.parametrize("name,key", [
    ("Oakland Athletics", "athletics"), ("Cleveland Indians", "cleveland guardians"),
    ("St. Louis  Cardinals", "st louis cardinals"), ("Athletics", "athletics")])
def test_team_key(spark, name, key):
    assert value(spark, S.team_key(F.lit(name))) == key


@pytest.mark.parametrize("market,side,point,h,a,result", [
    ("h2h", "home", None, 3, 2, "win"), ("h2h", "away", None, 3, 2, "loss"),
    ("spreads", "home", -1.5, 3, 2, "loss"), ("spreads", "away", -1.5, 3, 2, "win"),
    ("spreads", "home", -1.0, 3, 2, "push"), ("totals", "home", 9.0, 4, 5, "push"),
    ("totals", "home", 8.5, 4, 5, "win"), ("totals", "away", 8.5, 4, 5, "loss"),
    ("other", "home", None, 4, 5, None), ("h2h", "home", None, None, None, None)])
def test_outcome(spark, market, side, point, h, a, result):
    got = S.outcome(F.lit(market), F.lit(side), lit(point), lit(h, "int"), lit(a, "int"))
    assert value(spark, got) == result


def test_future_is_strict_and_tolerant(spark):
    now = F.lit("2025-04-17T02:00:00Z").cast("timestamp")
    assert value(spark, S.is_future(F.lit("2025-04-17T02:10:00Z"), now)) is True
    assert value(spark, S.is_future(F.lit("2025-04-17T02:00:00Z"), now)) is False
    assert value(spark, S.is_future(F.lit("soon"), now)) is False
    assert value(spark, S.is_future(F.lit(None).cast("string"), now)) is False


def test_push_is_removed(spark):
    assert value(spark, S.push_adjusted(lit(0.45), lit(0.10))) == pytest.approx(0.5)
    assert value(spark, S.push_adjusted(lit(0.45), lit(None))) == pytest.approx(0.45)


def test_air(spark):
    def dry(t, p, h):
        return value(spark, S.air_density_index(lit(t), lit(p), lit(h)))
    assert dry(15.0, 1013.25, 0.0) == pytest.approx(1.0, abs=1e-4)
    assert dry(30.0, 1013.25, 0.0) > 1.0 and dry(15.0, 840.0, 0.0) > 1.15
    assert dry(30.0, 1013.25, 90.0) > dry(30.0, 1013.25, 0.0)
    assert dry(None, 1013.0, 10.0) is None
    assert value(spark, S.feet_to_metres(F.lit("5190"))) == pytest.approx(1581.91)


def test_labels(spark):
    def label(m, s, p):
        return value(spark, S.side_label(F.lit(m), F.lit(s), F.lit("H"), F.lit("A"), lit(p)))
    assert label("h2h", "away", None) == "A ML"
    assert label("spreads", "home", -1.5) == "H -1.5" and label("spreads", "away", -1.5) == "A +1.5"
    assert label("totals", "home", 8.5) == "Over 8.5" and label("totals", "away", 9.0) == "Under 9"
    assert value(spark, S.market_label(F.lit("totals"), lit(8.0))) == "total 8"
    assert value(spark, S.gate_label(F.lit("day_cap"))) == "day cap"


def test_keys_and_numbers(spark):
    wid = S.wager_id(F.lit(7), F.lit("h2h"), lit(None), F.lit("away"))
    assert value(spark, wid) == "7|h2h||away"
    assert value(spark, S.wager_id(F.lit(7), F.lit("spreads"), lit(-1.5), F.lit("home"))) == "7|spreads|-1.5|home"
    assert value(spark, S.number(F.lit(""))) is None and value(spark, S.number(F.lit("nan"))) is None
    assert value(spark, S.number(F.lit("4.5"))) == 4.5
    assert value(spark, S.unset(F.lit(" "))) and not value(spark, S.unset(F.lit("win")))
    assert value(spark, S.close_to(lit(8.5), lit(8.50000001))) and not value(spark, S.close_to(lit(8.5), lit(8.51)))
    a = S.quote_id(F.lit("x"), F.lit(None).cast("string"), F.lit("y"))
    b = S.quote_id(F.lit("x"), F.lit("y"), F.lit(None).cast("string"))
    assert len(value(spark, a)) == 20 and value(spark, a) != value(spark, b)
    lead = S.lead_minutes(F.lit("2025-01-01 01:00:30").cast("timestamp"), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    assert value(spark, lead) == 60
    assert value(spark, S.rest_days(F.lit(dt.date(2025, 1, 1)), F.lit(dt.date(2025, 2, 1)), 10)) == 10


def test_verdict(spark):
    assert value(spark, S.verdict(lit(0.1), lit(0.2))).startswith("market better")
    assert value(spark, S.verdict(lit(-0.2), lit(-0.1))).startswith("model better")
    assert value(spark, S.verdict(lit(-0.1), lit(0.1))).startswith("undecided")
    assert value(spark, S.verdict(lit(None), lit(None))).startswith("insufficient")


def test_log_loss_is_clipped(spark):
    assert value(spark, S.log_loss_term(lit(1.0), lit(0.0))) == pytest.approx(-math.log(1e-9), rel=1e-6)
