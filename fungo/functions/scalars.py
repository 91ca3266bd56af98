"""Column expressions: odds, geometry, air, labels, keys."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fungo import config as C

C_ = F.col


def american_to_prob(odds: Column) -> Column:
    o = odds.cast("double")
    return F.when(o < 0, -o / (-o + 100.0)).otherwise(100.0 / (o + 100.0))


def payout(price: Column, stake: Column) -> Column:
    p = price.cast("double")
    return stake * F.when(p > 0, p / 100.0).otherwise(100.0 / -p)


def devig(home: Column, away: Column) -> Column:
    ph, pa = american_to_prob(home), american_to_prob(away)
    return ph / (ph + pa)


def usable_price(price: Column) -> Column:
    return F.coalesce(F.abs(price) >= 100, F.lit(False))


def wind_components(speed: Column, direction: Column, azimuth: Column) -> tuple[Column, Column]:
    """(out to centre, left to right); the direction names where wind comes from."""
    angle = F.radians(F.pmod(direction + 180.0, F.lit(360.0)) - azimuth)
    return speed * F.cos(angle), speed * F.sin(angle)


def roof_category(roof: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(roof, F.lit(""))))
    return (F.when(r == "dome", "dome").when(r.startswith("retract"), "retractable")
            .otherwise("open"))


def roof_seen_closed(condition: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(condition, F.lit(""))))
    return c.isin("dome", "roof closed").cast("int")


def air_density_index(temp_c: Column, pressure_hpa: Column, humidity_pct: Column) -> Column:
    """Sea-level standard density over moist-air density; above 1 carries further."""
    kelvin = temp_c + 273.15
    pascal = pressure_hpa * 100.0
    saturated = 610.78 * F.exp(17.27 * temp_c / (temp_c + 237.3))
    vapour = F.coalesce(humidity_pct, F.lit(0.0)) / 100.0 * saturated
    density = (pascal - vapour) / (287.058 * kelvin) + vapour / (461.495 * kelvin)
    standard = 101325.0 / (287.058 * 288.15)
    return F.when(density > 0, F.round(standard / density, 5))


def feet_to_metres(feet: Column) -> Column:
    return F.round(feet.try_cast("double") * 0.3048, 2)


def number(text: Column) -> Column:
    """Tolerant double: blanks, words and NaN become null."""
    d = text.try_cast("double")
    return F.when(~F.isnan(d), d)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def integer(text: Column) -> Column:
    return text.try_cast("int")


def utc_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def unset(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return value.isNull() | (text == "") | (F.lower(text) == "nan")


def id_key(value: Column) -> Column:
    """An id as trimmed text without a trailing '.0'; other decimals stay."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def team_key(name: Column) -> Column:
    """Comparable club name: letters and single spaces, known renames folded."""
    letters = F.trim(F.regexp_replace(F.lower(name), "[^a-z ]", ""))
    squeezed = F.regexp_replace(letters, r"\s+", " ")
    aliases = F.create_map(*[F.lit(x) for x in chain(*C.TEAM_ALIASES.items())])
    return F.coalesce(F.try_element_at(aliases, squeezed), squeezed)


def wager_id(game: Column, market: Column, point: Column, side: Column) -> Column:
    return F.concat_ws("|", game.cast("string"), market,
                       F.coalesce(point.cast("string"), F.lit("")), side)


def quote_id(*fields: Column) -> Column:
    """Twenty hex digits of the SHA-256 of the fields; nulls keep their place."""
    return F.substring(F.sha2(F.concat_ws("|", *[
        F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 20)


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def is_future(commence: Column, now: Column) -> Column:
    """Strictly ahead of ``now``; a missing or unreadable start is not."""
    return F.coalesce(commence.try_cast("timestamp") > now, F.lit(False))


def shrunk(total: Column, n: Column, prior: Column | float, weight: float) -> Column:
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (F.coalesce(total, F.lit(0.0)) + p * weight) / (F.coalesce(n, F.lit(0)) + weight)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def rest_days(last: Column, today: Column, cap: int, default: int = 5) -> Column:
    days = F.datediff(today, last)
    return F.when(last.isNull(), default).otherwise(clip(days, 0, cap)).cast("int")


def win_probability(elo_gap: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -elo_gap / 400.0))


def log_loss_term(p: Column, y: Column) -> Column:
    q = clip(p, 1e-9, 1 - 1e-9)
    return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def push_adjusted(p: Column, push: Column) -> Column:
    q = F.coalesce(push, F.lit(0.0))
    return F.when(q < 1.0, p / (1.0 - q)).otherwise(p)


def backed_side(gap: Column) -> Column:
    return F.when(gap > 0, "home").otherwise("away")


def oriented(gap: Column, home_value: Column) -> Column:
    return F.when(gap > 0, home_value).otherwise(1.0 - home_value)


def outcome(market: Column, side: Column, point: Column, home: Column, away: Column) -> Column:
    """win, loss or push of one wager; null for an unknown market."""
    margin, total = home - away, home + away
    lean = (F.when(market == "h2h", F.when(margin > 0, 1).when(margin <= 0, -1))
            .when(market == "spreads", F.signum(margin + point))
            .when(market == "totals", F.signum(total - point)))
    mine = F.when(side == "home", lean).otherwise(-lean)
    return F.when(mine == 0, "push").when(mine > 0, "win").when(mine < 0, "loss")


def verdict(low: Column, high: Column) -> Column:
    return (F.when(low.isNull(), "insufficient sample for an interval")
            .when(low > 0, "market better; interval excludes zero")
            .when(high < 0, "model better; interval excludes zero")
            .otherwise("undecided; interval spans zero"))


def lead_minutes(commence: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(commence) - F.unix_micros(now)) / 60e6).cast("int")


def hours_between(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / 3.6e9


def plain(number_: Column) -> Column:
    """A point without a trailing '.0'."""
    return F.regexp_replace(number_.cast("string"), r"\.0$", "")


def signed(number_: Column) -> Column:
    return F.concat(F.when(number_ < 0, "").otherwise("+"), plain(number_ + F.lit(0.0)))


def market_label(market: Column, point: Column) -> Column:
    return (F.when(market == "h2h", "moneyline").when(market == "spreads", "run line")
            .otherwise(F.concat(F.lit("total"), F.coalesce(F.concat(F.lit(" "), plain(point)),
                                                           F.lit("")))))


def side_label(market: Column, side: Column, home: Column, away: Column, point: Column) -> Column:
    p = F.coalesce(point, F.lit(0.0))
    at_home = side == "home"
    return (F.when(market == "h2h", F.concat(F.when(at_home, home).otherwise(away), F.lit(" ML")))
            .when(market == "spreads", F.when(at_home, F.concat_ws(" ", home, signed(p)))
                  .otherwise(F.concat_ws(" ", away, signed(F.lit(0.0) - p))))
            .when(market == "totals", F.concat(F.when(at_home, "Over ").otherwise("Under "), plain(p)))
            .otherwise(home))


# What a reader sees for each gate.
GATE_LABELS = {
    "below_edge_rule": "below rule", "too_few_books": "thin market",
    "outside_lock_window": "outside lock window", "stale_quote": "stale quote",
    "execution_deviation": "broken quote", "day_cap": "day cap",
    "already_locked": "already locked", "no_executable_price": "no price",
}


def gate_label(gate: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*GATE_LABELS.items())]), gate)


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
