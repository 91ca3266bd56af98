"""Two-sided quotes, de-vigged consensus, entry and close prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators.dedup import keep_best
from fungo.operators.quantiles import quantiles
from fungo.session import cut_lineage


def with_side(outcomes: DataFrame) -> DataFrame:
    """Add ``side`` and the home-oriented ``point`` to raw outcomes.

    Totals call Over the home side. The away half of a run line carries the
    negated point, so both halves meet on the home one.
    """
    by_team = F.when(F.col("name") == F.col("home_team"), "home").when(
        F.col("name") == F.col("away_team"), "away")
    by_total = F.when(F.col("name") == "Over", "home").when(F.col("name") == "Under", "away")
    side = F.when(F.col("market").isin("h2h", "spreads"), by_team).when(
        F.col("market") == "totals", by_total)
    # Adding zero folds -0.0 into 0.0, which would otherwise be spelled apart.
    point = (F.when(F.col("market") == "h2h", F.lit(None).cast("double"))
             .when((F.col("market") == "spreads") & (side == "away"), -F.col("point"))
             .otherwise(F.col("point"))) + F.lit(0.0)
    return outcomes.withColumn("side", side).withColumn("point", point).where(
        F.col("side").isNotNull())


def pair_sides(sided: DataFrame, keys: list[str], carry: list[str], ordinal: str) -> DataFrame:
    """One row per key with both prices and the de-vigged home probability.

    The last price of a side wins; a key showing one side is dropped.
    """
    at = F.col(ordinal)

    def price(side):
        return F.max_by(F.col("price"), F.when(F.col("side") == side, at))

    def usable(column):
        return S.usable_price(F.col(column))

    return (sided.groupBy(*keys)
            .agg(price("home").alias("price_home"), price("away").alias("price_away"),
                 *[F.min_by(c, at).alias(c) for c in carry], F.min(at).alias(ordinal))
            .withColumns({"price_home": S.number(F.col("price_home")),
                          "price_away": S.number(F.col("price_away"))})
            .where(usable("price_home") & usable("price_away"))
            .withColumn("devig_prob_home", S.devig(F.col("price_home"), F.col("price_away"))))


def paired_book_quotes(outcomes: DataFrame) -> DataFrame:
    """Outcome rows of landed odds to paired quotes."""
    sided = with_side(outcomes.where(F.col("market").isin(*C.MARKETS)))
    paired = pair_sides(
        sided, ["event_id", "region", "book_key", "market", "point"],
        ["commence_time", "home_team", "away_team", "book_title", "book_updated_at", "fetched_at"],
        "ordinal")
    return paired.withColumn("priced", F.col("region").isin(*C.PRICED_REGIONS).cast("int"))


def merge_regions(paired: DataFrame) -> DataFrame:
    """One quote per (event, book, market, point); priced regions win."""
    return keep_best(paired, ["event_id", "book_key", "market", "point"],
                     [F.col("priced")], "ordinal")


def quote_log(paired: DataFrame) -> DataFrame:
    ident = S.quote_id(*[F.col(c) for c in (
        "fetched_at", "event_id", "region", "book_key", "market", "point",
        "price_home", "price_away", "book_updated_at")])
    return paired.withColumn("snapshot_id", ident).withColumn("date", F.to_date("commence_time"))


def priced_quotes(paired: DataFrame) -> DataFrame:
    return paired.where(F.coalesce(F.col("region"), F.lit("us")).isin(*C.PRICED_REGIONS))


def consensus_lines(quotes: DataFrame, keys=("event_id", "market", "point"),
                    ordinal: str = "ordinal", leaders=C.LEADER_BOOKS) -> DataFrame:
    """One consensus row per (event, market, point) with at least one priced quote.

    Leaders are read from every region, followers from priced non-leaders.
    """
    priced = F.coalesce(F.col("region"), F.lit("us")).isin(*C.PRICED_REGIONS)
    leader = F.col("book_key").isin(*leaders)
    prob = F.col("devig_prob_home")
    follower = priced & ~leader

    def best(side):
        price = F.when(priced, F.col(f"price_{side}"))
        return {f"best_price_{side}": F.max(price),
                f"best_book_{side}": F.max_by("book_title", F.when(
                    priced, F.struct(price.alias("p"), (-F.col(ordinal)).alias("o"))))}

    specs = {
        "consensus_prob_home": (F.when(priced, prob), "median"),
        "consensus_price_home": (F.when(priced, F.col("price_home")), "upper"),
        "consensus_price_away": (F.when(priced, F.col("price_away")), "upper"),
        "leader_prob_home": (F.when(leader, prob), "median"),
        "follower_prob_home": (F.when(follower, prob), "median"),
    }
    extras = {
        "market_books": F.count_if(priced),
        "market_spread": F.max(F.when(priced, prob)) - F.min(F.when(priced, prob)),
        **best("home"), **best("away"),
        "leader_books": F.count_if(leader), "follower_books": F.count_if(follower),
    }
    out = quantiles(quotes, list(keys), specs, extras).where(F.col("market_books") > 0)
    rounded = ("consensus_prob_home", "market_spread", "leader_prob_home", "follower_prob_home")
    return out.withColumns({c: F.round(c, 8) for c in rounded})


def before_start(quotes: DataFrame) -> DataFrame:
    """Quotes taken strictly before the start, with their lead in hours."""
    return (quotes.withColumns({"commence": F.col("commence_time").try_cast("timestamp"),
                                "taken": F.col("fetched_at").try_cast("timestamp")})
            .where(F.col("taken") < F.col("commence"))
            .withColumn("lead_hours", S.hours_between(F.col("commence"), F.col("taken"))))


def first_per_event(quotes: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    return quotes.groupBy("event_id").agg(*[F.min_by(c, ordinal).alias(c) for c in columns])


def entry_close(quotes: DataFrame, min_books: int = C.MIN_BOOKS,
                entry_hours: float = C.MIN_ENTRY_HOURS, lines=C.USUAL_LINES) -> DataFrame:
    """Entry and close consensus per event and usual line.

    Entry is the earliest snapshot at least ``entry_hours`` before the start,
    close the latest before it. Only quotes struck at exactly those instants
    count. A price from too few books is nulled; a line with neither is dropped.
    Expects the output of ``before_start``.
    """
    early = F.col("lead_hours") >= entry_hours
    instants = quotes.groupBy("event_id").agg(
        F.min(F.when(early, F.col("taken"))).alias("entry_at"), F.max("taken").alias("close_at"),
        F.max(F.when(early, F.col("lead_hours"))).alias("entry_lead"),
        F.min("lead_hours").alias("close_lead"))
    line = F.coalesce(*[
        F.when((F.col("market") == m) & (F.lit(True) if p is None else
                                         S.close_to(F.col("point"), F.lit(float(p)))), i)
        for i, (m, p) in enumerate(lines)])
    # Filter to the usual lines first, so the join carries only what is used.
    at = quotes.select("event_id", "taken", "book_key", "devig_prob_home",
                       line.alias("line")).where(F.col("line").isNotNull())
    hit = at.join(instants, "event_id")
    entry = F.col("taken").eqNullSafe(F.col("entry_at"))
    close = F.col("taken") == F.col("close_at")
    # Only the quotes of two instants per event are left; written once, as they
    # are counted before they are ranked.
    hit = cut_lineage(hit.where(entry | close))
    books = quantiles(
        hit, ["event_id", "line"],
        {"entry_prob": (F.when(entry, F.col("devig_prob_home")), "median"),
         "close_prob": (F.when(close, F.col("devig_prob_home")), "median")},
        {"entry_books": F.countDistinct(F.when(entry, F.col("book_key"))),
         "close_books": F.countDistinct(F.when(close, F.col("book_key"))),
         "entry_lead_hours": F.round(F.first("entry_lead"), 2),
         "close_lead_hours": F.round(F.first("close_lead"), 2)})
    books = books.where((F.col("entry_books") >= min_books) | (F.col("close_books") >= min_books))
    markets = F.array(*[F.lit(m) for m, _ in lines])
    points = F.array(*[F.lit(p).cast("double") for _, p in lines])
    return books.select(
        "event_id", F.element_at(markets, F.col("line") + 1).alias("market"),
        F.element_at(points, F.col("line") + 1).alias("point"),
        F.when(F.col("entry_books") >= min_books, F.col("entry_prob")).alias("entry_prob"),
        "entry_books", "entry_lead_hours",
        F.when(F.col("close_books") >= min_books, F.col("close_prob")).alias("close_prob"),
        "close_books", "close_lead_hours")


def coverage(quotes: DataFrame, unmatched: DataFrame, priced: DataFrame,
             min_books: int = C.MIN_BOOKS) -> DataFrame:
    """One row: events, unmatched events, priced lines, median leads."""
    leads = quantiles(priced, [], {
        "median_entry_lead_hours": (F.col("entry_lead_hours"), "median"),
        "median_close_lead_hours": (F.col("close_lead_hours"), "median")},
        {"priced_game_markets": F.count(F.lit(1)),
         "with_entry": F.count_if(F.col("entry_books") >= min_books),
         "with_close": F.count_if(F.col("close_books") >= min_books)})
    events = quotes.agg(F.countDistinct("event_id").alias("v")).scalar()
    missing = unmatched.agg(F.count(F.lit(1)).alias("v")).scalar()
    return leads.select(
        events.alias("odds_events"), missing.alias("unmatched_events"),
        "priced_game_markets", "with_entry", "with_close",
        F.round("median_entry_lead_hours", 2).alias("median_entry_lead_hours"),
        F.round("median_close_lead_hours", 2).alias("median_close_lead_hours"))


def overround(quotes: DataFrame) -> DataFrame:
    """Median of the two implied probabilities' excess over one, in per cent."""
    vig = (S.american_to_prob(F.col("price_home")) + S.american_to_prob(F.col("price_away")) - 1.0)
    out = quantiles(quotes.where(F.col("price_home").isNotNull() & F.col("price_away").isNotNull()),
                    [], {"m": (vig, "median")}, {"quotes": F.count(F.lit(1))})
    return out.select("quotes", F.round(F.col("m") * 100.0, 2).alias("measured_overround_pct"))
