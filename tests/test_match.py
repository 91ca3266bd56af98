import datetime as dt
import random

import pytest

from fungo.operators.match import match_events, unmatched
from fungo.plans.comparison import matchable_events, matchable_games

EV = "event_id string, home_key string, away_key string, commence timestamp"
GM = "game_pk bigint, home_key string, away_key string, start timestamp"
T0 = dt.datetime(2025, 4, 17, 2, 10)


def run(spark, events, games, **kw):
    got = match_events(spark.createDataFrame(events, EV), spark.createDataFrame(games, GM), **kw)
    return {r.event_id: (int(r.game_pk) if r.game_pk else None) for r in got.collect()}


def test_late_start_matches_by_instant(spark):
    assert run(spark, [("e", "h", "a", T0)], [(1, "h", "a", T0 + dt.timedelta(minutes=5))]) == {"e": 1}


def test_doubleheader_and_single_claim(spark):
    later = T0 + dt.timedelta(hours=4)
    events = [("e2", "h", "a", later), ("e1", "h", "a", T0)]
    assert run(spark, events, [(1, "h", "a", T0), (2, "h", "a", later)]) == {"e1": 1, "e2": 2}
    assert run(spark, events, [(1, "h", "a", T0)]) == {"e1": 1, "e2": None}


def test_postponed_null_start_and_limit(spark):
    assert run(spark, [("e", "h", "a", T0)], [(1, "h", "a", T0 + dt.timedelta(hours=48)), (2, "h", "a", None)]) == {"e": None}
    assert run(spark, [("e", "h", "a", T0)], [(1, "h", "a", T0 + dt.timedelta(hours=12))]) == {"e": 1}
    assert run(spark, [("e", "h", "a", T0)], [(1, "a", "h", T0)]) == {"e": None}


@pytest.mark.parametrize("seed,span", [(1, 60), (2, 400), (3, 8)])
def test_same_as_walking_every_game(spark, seed, span):
    rng = random.Random(seed)

    def when():
        return T0 + dt.timedelta(minutes=rng.randint(0, span * 60))
    pairs = ["x"] * 6 + ["y", "z"]
    events = [(str(i), rng.choice(pairs), "a", when()) for i in range(150)]
    games = [(i, rng.choice(pairs), "a", when()) for i in range(120)]
    claimed, want = set(), {}
    for e in sorted(events, key=lambda e: (e[3], len(e[0]), e[0])):
        near = [(abs((g[3] - e[3]).total_seconds()), g[3], g[0]) for g in games
                if g[1] == e[1] and g[0] not in claimed and abs((g[3] - e[3]).total_seconds()) <= 12 * 3600]
        pick = min(near)[2] if near else None
        want[e[0]] = pick
        claimed.add(pick)
    assert run(spark, events, games) == want


@pytest.mark.parametrize("seed,minutes,block", [(1, 600, 60), (2, 60, 60), (3, 3000, 40)])
def test_a_dense_stretch_in_blocks_is_the_same_walk(spark, seed, minutes, block):
    """As many events as games, all within reach of each other or nearly: claims run over block ends and are passed on."""
    rng = random.Random(seed)

    def when():
        return T0 + dt.timedelta(seconds=rng.randint(0, minutes * 60))
    events = [(str(i), "x", "a", when()) for i in range(400)] + [(f"z{i}", "y", "a", when()) for i in range(90)]
    games = [(i, "x", "a", when()) for i in range(390)] + [(1000 + i, "y", "a", when()) for i in range(120)]
    assert run(spark, events, games, block=block) == run(spark, events, games)


def test_forgetting_changes_nothing():
    from fungo.operators import match as M
    rng = random.Random(8)
    kept, cut = M._Open(), M._Open()
    starts = sorted(rng.randint(0, 10**7) for _ in range(120_000))
    for k, s in enumerate(starts):
        kept.add(s, k)
        cut.add(s, k)
    for at in sorted(rng.randint(0, 10**7) for _ in range(60_000)):
        assert kept.take_nearest(at, 500) == cut.take_nearest(at, 500)
        cut.forget(at - 500)
    assert len(cut.starts) < len(kept.starts)


def test_names_meet_through_aliases(spark):
    quotes = spark.createDataFrame([("e", "Oakland Athletics", "Cleveland Indians", T0, 0)],
                                   "event_id string, home_team string, away_team string, commence timestamp, ordinal bigint")
    games = spark.createDataFrame([(5, "Athletics", "Cleveland Guardians", T0)],
                                  "game_pk bigint, home_team_name string, away_team_name string, game_date_utc timestamp")
    got = match_events(matchable_events(quotes), matchable_games(games))
    assert got.first().game_pk == "5" and unmatched(got).count() == 0
