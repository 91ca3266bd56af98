import os

import numpy as np
import pandas as pd
import pytest

from fungo import config as C
from fungo.operators import elo
from fungo.plans.features import build_features
from fungo.schemas import DDL
from tests import world


def expected_rows(games, lines, umps):
    """Every value from all earlier rows, one game at a time."""
    order = sorted(games, key=lambda g: (g["official_date"], g["game_pk"]))
    by_game = {}
    for line in lines:
        by_game.setdefault(line["game_pk"], []).append(line)
    ump_of = {u["game_pk"]: u["hp_umpire_id"] for u in umps}
    out = []
    for i, g in enumerate(order):
        past = [p for p in order[:i] if p["home_score"] is not None]
        row = {"game_pk": g["game_pk"]}
        past_lines = [(p, x) for p in past for x in by_game.get(p["game_pk"], [])]
        runs = [p["home_score"] + p["away_score"] for p in past]
        mean = sum(runs) / len(runs) if runs else 9.0
        kgames = [p for p in past if p["game_pk"] in by_game]
        kpg = sum(x["strike_outs"] for _, x in past_lines) / len(kgames) if len(kgames) >= 200 else 16.0
        seen = [x for _, x in past_lines]
        bats = sum(x["batters_faced"] for x in seen)
        lk, lb, lh = [sum(f(x) for x in seen) / bats if bats > 5000 else d for f, d in (
            (lambda x: x["strike_outs"], 0.225), (lambda x: x["walks"] + x["hit_batsmen"], 0.09),
            (lambda x: x["home_runs"], 0.033))]
        relief = [x for x in seen if not x["is_starter"]]
        louts = sum(x["outs"] for x in relief)
        lr = sum(x["runs"] for x in relief) / louts * 27 if louts >= 3000 else 4.2
        for s, o in (("home", "away"), ("away", "home")):
            t = g[f"{s}_team_id"]
            mine = [(p["home_score"], p["away_score"], p) if p["home_team_id"] == t else
                    (p["away_score"], p["home_score"], p) for p in past if t in (p["home_team_id"], p["away_team_id"])]
            season = [m for m in mine if m[2]["season"] == g["season"]]
            row[f"{s}_off"] = (sum(m[0] for m in season) + 180.0) / (len(season) + 40.0)
            row[f"{s}_def"] = (sum(m[1] for m in season) + 180.0) / (len(season) + 40.0)
            row[f"{s}_recent_off"] = np.mean([m[0] for m in season][-25:]) if season else 4.5
            row[f"{s}_recent_def"] = np.mean([m[1] for m in season][-25:]) if season else 4.5
            row[f"{s}_games_played"] = len(season)
            row[f"{s}_rest"] = min((g["official_date"] - mine[-1][2]["official_date"]).days, 10) if mine else 5
            sp = g[f"{s}_sp_id"]
            starts = [(p["away_score"] if p["home_sp_id"] == sp else p["home_score"], p) for p in past
                      if sp in (p["home_sp_id"], p["away_sp_id"])]
            row[f"{s}_sp_rate"] = (sum(a for a, _ in starts) + 45.0) / (len(starts) + 10.0)
            row[f"{s}_sp_recent"] = np.mean([a for a, _ in starts][-10:]) if starts else 4.5
            row[f"{s}_sp_starts"] = len(starts)
            row[f"{s}_sp_rest"] = min((g["official_date"] - starts[-1][1]["official_date"]).days, 15) if starts else 5
            own = [x for _, x in past_lines if x["is_starter"] and x["player_id"] == sp]
            bf = sum(x["batters_faced"] for x in own)
            row[f"{s}_sp_k_rate"] = (sum(x["strike_outs"] for x in own) + lk * 200) / (bf + 200)
            row[f"{s}_sp_bb_rate"] = (sum(x["walks"] + x["hit_batsmen"] for x in own) + lb * 200) / (bf + 200)
            row[f"{s}_sp_hr_rate"] = (sum(x["home_runs"] for x in own) + lh * 200) / (bf + 200)
            row[f"{s}_sp_depth"] = sum(x["outs"] for x in own) / len(own) if len(own) >= 2 else 16.0
            pen = [(p, x) for p, x in past_lines if not x["is_starter"] and x["team_id"] == t]
            row[f"{s}_bp_rate"] = (sum(x["runs"] for _, x in pen) + lr * 300 / 27) / (
                sum(x["outs"] for _, x in pen) + 300) * 27
            row[f"{s}_bp_workload"] = sum(x["outs"] for p, x in pen
                                          if (g["official_date"] - p["official_date"]).days < 3)
        there = [p["home_score"] + p["away_score"] for p in past if p["venue_id"] == g["venue_id"]]
        n = len(there)
        row["park_factor"] = 1.0 if n < 30 else 1 + (sum(there) / n / mean - 1) * n / (n + 120)
        u = ump_of.get(g["game_pk"])
        worked = [p for p in past if u is not None and ump_of.get(p["game_pk"]) == u]
        row["ump_run_rate"] = (sum(p["home_score"] + p["away_score"] for p in worked) + mean * 60) / (
            len(worked) + 60) - mean
        wk = [p for p in worked if p["game_pk"] in by_game]
        row["ump_k_rate"] = (sum(x["strike_outs"] for p in wk for x in by_game[p["game_pk"]]) + kpg * 60) / (
            len(wk) + 60) - kpg
        out.append(row)
    return pd.DataFrame(out).sort_values("game_pk").reset_index(drop=True)


@pytest.fixture(scope="module")
def built(spark):
    games = world.games(n=240, teams=5)
    lines, umps = world.pitching(games), world.umpires(games)
    df = features(spark, games, lines, umps)
    return games, lines, umps, world.collect(df, "game_pk")


def features(spark, games, lines, umps):
    parks = spark.createDataFrame([(str(i), 100.0 * i) for i in range(1, 7)], "venue_id string, elevation_m double")
    return build_features(world.frame(spark, games, world.GAME_DDL), parks, None,
                          world.frame(spark, lines, DDL["pitching"]), world.frame(spark, umps, DDL["umpires"]))


def test_matches_one_game_at_a_time(built):
    games, lines, umps, got = built
    want = expected_rows(games, lines, umps)
    for column in want.columns:
        np.testing.assert_allclose(got[column].astype(float), want[column].astype(float), atol=1e-9, err_msg=column)


def test_no_nulls_and_all_columns(built):
    got = built[3]
    assert not got[list(C.FEATURE_COLUMNS)].isna().any().any()
    assert len(got) == 240


def test_tampered_result_moves_only_later_rows(spark, built):
    games, lines, umps, before = built
    order = sorted(games, key=lambda g: (g["official_date"], g["game_pk"]))
    hit = next(g for g in order[40:] if g["home_score"] is not None)
    at = order.index(hit)
    changed = [dict(g, home_score=30, away_score=0) if g is hit else g for g in games]
    after = world.collect(features(spark, changed, lines, umps), "game_pk")
    early = {g["game_pk"] for g in order[:at + 1]}
    same = before["game_pk"].isin(early)
    pd.testing.assert_frame_equal(before[same], after[same])
    assert (before[~same]["home_elo"] - after[~same]["home_elo"]).abs().max() > 1e-6


def test_priors_without_inputs(spark):
    games = world.games(n=30)
    df = build_features(world.frame(spark, games, world.GAME_DDL),
                        spark.createDataFrame([], "venue_id string, elevation_m double"))
    got = world.collect(df, "game_pk")
    assert (got["home_sp_depth"] == 16.0).all() and (got["temp_c"] == 20.0).all()
    assert (got["air_density_index"] == 1.0).all() and np.allclose(got["home_bp_rate"], 4.2)
    assert np.allclose(got["ump_run_rate"], 0.0)


def test_elo_walk_equals_one_game_at_a_time(spark):
    games = world.games(n=90, teams=5, seed=5)
    df = world.frame(spark, games, world.GAME_DDL)
    walked = world.collect(elo.elo_ratings(df), "game_pk")
    state = {}
    for g in sorted(games, key=lambda g: (g["official_date"], g["game_pk"])):
        seen = []
        for t in (g["home_team_id"], g["away_team_id"]):
            r, s = state.get(t, (1500.0, g["season"]))
            r = r if s == g["season"] else 1500 + (r - 1500) * 0.7
            state[t] = (r, g["season"])
            seen.append(r)
        row = walked[walked.game_pk == g["game_pk"]].iloc[0]
        assert abs(row.home_elo - seen[0]) < 1e-9 and abs(row.away_elo - seen[1]) < 1e-9
        if g["home_score"] is None:
            continue
        e = 1 / (1 + 10 ** (-(seen[0] - seen[1] + 24) / 400))
        d = 4 * np.log1p(abs(g["home_score"] - g["away_score"])) * ((g["home_score"] > g["away_score"]) - e)
        state[g["home_team_id"]] = (seen[0] + d, g["season"])
        state[g["away_team_id"]] = (seen[1] - d, g["season"])


def test_games_without_date_or_team_keep_their_row(spark):
    games = world.games(n=20)
    games[3]["official_date"] = None
    games[5]["home_team_id"] = None
    got = world.collect(build_features(world.frame(spark, games, world.GAME_DDL),
                                       spark.createDataFrame([], "venue_id string, elevation_m double")), "game_pk")
    assert len(got) == 20
    odd = got[got["game_pk"].isin([games[3]["game_pk"], games[5]["game_pk"]])]
    assert not odd[["home_off", "away_def", "park_factor", "elo_diff", "home_rest"]].isna().any().any()


def test_last_weather_and_umpire_win(spark):
    rows = [(1, 0, 9.0), (1, 2, 3.0), (1, 1, 5.0), (2, None, 1.0)]
    df = spark.createDataFrame(rows, "game_pk bigint, ordinal int, temp_c double")
    from fungo.plans.features import last_row
    assert {(r.game_pk, r.temp_c) for r in last_row(df, ["temp_c"]).collect()} == {(1, 3.0), (2, 1.0)}


def test_frame_is_dealt_by_the_number_of_games(spark, monkeypatch):
    from fungo import session
    parts = session.parallel_parts(spark)
    games = world.games(n=4 * (parts + 3))
    parks = spark.createDataFrame([("1", 10.0)], "venue_id string, elevation_m double")
    table = world.frame(spark, games, DDL["games"])
    plain = {r["game_pk"]: r for r in build_features(table, parks).collect()}
    monkeypatch.setattr(session, "TASK_ROWS", 4)
    out = build_features(table, parks)
    assert {r["game_pk"]: r for r in out.collect()} == plain
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_frame_keeps_only_what_it_joins_and_joins_it_as_it_lies(spark):
    from fungo import session
    games = world.games(n=40)
    session.checkpoint_ready(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    setting = spark.conf.get(session.SHUFFLES_GO)
    before = set(os.listdir(folder))
    out = features(spark, games, world.pitching(games), world.umpires(games))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Only the list of games is shuffled: the states lie in buckets by game.
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 8
    # Of what the states are computed from nothing is left.
    read = {os.path.basename(os.path.dirname(f)) for f in out.inputFiles()}
    assert set(os.listdir(folder)) - before == read and len(read) == 9
    assert spark.conf.get(session.SHUFFLES_GO) == setting and not spark.catalog.listTables()
    assert out.count() == 40


def test_columns_are_finished_between_the_joins(spark):
    """All of them in one projection would make a method that the JVM does not compile."""
    games = world.games(n=25)
    table, parks = world.frame(spark, games, world.GAME_DDL), spark.createDataFrame([("1", 10.0)], "venue_id string, elevation_m double")
    plain = world.collect(build_features(table, parks), "game_pk")
    out = build_features(table, parks, finish=lambda k: k.cast("double") + 1.0)
    columns = [*C.FEATURE_COLUMNS, "ump_run_rate", "ump_k_rate"]
    assert (world.collect(out, "game_pk")[columns] == plain[columns].astype(float) + 1.0).all().all()
    top = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Project") and top.count("+ 1.0") < 15
