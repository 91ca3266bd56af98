"""A small seeded league, as plain Python rows."""

import datetime as dt
import random

import pandas as pd


def games(n=120, teams=6, seed=1, unplayed=0.08, seasons=(2021, 2022)):
    rng = random.Random(seed)
    rows, day = [], dt.date(seasons[0], 4, 1)
    for i in range(n):
        if i == n // 2 and len(seasons) > 1:
            day = dt.date(seasons[1], 4, 1)
        if rng.random() < 0.35:
            day += dt.timedelta(days=rng.choice([1, 1, 1, 2, 5]))
        home, away = rng.sample(range(1, teams + 1), 2)
        hs, as_ = rng.randint(0, 9), rng.randint(0, 9)
        if hs == as_:
            hs += 1
        played = rng.random() > unplayed
        rows.append(dict(
            game_pk=1000 + i, official_date=day, season=day.year,
            game_date_utc=dt.datetime(day.year, day.month, day.day, 23, 10),
            home_team_id=home, away_team_id=away, home_team_name=f"Team {home}", away_team_name=f"Team {away}",
            home_sp_id=home * 10 + rng.randint(0, 2), away_sp_id=away * 10 + rng.randint(0, 2),
            venue_id=home, scheduled_innings=9, innings_played=9, home_batted_ninth=1,
            home_score=hs if played else None, away_score=as_ if played else None,
            home_win=int(hs > as_) if played else None, total_runs=hs + as_ if played else None,
            run_diff=hs - as_ if played else None))
    return rows


def pitching(games_, seed=2):
    rng = random.Random(seed)
    rows = []
    for g in games_:
        if g["home_score"] is None or rng.random() < 0.1:
            continue
        for team, sp in ((g["home_team_id"], g["home_sp_id"]), (g["away_team_id"], g["away_sp_id"])):
            actual = sp if rng.random() < 0.8 else team * 10 + rng.randint(0, 2)
            for k, player in enumerate([actual, 900 + team, 950 + team]):
                rows.append(dict(
                    game_pk=g["game_pk"], official_date=g["official_date"], team_id=team, player_id=player,
                    is_starter=int(k == 0), outs=rng.randint(0, 18), batters_faced=rng.randint(1, 27),
                    hits=1, runs=rng.randint(0, 4), earned_runs=0, home_runs=rng.randint(0, 2),
                    walks=rng.randint(0, 3), hit_batsmen=rng.randint(0, 1),
                    strike_outs=rng.randint(0, 9), pitches=10, strikes=5))
    return rows


def umpires(games_, seed=3):
    rng = random.Random(seed)
    return [dict(game_pk=g["game_pk"], official_date=g["official_date"],
                 hp_umpire_id=rng.randint(1, 4), hp_umpire_name="U") for g in games_ if rng.random() < 0.9]


GAME_DDL = ("game_pk bigint, official_date date, season int, game_date_utc timestamp, home_team_id bigint, "
            "away_team_id bigint, home_team_name string, away_team_name string, home_sp_id bigint, "
            "away_sp_id bigint, venue_id bigint, scheduled_innings int, innings_played int, "
            "home_batted_ninth int, home_score int, away_score int, home_win int, total_runs int, run_diff int")


def frame(spark, rows, ddl):
    names = [f.strip().split()[0] for f in ddl.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def collect(df, *keys):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns).sort_values(
        list(keys)).reset_index(drop=True)
