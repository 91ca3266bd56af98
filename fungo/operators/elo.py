"""Ratings in which both sides of every match move together.

A rating depends on every earlier match of both sides, so it has no window
form, and rounds of a distributed fixed point grow with the matches of a side.
A competition is one ordered walk that holds one number per side; competitions
are walked in parallel. Sides of different competitions never meet, so
``league`` should name the competition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.session import parallel_parts

NEEDED = ["game_pk", "official_date", "season", "home_team_id", "away_team_id",
          "home_score", "away_score"]


def elo_ratings(games: DataFrame, league: str | None = None) -> DataFrame:
    """(game_pk, home_elo, away_elo) as they stood before each match."""
    return walk(games.select(*NEEDED, (F.col(league) if league else F.lit("all")).alias("league")))


def walk(games: DataFrame) -> DataFrame:
    ordered = (games.withColumn("season", F.col("season").cast("int"))
               .withColumns({c: S.id_key(F.col(c)) for c in ("home_team_id", "away_team_id")})
               .withColumns({c: F.col(c).cast("double") for c in ("home_score", "away_score")})
               .repartition(parallel_parts(games.sparkSession), "league")
               .sortWithinPartitions("league", "official_date", "game_pk")
               .select("league", *[c for c in NEEDED if c != "official_date"]))
    kind = games.schema["game_pk"].dataType.simpleString()
    return ordered.mapInPandas(_walk_batches, f"game_pk {kind}, home_elo double, away_elo double")


def _walk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    league, state = None, {}

    def enter(team, season):
        rating, last = state.get(team, (C.ELO_START, season))
        if season != last:
            rating = C.ELO_START + (rating - C.ELO_START) * C.ELO_CARRY
        state[team] = (rating, season)
        return rating

    for batch in batches:
        homes, aways = np.empty(len(batch)), np.empty(len(batch))
        for i, row in enumerate(zip(*[batch[c].tolist() for c in (
                "league", "season", "home_team_id", "away_team_id", "home_score", "away_score")])):
            lg, season, home, away, hs, as_ = row
            if lg != league:
                league, state = lg, {}
            rh, ra = enter(home, season), enter(away, season)
            homes[i], aways[i] = rh, ra
            if hs != hs or as_ != as_ or hs is None or as_ is None:
                continue
            expected = 1.0 / (1.0 + 10.0 ** (-(rh - ra + C.ELO_HOME_EDGE) / 400.0))
            move = C.ELO_K * np.log1p(abs(hs - as_)) * (float(hs > as_) - expected)
            state[home] = (state[home][0] + move, season)
            state[away] = (state[away][0] - move, season)
        yield pd.DataFrame({"game_pk": batch["game_pk"], "home_elo": homes, "away_elo": aways})
