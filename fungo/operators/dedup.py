"""Keep one row per key, and keyed unions.

Every choice is a ``max_by`` / ``min_by`` aggregate, which combines before the
shuffle. A key with a huge number of copies costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: Sequence[str], rank: Sequence[Column],
              ordinal: str | None = None) -> DataFrame:
    """The row with the greatest rank per key; the earliest ordinal wins ties."""
    parts = [*rank, *([-F.col(ordinal)] if ordinal else [])]
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns]),
                    F.struct(*[p.alias(f"r{i}") for i, p in enumerate(parts)]))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        best.alias("_row")).select("_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return keep_best(df, keys, [-F.col(ordinal)])


def deduplicate_games(games: DataFrame, ordinal: str | None = None) -> DataFrame:
    """A postponed game is listed twice; keep the listing whose start agrees
    with its official date, then a played one, then the later start."""
    agrees = F.coalesce(F.to_date("game_date_utc") == F.col("official_date"), F.lit(False))
    start = F.coalesce(F.col("game_date_utc").cast("string"), F.lit(""))
    return keep_best(games, ["game_pk"],
                     [agrees, F.col("home_score").isNotNull(), start], ordinal)


def keyed_union(ours: DataFrame, theirs: DataFrame, key: Sequence[str],
                ordinal: str | None = None) -> DataFrame:
    """Union of two logs on ``key``. Our row replaces theirs as a whole; inside
    one log the last row wins; columns of both survive."""
    both = theirs.withColumn("_src", F.lit(0)).unionByName(
        ours.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    marks = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    both = both.withColumns({f"_u{i}": m for i, m in enumerate(marks)})
    rank = [F.col("_src"), *([F.col(ordinal)] if ordinal else [])]
    return keep_best(both, [f"_u{i}" for i in range(len(marks))], rank).drop(
        "_src", *[f"_u{i}" for i in range(len(marks))])


def prefer_first(frames: Sequence[DataFrame], keys: Sequence[str],
                 ordinal: str | None = None) -> DataFrame:
    """Union where an earlier frame wins a key outright."""
    tagged = [f.withColumn("_p", F.lit(-i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for frame in tagged[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return keep_best(out, keys, [F.col("_p")], ordinal).drop("_p")


#: Seasons of an archive; a century and a half of play fits.
MOST_SEASONS = 1000


def finished(games: DataFrame, seasons: DataFrame | None = None) -> DataFrame:
    """Finished games, of the given seasons only. Seasons are few (at most
    ``MOST_SEASONS``), so they become a plain filter: where the games are stored
    by season, folders of other seasons are not read."""
    out = games.where(F.col("status") == "Final")
    if seasons is None:
        return out
    wanted = [r[0] for r in seasons.select("season").distinct().limit(MOST_SEASONS + 1).collect()]
    if len(wanted) > MOST_SEASONS:
        raise ValueError(f"more than {MOST_SEASONS} seasons")
    return out.where(F.col("season").isin(wanted)) if wanted else out.where(F.lit(False))


def pending(requested: DataFrame, done: DataFrame, keys: Sequence[str],
            order: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Work not yet recorded, in order, optionally only the next ``limit``."""
    out = requested.join(done.select(*keys).distinct(), list(keys), "left_anti")
    if limit is not None:
        out = out.orderBy(*(order or keys)).limit(limit)
    return out
