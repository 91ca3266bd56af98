"""Nearest-start, one-to-one matching of priced events to scheduled games.

Events of one team pair are taken in start order; each claims the nearest
unclaimed game within the drift limit. Two starts further apart than the limit
can never meet, so a pair's timeline is first cut wherever a whole time cell
is empty. Nearly all stretches hold one event and one game, or no game at all,
and are settled by an aggregate. Contested ones are walked in order, by a task
that keeps the games inside the limit.

A contested stretch of more than ``block`` rows is cut into blocks of sampled
ranges, which are walked at the same time, each with the games of the blocks
around it, less those that earlier blocks claimed the round before. Rounds go
on until no claim changes. The first block is right after one round and each
block once those before it are, so the end is what a single walk gives; a
difference at a block's start dies out after a few games, so rounds are few. An
event whose nearest free game may lie outside the blocks seen widens the view.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fungo import config as C
from fungo.session import parallel_parts, written

c = F.col
PAIR = ["home_key", "away_key"]
BLOCK = 50_000


def match_events(events: DataFrame, games: DataFrame,
                 drift_hours: float = C.MAX_START_DRIFT_HOURS, block: int = BLOCK) -> DataFrame:
    """events(event_id, home_key, away_key, commence) and games(game_pk,
    home_key, away_key, start) to (event_id, game_pk, gap_hours), one row per
    event, game_pk null when no game is left for it."""
    limit = int(drift_hours * 3_600_000_000)
    tagged = (events.where(F.col("commence").isNotNull())
              .select(*PAIR, F.unix_micros(F.col("commence").cast("timestamp")).alias("at"),
                      F.lit(1).alias("is_event"), F.col("event_id").cast("string").alias("id"))
              .unionByName(games.where(F.col("start").isNotNull())
                           .select(*PAIR, F.unix_micros(F.col("start").cast("timestamp")).alias("at"),
                                   F.lit(0).alias("is_event"),
                                   F.col("game_pk").cast("string").alias("id"))))
    tagged = tagged.withColumn("cell", F.floor(F.col("at") / limit).cast("bigint"))
    # A stretch is a run of occupied neighbouring cells. Cells per pair are
    # bounded by the time span, not by the number of rows.
    cells = tagged.groupBy(*PAIR, "cell").agg(F.max("is_event").alias("e"),
                                              F.min("is_event").alias("g"))
    w = W.partitionBy(*PAIR).orderBy("cell")
    gap = F.col("cell") - F.lag("cell").over(w) > 1
    cells = cells.withColumn("cut", F.when(gap, 1).otherwise(0)).withColumn(
        "stretch", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    # Read for the counts and again for the rows: written once.
    placed = written(tagged.join(cells.select(*PAIR, "cell", "stretch"), [*PAIR, "cell"])
                     .select(*PAIR, "stretch", "at", "is_event", "id"))
    stretch = [*PAIR, "stretch"]
    event = F.col("is_event") == 1
    held = placed.groupBy(*stretch).agg(
        F.count_if(event).alias("events"), F.count_if(~event).alias("games"),
        F.min(F.when(event, F.col("id"))).alias("event_id"), F.min(F.when(~event, F.col("id"))).alias("game_pk"),
        (F.min(F.when(event, F.col("at"))) - F.min(F.when(~event, F.col("at")))).alias("apart"))
    near = F.abs("apart") <= limit
    plain = held.where("events = 1 and games = 1").select(
        "event_id", F.when(near, F.col("game_pk")).alias("game_pk"), F.when(near, F.abs("apart") / 3.6e9).alias("gap_hours"))
    alone = placed.where(event).join(held.where("games = 0").select(*stretch), stretch, "left_semi").select(
        F.col("id").alias("event_id"), F.lit(None).cast("string").alias("game_pk"), F.lit(None).cast("double").alias("gap_hours"))
    contested = held.where("events > 0 and games > 0 and events + games > 2")
    short = contested.where(F.col("events") + F.col("games") <= block).select(*stretch)
    walked = walk(placed.join(short, stretch, "left_semi"), stretch, limit)
    long = written(contested.where(F.col("events") + F.col("games") > block).select(*stretch))
    out = plain.unionByName(alone).unionByName(walked)
    return out if long.isEmpty() else out.unionByName(in_blocks(placed.join(long, stretch, "left_semi"), stretch, limit, block))


def walk(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(event_id, game_pk, gap_hours) of the events of each key, taken in order."""
    of = F.struct(*keys).alias("key")
    return (rows.select(of, "at", "is_event", "id").repartition(parallel_parts(rows.sparkSession), "key")
            .sortWithinPartitions("key", "at", "is_event", F.length("id"), "id")
            .select(F.xxhash64("key").alias("mark"), F.to_json("key").alias("key"), "at", "is_event", "id")
            .mapInPandas(_walker(limit), "event_id string, game_pk string, gap_hours double"))


def in_blocks(rows: DataFrame, stretch: list[str], limit: int, block: int) -> DataFrame:
    """``walk`` over long stretches, block by block until nothing changes."""
    parts = max(parallel_parts(rows.sparkSession), -(-rows.count() // block))
    cut = written(rows.withColumn("_len", F.length("id"))
                  .repartitionByRange(parts, *stretch, "at", "is_event", "_len", "id").withColumn("block", F.spark_partition_id()))
    blocks = written(cut.groupBy(*stretch, "block").agg(F.min("at").alias("low"), F.max("at").alias("high")))
    events, games = cut.where("is_event = 1"), cut.where("is_event = 0")
    claims, view = None, 1
    while True:
        # The blocks of a stretch have consecutive numbers.
        seen = games.withColumn("to", F.explode(F.sequence(F.col("block") - view, F.col("block") + view))).join(
            blocks.select(*stretch, F.col("block").alias("to")), [*stretch, "to"]).select(*stretch, F.col("to").alias("block"), "at", "is_event", "id")
        if claims is not None:
            earlier = claims.where(c("game_pk").isNotNull()).select(
                *[c(k).alias(f"_{k}") for k in stretch], c("block").alias("_by"), c("game_pk").alias("_game"))
            seen = seen.join(earlier, [c(k) == c(f"_{k}") for k in stretch] + [c("id") == c("_game"), c("_by") < c("block")], "left_anti")
        found = walk(events.select(seen.columns).unionByName(seen), [*stretch, "block"], limit)
        now = written(events.select(*stretch, "block", "at", c("id").alias("event_id")).join(found, "event_id"))
        low = blocks.select(*stretch, (c("block") + view).alias("block"), c("low").alias("from"))
        high = blocks.select(*stretch, (c("block") - view).alias("block"), c("high").alias("upto"))
        # What lies outside the view is no nearer than its ends.
        edge = F.least(c("at") - F.coalesce("from", F.lit(-(1 << 61))), F.coalesce("upto", F.lit(1 << 61)) - c("at"))
        reach = F.coalesce(c("gap_hours") * 3.6e9, F.lit(float(limit)))
        narrow = now.join(low, [*stretch, "block"], "left").join(high, [*stretch, "block"], "left").where(reach >= edge)
        tight = not narrow.isEmpty()
        if not tight and claims is not None and now.exceptAll(claims).isEmpty():
            return now.select("event_id", "game_pk", "gap_hours")
        view, claims = view * 2 if tight else view, now


class _Open:
    """Unclaimed games of one stretch in start order, with skips over claimed
    ones, so that the nearest free game is found without scanning."""

    def __init__(self):
        self.starts, self.ids, self.right, self.left = [], [], [], []

    def add(self, start, ident):
        at = len(self.starts)
        self.starts.append(start)
        self.ids.append(ident)
        self.right.append(at)
        self.left.append(at)

    @staticmethod
    def _seek(skip, at):
        seen = []
        while 0 <= at < len(skip) and skip[at] != at:
            seen.append(at)
            at = skip[at]
        for k in seen:
            skip[k] = at
        return at if 0 <= at < len(skip) else None

    def take_nearest(self, at, limit):
        """(id, gap) of the nearest free game within ``limit``; on equal gaps the
        earlier start, then the smaller id."""
        cut = bisect_left(self.starts, at)
        after = self._seek(self.right, cut)
        before = self._seek(self.left, cut - 1)
        if before is not None:
            before = self._seek(self.right, bisect_left(self.starts, self.starts[before]))
        picks = [(abs(self.starts[k] - at), k) for k in (before, after) if k is not None]
        if not picks or min(picks)[0] > limit:
            return None, None
        gap, k = min(picks)
        self.right[k], self.left[k] = k + 1, k - 1
        return self.ids[k], gap

    def forget(self, before):
        """Drop games that no later event can reach, a large batch at a time."""
        n = bisect_left(self.starts, before)
        if n < 50_000:
            return
        self.starts, self.ids = self.starts[n:], self.ids[n:]
        self.right = [max(k - n, 0) for k in self.right[n:]]
        self.left = [max(k - n, -1) for k in self.left[n:]]


def _walker(limit: int):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, games, waiting = None, _Open(), deque()

        def settle(now=None):
            # An event is settled, in order, once no later game can reach it.
            out = []
            while waiting and (now is None or waiting[0][0] + limit < now):
                at, event = waiting.popleft()
                game, gap = games.take_nearest(at, limit)
                out.append((event, game, None if gap is None else gap / 3.6e9))
                games.forget(at - limit)
            return out

        for batch in batches:
            out = []
            for *here, at, is_event, ident in zip(*[batch[k].tolist() for k in ("mark", "key", "at", "is_event", "id")]):
                if here != key:
                    out += settle()
                    key, games = here, _Open()
                out += settle(at)
                if is_event:
                    waiting.append((at, ident))
                else:
                    games.add(at, ident)
            if out:
                yield pd.DataFrame(out, columns=["event_id", "game_pk", "gap_hours"])
        last = settle()
        if last:
            yield pd.DataFrame(last, columns=["event_id", "game_pk", "gap_hours"])
    return walk


def unmatched(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("game_pk").isNull()).select("event_id")
