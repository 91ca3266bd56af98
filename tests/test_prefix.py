"""Running state with parts so small that every boundary is crossed."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fungo.operators.prefix import day_order, id_order, last_n_before, position, ranged, running
from fungo.operators.resample import group_spread

DDL = "k string, day date, id bigint, v int, note string"


def rows(seed=0, n=400):
    r = random.Random(seed)
    start = dt.date(2024, 1, 1)
    return [("hot" if r.random() < 0.6 else r.choice("abc"), start + dt.timedelta(days=r.randint(0, 9)), i,
             None if r.random() < 0.3 else r.randint(1, 50), None if r.random() < 0.5 else f"n{i}") for i in range(n)]


def before(data, row, same_key=True):
    return [x for x in sorted(data, key=lambda x: (x[1], x[2]))
            if (x[1], x[2]) < (row[1], row[2]) and (x[0] == row[0] or not same_key)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_over_tiny_parts(spark, keys):
    data = rows()
    df = spark.createDataFrame(data + [(None, data[0][1], 999, 1, None)] * bool(keys), DDL)
    got = {r.id: r for r in running(
        df, keys, day_order("day", "id"), part_rows=3, sums={"total": F.col("v"), "n": F.col("v").isNotNull().cast("int")},
        lasts={"last_v": F.col("v"), "last_note": F.col("note")}, trailing={"recent": (F.col("v"), 3)}).collect()}
    assert len(got) == len(data)
    for row in data:
        past = before(data, row, bool(keys))
        r = got[row[2]]
        values = [x[3] for x in past if x[3] is not None]
        notes = [x[4] for x in past if x[4] is not None]
        assert r.total == sum(values) and r.n == len(values)
        assert r.last_v == (values[-1] if values else None) and r.last_note == (notes[-1] if notes else None)
        assert r.recent == sum(x[3] or 0 for x in past if (row[1] - x[1]).days < 3)


@pytest.mark.parametrize("block", [7, 20])
def test_last_n_across_blocks(spark, block):
    data = rows(3, 300)
    df = running(spark.createDataFrame(data, DDL), ["k"], day_order("day", "id"), part_rows=5,
                 sums={"n": F.col("v").isNotNull().cast("int")})
    got = last_n_before(df, ["k"], "n", 7, {"m": F.col("v")}, block=block)
    assert got.count() == len(data)
    for r in got.collect():
        values = [x[3] for x in before(data, (r.k, r.day, r.id)) if x[3] is not None][-7:]
        assert (r.m is None) if not values else r.m == pytest.approx(sum(values) / len(values))


@pytest.mark.parametrize("part", [2, 1000])
def test_positions_are_dense(spark, part):
    data = rows(5, 200)
    got = position(spark.createDataFrame(data, DDL), ["k"], id_order("id"), part_rows=part).collect()
    for key in {r.k for r in got}:
        mine = sorted((r.id, r.pos) for r in got if r.k == key)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))


def test_hashed_ids_are_cut_into_ranges_of_rows(spark):
    """Ids spread over 64 bits: no part holds one row, none a whole key, and a hot day is spread."""
    n, part = 60_000, 4_000
    df = spark.range(n).select(F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
                               F.date_add(F.lit(dt.date(2024, 1, 1)), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).cast("int")).alias("day"),
                               F.xxhash64("id").alias("id"), (F.col("id") % 9).cast("int").alias("v"))
    cut = ranged(df, ["k", "day"], ["day", "id"], part, "part")
    sizes = cut.groupBy("k", "day", "part").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 2 * part and sizes[1] < 4_000
    got = running(df, ["k"], day_order("day", "id"), {"total": F.col("v")}, {"last": F.col("v")}, part_rows=part)
    frame = W.partitionBy("k").orderBy("day", "id").rowsBetween(W.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("total"), F.last("v").over(frame).alias("last"))
    assert got.count() == n and got.exceptAll(want.select(got.columns)).count() == 0


def test_group_spread(spark):
    data = [(g, float(g)) for g in range(6) for _ in range(20)] + [(9, 100.0)] * 3
    df = spark.createDataFrame(data, "g int, v double")
    row = group_spread(df, [], "g", "v").first()
    assert row.groups == 6 and row.spread == pytest.approx((35 / 12) ** 0.5)
    assert group_spread(df.where("g < 4"), [], "g", "v").first().spread is None


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    from fungo import session
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    wanted = 4000 // 40
    assert wanted > session.parallel_parts(spark)
    assert session.dealt(spark.range(10), 4000, "id").rdd.getNumPartitions() == wanted
    df = spark.range(4000).selectExpr("id", "id % 900 as k", "date_add(DATE'2020-01-01', cast(id div 10 as int)) as day", "id % 7 as v")
    out = running(df, ["k"], day_order("day", "id"), sums={"s": F.col("v")}, lasts={"last": F.col("v")},
                  trailing={"t": (F.col("v"), 91)})
    # A fixed number of tasks would make each of them larger with the table.
    assert out.rdd.getNumPartitions() == wanted
    got = {r["id"]: (r["s"], r["last"], r["t"]) for r in out.collect()}
    for i in range(4000):
        past = list(range(i % 900, i, 900))
        assert got[i] == (sum(j % 7 for j in past), past[-1] % 7 if past else None,
                          sum(j % 7 for j in past if i // 10 - j // 10 < 91))


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(rows(), DDL)
    plan = running(df, ["k"], day_order("day", "id"), sums={"s": F.col("v")},
                   lasts={"last": F.col("note")})._jdf.queryExecution().executedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    moved = [i for i, line in enumerate(lines) if line.startswith("Exchange")]
    # No exchange moves what another one has just dealt, and only one moves
    # rows; the others move sums of a day.
    assert moved and not any(i + 1 in moved for i in moved)
    assert sum("Aggregate" not in "".join(lines[i + 1:i + 3]) and "Window" not in "".join(lines[i + 1:i + 3]) for i in moved) == 1
