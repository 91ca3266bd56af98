import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fungo.functions import rng
from fungo.operators import metrics, resample as R


def test_generator_agrees_everywhere(spark):
    duckdb = pytest.importorskip("duckdb")
    a, b = np.arange(500, dtype=np.int64) * 7919, np.arange(500, dtype=np.int64)
    want = rng.mix_np(a, b, 11)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a bigint, b bigint")
    got = [r[0] for r in df.select(rng.mix(F.col("a"), F.col("b"), 11)).collect()]
    assert got == want.tolist()
    rows = duckdb.sql(f"select {rng.mix_sql('a', 'b', 11)}, {rng.coin_sql('a', '77')} from (select i * 7919 as a, i as b from range(500) t(i)) order by b").fetchall()
    assert [r[0] for r in rows] == want.tolist() and [r[1] for r in rows] == rng.coin_np(a, 77).tolist()


def test_grid_of_draws():
    a = np.array([0, 1, rng.M - 1, rng.M, rng.M + 1, 10 ** 12 + 7] + list(range(5, 5000, 7)), dtype=np.int64)
    b = np.array([0, 1, 2, 4999, rng.M - 1, rng.M], dtype=np.int64)
    by_hand = [[rng_by_hand(int(x), int(y), 3) for y in b] for x in a]
    assert rng.mix_grid(a, b, 3).tolist() == by_hand and rng.mix_np(a[:, None], b[None, :], 3).tolist() == by_hand
    marks = np.random.default_rng(0).integers(1, rng.M, 5000)
    price = np.append(marks / float(rng.M), np.random.default_rng(1).uniform(0.1, 0.9, 5000))
    least = R.below(price)
    assert (least / float(rng.M) >= price).all() and ((least - 1) / float(rng.M) < price).all()


def rng_by_hand(a, b, seed):
    x = ((a % rng.M) * rng.A1 + (b % rng.M) * rng.A2 + seed * 40692 + 7) % rng.M
    x = ((x * x + b % rng.M) % rng.M * rng.A3 + a % rng.M) % rng.M
    return ((x * x + seed + 12345) % rng.M * rng.A1 + 11) % rng.M


@pytest.mark.parametrize("n", [1, 2, 17, 1000])
def test_shuffle_is_a_bijection(n):
    seen = [R.permuted(np.arange(n), n, d, 5) for d in range(1, 8)]
    assert all(sorted(p.tolist()) == list(range(n)) for p in seen)
    if n == 1000:
        assert len({tuple(p) for p in seen}) == 7


def frame(spark, n=600, edge=0.0, days=40, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        p = r.uniform(0.3, 0.7)
        y = float(r.random() < p)
        rows.append(("m", i % days, min(max(p + r.gauss(0, 0.1) * (1 - edge), 0.05), 0.95), min(max(p + r.gauss(0, 0.1) * edge, 0.05), 0.95), y))
    return spark.createDataFrame(rows, "market string, official_date int, model double, price double, y double"), rows


def test_report(spark):
    df, rows = frame(spark, edge=0.5)
    got = metrics.compare(df, draws=400).first()
    loss = [(-math.log(m if y else 1 - m), -math.log(p if y else 1 - p)) for _, _, m, p, y in rows]
    assert got.log_loss_model == pytest.approx(np.mean([a for a, _ in loss]), abs=1e-5)
    assert got.delta == pytest.approx(np.mean([a - b for a, b in loss]), abs=1e-5)
    assert got.ci_low < got.delta < got.ci_high
    by_day = {}
    for (_, d, *_), (a, b) in zip(rows, loss):
        by_day.setdefault(d, []).append(a - b)
    sums = np.array([[sum(v), len(v)] for v in by_day.values()])
    g = np.random.default_rng(1)
    boot = [np.divide(*sums[g.integers(0, len(sums), len(sums))].sum(0)) for _ in range(2000)]
    width = np.percentile(boot, 95) - np.percentile(boot, 5)
    assert (got.ci_high - got.ci_low) == pytest.approx(width, rel=0.2)


def test_clear_and_thin_samples(spark):
    better = metrics.compare(frame(spark, 1500, edge=1.0)[0], draws=300).first()
    assert better.verdict.startswith("model better") and better.model_beats_market == 1
    assert metrics.compare(frame(spark, 40)[0], draws=300).first().verdict == "insufficient sample"
    few = metrics.compare(frame(spark, 200, days=5)[0], draws=300).first()
    assert few.ci_low is None and few.verdict.startswith("insufficient sample for")


def test_draws_are_never_broadcast(spark, monkeypatch):
    parts = R.cluster_parts(frame(spark, 600)[0].withColumn("gap", F.col("model") - F.col("price")), ["market"], "official_date", "gap", "y")
    seen = []
    for few in (R.FEW, 0):
        monkeypatch.setattr(R, "FEW", few)
        df = R.interval(parts, ["market"], True, 200)
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        at = [k for k, line in enumerate(plan) if "BroadcastExchange" in line]
        deep = [len(line) - len(line.lstrip(" :+-")) for line in plan]
        for k in at:
            below = next((j for j in range(k + 1, len(plan)) if deep[j] <= deep[k]), len(plan))
            assert not any("Generate" in line for line in plan[k:below])
        seen.append((bool(at), df.collect()))
    assert seen[0][0] and not seen[1][0] and seen[0][1] == seen[1][1]


def test_bands_do_not_overlap(spark):
    rows = [(13.5, 0.5, 0.4, 0.0)] * 10 + [(14.5, 0.5, 0.4, 1.0)] * 10 + [(14.0, 0.5, 0.4, 1.0)]
    got = {r.band: r for r in metrics.band_table(spark.createDataFrame(rows, "gap_pts double, model_prob double, market_prob double, won double")).collect()}
    assert set(got) == {"13-14", "14-15"} and got["13-14"].no_vig_roi_pct == -100.0 and got["14-15"].games == 11
    assert got["14-15"].no_vig_roi_pct == 150.0


def test_search_prices_noise(spark):
    def run(edge, seed=3):
        r = random.Random(seed)
        rows = []
        for i in range(800):
            p = r.uniform(0.35, 0.65)
            rows.append((i, r.uniform(0, 15), p, float(r.random() < p + edge)))
        return R.search_correction(spark.createDataFrame(rows, "id bigint, gap_pts double, market_prob double, won double"), "id", 300).first()
    assert run(0.0).p_value_after_search > 0.05
    assert run(0.3).p_value_after_search < 0.05
    thin = spark.createDataFrame([(1, 9.0, 0.5, 1.0)], "id bigint, gap_pts double, market_prob double, won double")
    assert R.search_correction(thin, "id", 50).count() == 0


def umpired(spark, effect, n=900):
    r = random.Random(9)
    rows = [(i, 2021 + i % 3, u, effect * (u % 2) + r.gauss(0, 1)) for i in range(n) for u in [r.randint(1, 12)]]
    return spark.createDataFrame(rows, "id bigint, season int, ump int, v double")


def test_permutation_separates_effect_from_noise(spark):
    none = R.permutation_test(umpired(spark, 0.0), [], "season", "ump", "v", "id", 200).first()
    real = R.permutation_test(umpired(spark, 1.0), [], "season", "ump", "v", "id", 200).first()
    assert none.p_value > 0.05 and real.p_value < 0.01 and real.groups == 12 and real.rows == 900
    assert real.implied_true_sd == pytest.approx(0.5, abs=0.12)
    few = umpired(spark, 1.0).where("ump < 4")
    assert R.permutation_test(few, [], "season", "ump", "v", "id", 120).count() == 0


def test_many_chunks_equal_one(spark, monkeypatch):
    whole = R.permutation_test(umpired(spark, 0.5), [], "season", "ump", "v", "id", 120).first()
    monkeypatch.setattr(R, "CHUNK", 64)
    assert R.permutation_test(umpired(spark, 0.5), [], "season", "ump", "v", "id", 120).first() == whole


def test_calibration(spark):
    rows = [("a", 0.15, float(i % 5 == 0)) for i in range(20)] + [("a", 0.95, 1.0)] * 19 + [("a", 1.0, 1.0)] * 40
    table = metrics.calibration_table(spark.createDataFrame(rows, "k string, p double, y double"), ["k"])
    assert [(r.bin, r.n, r.error) for r in table.collect()] == [(1, 20, 0.05)]
    assert metrics.calibration_error(table, ["k"]).first().calibration_error == 0.05


@pytest.mark.parametrize("size", [1, 2, 17, 9000, 1 << 24, (1 << 24) + 1, 2**31 - 2])
def test_permuted_grid_is_the_network_of_the_coins(size):
    pos = np.unique(np.r_[0, size - 1, np.random.default_rng(1).integers(0, size, 500)])
    draws = np.array([1, 6, 2000])
    for draw, seen in zip(draws.tolist(), R.permuted_grid(pos, size, draws, 5)):
        x = pos.copy()
        for step in range(R.ROUNDS):
            tick = np.int64(draw * R.ROUNDS + step)
            other = (int(rng.mix_np(tick, np.int64(1), 5)) % size - x) % size
            coin = rng.coin_np(np.maximum(x, other), int(rng.mix_np(tick, np.int64(2), 6)))
            x = np.where(coin == 1, other, x)
        assert (seen == x).all()


@pytest.mark.parametrize("size,labels", [(5, 5), (70_000, 3), (1_000_000, 40), (300_000, 90_000)])
def test_label_table_agrees_with_a_search(size, labels):
    draw = np.random.default_rng(2)
    ends = np.r_[np.sort(draw.choice(size - 1, labels - 1, replace=False) + 1), size]
    x = np.r_[0, ends - 1, ends[:-1], draw.integers(0, size, 1000)]
    assert (R._label_of(ends, size)(x) == np.searchsorted(ends, x, side="right")).all()
