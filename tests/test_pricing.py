import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fungo.operators import pricing as P
from fungo.plans import modelling as M

MEANS = np.array([[4.5, 4.2], [3.0, 5.0], [6.5, 4.0]]).T


@pytest.mark.parametrize("shape", [None, (0.747, 2.25)])
def test_joint_is_a_distribution_without_ties(shape):
    t = P.joint(*MEANS, P.Width(4.0, 3.5, shape))
    assert np.allclose(t.sum((1, 2)), 1) and (t >= 0).all()
    assert np.trace(t, axis1=1, axis2=2).max() < 1e-9


def test_better_side_wins_more_and_totals_fall():
    cover, _ = P.readout([("h2h", None), ("spreads", -1.5), ("spreads", 1.5)] + [("totals", x) for x in (6.5, 7.5, 8.5, 9.5)])
    p = P.joint(*MEANS, P.Width()).reshape(3, -1) @ cover
    assert p[1, 0] < p[0, 0] < p[2, 0]
    assert (p[:, 1] < p[:, 0]).all() and (p[:, 0] < p[:, 2]).all() and (np.diff(p[:, 3:]) < 0).all()


def test_whole_lines_split_into_cover_push_and_rest():
    cover, push = P.readout([("totals", 9.0), ("totals", 8.5), ("totals", 9.5), ("spreads", -1.0), ("spreads", -1.5)])
    flat = P.joint(*MEANS, P.Width()).reshape(3, -1)
    p, q = flat @ cover, flat @ push
    assert np.allclose(p[:, 0] + q[:, 0], p[:, 1]) and np.allclose(p[:, 0], p[:, 2])
    assert np.allclose(q[:, 1], 0) and (q[:, 3] > 0).all() and np.allclose(p[:, 3], p[:, 4])


def test_pieces():
    for shape in (None, (0.75, 2.0)):
        whole, early, last = P.pieces(np.array([4.5]), 4.0, shape, 9)
        assert np.allclose([whole.sum(), early.sum()], 1)
        assert (whole * P.RUNS).sum() == pytest.approx(4.5, abs=2e-3)
    inning = P.inning_pmf(np.array([0.5]), 0.75, 2.0)
    assert inning[0, 0] == 0.75 and (inning * P.RUNS).sum() == pytest.approx(0.5, abs=1e-6)
    slow = np.zeros(31)
    slow[0] = 1.0
    for _ in range(8):
        slow = np.convolve(slow, inning[0])[:31]
    assert np.allclose(P.repeated_sum(inning, 8)[0], slow, atol=1e-12)


@pytest.mark.parametrize("shape", [None, (0.747, 2.25)])
def test_uncensoring_recovers_the_target(shape):
    w = P.Width(4.0, 3.5, shape)
    full = P.uncensored_home(*MEANS, w)
    finished = (P.joint(full, MEANS[1], w) * P.RUNS[:, None]).sum((1, 2))
    assert np.allclose(finished, MEANS[0], atol=1e-4)
    away = P.pieces(MEANS[1], w.dispersion_away, shape, 9)[0]
    assert np.allclose(P.implied_home_mean(full, away, w, 9), finished, atol=1e-12)


def test_censoring_moves_losses_by_one():
    base, cut = (P.joint(*MEANS, P.Width(), censor=x) for x in (False, True))
    margin = P.RUNS[:, None] - P.RUNS[None, :]
    assert ((cut * (margin == 1)).sum((1, 2)) > (base * (margin == 1)).sum((1, 2))).all()


def test_job_prices_every_line_and_length(spark):
    rows = [(i, 3.0 + i % 4, 4.0, [9, 7, None, 0][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "game_pk bigint, home_mean double, away_mean double, innings int")
    got = P.price_games(df, P.Width(), (("h2h", None), ("totals", 9.0))).toPandas()
    assert len(got) == 80 and got[got.market == "h2h"].point.isna().all()
    seven = got[got.game_pk == 1].iloc[0]
    assert seven.expected_away == pytest.approx(4.0 * 7 / 9) and got.prob.between(0, 1).all()
    assert (got[got.market == "totals"].push > 0).all()


def test_dispersion(spark):
    g = np.random.default_rng(0)
    draws = g.negative_binomial(4.0, 4.0 / (4.0 + 5.0), 8000)
    df = spark.createDataFrame([("nb", float(y), 5.0) for y in draws] + [("thin", 1.0, 5.0)] * 10
                               + [("flat", 5.0, 5.0)] * 60 + [("nb", None, 5.0), ("nb", 3.0, float("nan"))], "k string, y double, mu double")
    got = {r.k: (r.n, r.dispersion) for r in P.dispersion(df, "y", "mu", ["k"]).collect()}
    assert got["nb"][0] == 8000 and got["nb"][1] == pytest.approx(4.0, rel=0.15)
    assert got["thin"][1] == 4.0 and got["flat"][1] == 50.0


def test_shape_is_recovered(spark):
    g = np.random.default_rng(1)
    mu = g.uniform(3.5, 5.5, 6000)
    pmf = P.pieces(mu, None, (0.75, 3.0), 9)[0]
    y = [int(g.choice(31, p=p / p.sum())) for p in pmf]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, mu)], "y double, mu double")
    best = P.fit_inning_shape(df, "y", "mu").first()
    assert best.scoreless == pytest.approx(0.75, abs=0.02)
    thin = P.fit_inning_shape(df.limit(20), "y", "mu").first()
    assert (thin.scoreless, thin.tail) == (0.747, 2.25)


def test_calibrations(spark):
    ddl = "home_batted_ninth int, home_score int, away_score int, innings_played int, scheduled_innings int, home_win int"
    walk = [(1, 4, 3, 9, 9, 1)] * 240 + [(1, 5, 3, 9, 9, 1)] * 60 + [(0, 9, 1, 9, 9, 1)] * 50
    df = spark.createDataFrame(walk, ddl)
    assert P.calibrate_walk_off(df) == pytest.approx((0.8, 0.2, 0, 0))
    assert P.calibrate_walk_off(df.limit(100)) == (0.872, 0.075, 0.037, 0.016)
    extra = spark.createDataFrame([(1, 4, 3, 10, 9, 1)] * 90 + [(1, 3, 9, 11, 9, 0)] * 30, ddl)
    edge, margins = P.calibrate_extra_innings(extra)
    assert edge == 0.60 and margins == pytest.approx((0.75, 0, 0, 0.25))
    assert P.calibrate_extra_innings(df) == (0.52, (0.688, 0.159, 0.086, 0.067))


COLUMNS = ("home_off", "away_off", "elo_diff", "park_factor")


def league(spark, n=900, seed=2):
    r, g = random.Random(seed), np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, park = r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)
        day = dt.date(2021 + 3 * i // n, 4, 1) + dt.timedelta(days=i % 150)
        h, v = (int(g.poisson(np.exp(1.4 + 0.2 * x - 0.1 * y + 0.05 * park))) for x, y in ((a, b), (b, a)))
        rows.append((i, day, day.year, a, b, a - b, park, h, v, int(h > v), 9, 9, 1))
    return spark.createDataFrame(rows, "game_pk bigint, official_date date, season int, home_off double, away_off double, elo_diff double, "
                                 "park_factor double, home_score int, away_score int, home_win int, innings_played int, scheduled_innings int, home_batted_ninth int")


def test_mirror_twice_is_identity(spark):
    df = league(spark, 50).select("game_pk", *COLUMNS)
    once = M.mirror(df, COLUMNS)
    assert M.mirror(once, COLUMNS).exceptAll(df).count() == 0
    a, b = df.orderBy("game_pk").first(), once.orderBy("game_pk").first()
    assert a.home_off == b.away_off and a.elo_diff == -b.elo_diff and a.park_factor == b.park_factor


def test_planted_coefficients_are_found(spark):
    df = league(spark)
    model = M.fit_runs(df.select("game_pk", "official_date", "season", *COLUMNS), df, columns=COLUMNS)
    got = model.expected(df).toPandas().set_index("game_pk")
    truth = df.toPandas().set_index("game_pk")
    want = np.exp(1.4 + 0.2 * truth.home_off - 0.1 * truth.away_off + 0.05 * truth.park_factor)
    assert np.corrcoef(got.home_mean.sort_index(), want.sort_index())[0, 1] > 0.98
    assert model.width.dispersion_away > 15 and model.width.shape is not None


def test_walk_forward_never_sees_the_season(spark):
    df = league(spark)
    seasons = [2021, 2022, 2023]
    features = df.select("game_pk", "official_date", "season", *COLUMNS)
    out = M.walk_forward(features, df, seasons, columns=COLUMNS, min_train=100).toPandas()
    assert set(out.season) == {2022, 2023} and len(out) == 3 * (out.game_pk.nunique())
    from pyspark.sql import functions as F
    spoiled = df.withColumns({k: F.when(F.col("season") == 2023, 20).otherwise(F.col(k)) for k in ("home_score", "away_score")})
    again = M.walk_forward(features, spoiled, seasons, columns=COLUMNS, min_train=100).toPandas()
    key = ["game_pk", "market"]
    assert np.allclose(out.sort_values(key).prob, again.sort_values(key).prob)
    assert M.walk_forward(features, df, seasons, columns=COLUMNS, min_train=5000) is None


def test_boosting_runs(spark):
    df = league(spark, 300)
    fit = M.fit_estimator(M.both_dugouts(df, COLUMNS), "gbm", COLUMNS)
    model = M.RunsModel(fit, P.Width(), "gbm", COLUMNS)
    assert model.expected(df).where("home_mean between 0.2 and 20").count() == 300


def test_found_games_leave_the_search(monkeypatch):
    """A few hard games, or means no finish reaches, do not keep the others in the search."""
    r = np.random.default_rng(3)
    target, away = np.append(r.uniform(3.0, 9.0, 400), [0.2, 30.0]), np.append(r.uniform(1.0, 9.0, 400), [0.2, 2.0])
    lanes, plain = [], P.implied_home_mean

    def counted(mean, *rest):
        lanes.append(len(mean))
        return plain(mean, *rest)
    monkeypatch.setattr(P, "implied_home_mean", counted)
    w = P.Width()
    full = P.uncensored_home(target, away, w)
    assert sum(lanes) < 14 * len(target)
    off = plain(full, P.pieces(away, w.dispersion_away, w.shape, 9).whole, w, 9) - target
    assert np.abs(off[:400]).max() <= 1e-10 * 9.0
    pmf = r.dirichlet(np.ones(31), 5)
    for k in (1, 2, 7, 9):
        both = P.sums_of(pmf, k)
        want = np.array([np.convolve(p, q)[:31] for p, q in zip(both[1], pmf)])
        assert np.allclose(both[0], want, atol=1e-14) and np.allclose(both[0], P.repeated_sum(pmf, k), atol=1e-14)


def test_seasons_are_fitted_side_by_side(spark, monkeypatch):
    """The same models as one by one, with as many tables and passes for many seasons as for few."""
    df = league(spark, 1800).withColumn("season", F.expr("season * 10 + game_pk % 2")).localCheckpoint()
    features = df.select("game_pk", "official_date", "season", *COLUMNS)
    seasons = [20211, 20220, 20221, 20230, 20231]
    calls = {"written": 0, "fits": 0}

    def counted(name, plain):
        def run(*args, **kwargs):
            calls[name] += 1
            return plain(*args, **kwargs)
        return run
    monkeypatch.setattr(M, "written", counted("written", M.written))
    monkeypatch.setattr(M, "fit_poisson", counted("fits", M.fit_poisson))
    made = []
    for some in (seasons[3:], seasons):
        calls.update(written=0, fits=0)
        out = M.walk_forward(features, df, some, columns=COLUMNS, min_train=300).toPandas()
        made.append(dict(calls))
        assert set(out.season) == set(some) and len(out) == 3 * out.game_pk.nunique()
    assert made[0] == made[1] and made[1]["fits"] == 1
    for season in (20220, 20231):
        model = M.fit_runs(features.where(F.col("season") < season), df, columns=COLUMNS)
        want = model.price(features.where(F.col("season") == season), df).toPandas()
        mine = out[out.season == season]
        key = ["game_pk", "market"]
        for name in ("prob", "push", "expected_home", "expected_away"):
            assert np.allclose(mine.sort_values(key)[name], want.sort_values(key)[name], atol=1e-9)
        assert mine.dispersion_home.iloc[0] == pytest.approx(model.width.dispersion_home, abs=1e-9)
        assert (mine.inning_scoreless.iloc[0], mine.inning_tail.iloc[0]) == model.width.shape


def test_marks_cut_the_latest_quarter(spark):
    """Days are counted, then one day is ordered: the same games as by ordering all, undated ones in neither."""
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else dt.date(2021, 4, 1 + i % 3), 2021 + i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "game_pk bigint, official_date date, _part int")
    marks = M.quarter_marks(df, [2022, 2023, 2021], 4, 100)
    assert marks[2] is None
    for bound, mark in ((2022, marks[0]), (2023, marks[1])):
        mine = [r for r in rows if r[2] < bound]
        dated = sorted((r[1], r[0]) for r in mine if r[1])
        assert mark == dated[len(mine) * 3 // 4 - 1]
        held = M.staged(df.where(F.col("_part") < bound), [mark]).where("_stage > 0")
        assert held.count() == len(dated) - len(mine) * 3 // 4
    assert M.staged(df, sorted(marks[:2])).where("_stage is null").count() == 20


def test_poisson_fits_leave_no_slope(spark):
    """Far starts, a constant column and one that is the sum of two others; each span has its own rows."""
    g = np.random.default_rng(4)
    x = g.normal(50.0, [3.0, 0.02], (3000, 2))
    y = g.poisson(np.exp(0.3 + (x[:, 0] - 50) / 3 + 30 * (x[:, 1] - 50) * 2))
    part = g.integers(0, 3, 3000)
    df = spark.createDataFrame([(*map(float, r), float(r.sum()), 0.1, float(t), int(k), 0) for r, t, k in zip(x, y, part)],
                               "a double, b double, c double, d double, target double, _part int, _stage int")
    columns = ["a", "b", "c", "d"]
    for bound, fit in zip((1, 3), M.fit_poisson(df, columns, [M.Span(1), M.Span(3)])):
        mine = part < bound
        z = (np.c_[x, x.sum(1)] - fit.centre[:3]) * fit.scale[:3]
        assert np.allclose(z[mine].std(axis=0, ddof=1), 1) and fit.scale[3] == 0 and fit.coefficients[3] == 0
        mean = np.exp(fit.intercept + z @ fit.coefficients[:3])
        off = (mean - y)[mine]
        assert abs(off.mean()) < 1e-9 and np.abs(off @ z[mine] / mine.sum() + M.ALPHA * np.array(fit.coefficients[:3])).max() < 1e-9


@pytest.mark.parametrize("shape,innings", [(None, 9), ((0.747, 2.25), 9), ((0.5, 1.2), 7), ((0.79, 0.5), 1)])
def test_board_equals_the_table(shape, innings):
    """Prices by sums along each side are those of the whole table, and hard targets are found in few steps."""
    r = np.random.default_rng(5)
    w, points = P.Width(30.0, 5.0, shape), (("h2h", None), ("spreads", -1.5), ("spreads", 2.0), ("totals", 8.5), ("totals", 9.0))
    home, away = r.uniform(1.0, 12.0, (2, 200)) * innings / 9
    full = P.uncensored_home(home, away, w, innings)
    cells = P.joint(full, away, w, innings).reshape(200, -1)
    prob, push = P.Board(w, innings, points).prices(home, away)
    cover, level = P.readout(points)
    assert np.allclose(prob, cells @ cover, atol=1e-12) and np.allclose(push, cells @ level, atol=1e-12)


def test_targets_near_the_cut_are_found(monkeypatch):
    w, lanes, plain = P.Width(30.0, 5.0), [], P.implied_home_mean

    def counted(mean, *rest):
        lanes.append(len(mean))
        return plain(mean, *rest)
    target, away = np.array([14.872807623469866, 15.078668910824266, 2.6]), np.array([8.816068953060842, 13.159415575989815, 2.0])
    monkeypatch.setattr(P, "implied_home_mean", counted)
    full = P.uncensored_home(target, away, w)
    off = plain(full, P.pieces(away, w.dispersion_away, w.shape, 9).whole, w, 9) - target
    assert np.abs(off).max() < 1e-8 and sum(lanes) < 5 * len(target)


def test_targets_just_above_the_least_mean_are_found():
    """By innings the finished mean is flat up to a home mean and rises from there."""
    w = P.Width(50.0, 50.0, (0.7925, 0.5), walk_off_margins=(0.453, 0.296, 0.150, 0.101))
    away = np.full(40, 2.02)
    away_pmf = P.pieces(away, w.dispersion_away, w.shape, 9).whole
    least = P.implied_home_mean(np.full(40, 1e-3), away_pmf, w, 9)
    target = least + np.geomspace(1e-8, 1e-3, 40)
    assert np.abs(P.implied_home_mean(P.uncensored_home(target, away, w), away_pmf, w, 9) - target).max() < 1e-9
    low = P.uncensored_home(least - np.geomspace(1e-8, 1.0, 40), away, w)
    assert np.allclose(P.implied_home_mean(low, away_pmf, w, 9), least, atol=1e-12)
