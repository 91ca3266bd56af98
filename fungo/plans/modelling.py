"""Expected scores from features: fitting, holdout width, walk-forward, pricing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo import config as C
from fungo.functions import scalars as S
from fungo.operators import pricing as P
from fungo.operators.pricing import Width
from fungo.operators.prefix import day_order, position
from fungo.session import written

c = F.col
ALPHA = 1e-3
OUTCOMES = ["home_score", "away_score", "home_win", "innings_played", "scheduled_innings",
            "home_batted_ninth"]


def other_side(name: str) -> str:
    for a, b in (("home_", "away_"), ("away_", "home_"), ("expected_home_", "expected_away_"),
                 ("expected_away_", "expected_home_")):
        if name.startswith(a):
            return b + name[len(a):]
    return name


def mirror(df: DataFrame, columns: Sequence[str] = C.FEATURE_COLUMNS) -> DataFrame:
    """The same games from the away dugout: sides swap, directed terms change sign."""
    have = set(df.columns)

    def seen(name):
        if name not in columns:
            return c(name)
        if name in C.SIGNED_FEATURES:
            return (-c(name)).alias(name)
        twin = other_side(name)
        return c(twin).alias(name) if twin in have else c(name)

    return df.select(*[seen(n) for n in df.columns])


def design(df: DataFrame, columns: Sequence[str] = C.FEATURE_COLUMNS) -> DataFrame:
    """Model columns as doubles; an absent column or value is zero."""
    have = set(df.columns)
    extra = [n for n in df.columns if n not in columns]
    return df.select(*extra, *[
        (F.coalesce(F.nanvl(c(n).cast("double"), F.lit(0.0)), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n)
        for n in columns])


def both_dugouts(df: DataFrame, columns: Sequence[str] = C.FEATURE_COLUMNS) -> DataFrame:
    """Every game twice: home's score from home's view, away's from away's."""
    home = design(df, columns).withColumn("target", c("home_score").cast("double"))
    away = design(mirror(df, columns), columns).withColumn("target", c("away_score").cast("double"))
    return home.unionByName(away)


@dataclass(frozen=True)
class PoissonFit:
    """Log-linear means; ``coefficients`` belong to the columns less ``centre``, times ``scale``."""

    columns: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def standardised(self) -> list[Column]:
        return [(c(n) - F.lit(m)) * F.lit(k) for n, m, k in zip(self.columns, self.centre, self.scale)]

    def mean(self) -> Column:
        """The expected score from design columns."""
        return F.exp(reduce(add, (x * F.lit(b) for x, b in zip(self.standardised(), self.coefficients)),
                            F.lit(self.intercept)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("mean", self.mean())


@dataclass(frozen=True)
class Span:
    """Training rows of one fit: parts below ``part``, of these stages up to ``stage`` if there is one."""

    part: int
    stage: int | None = None

    def within(self, part, stage):
        """For numbers and arrays alike."""
        return part < self.part if self.stage is None else (part < self.part) & (stage <= self.stage)


def _moments(train: DataFrame, columns: Sequence[str], spans: Sequence[Span]):
    """Per span: rows, average target, column means and sample deviations, from totals per part and stage."""
    groups = train.groupBy("_part", "_stage").agg(
        F.count(F.lit(1)).alias("_n"), F.count("target").alias("_known"), F.avg("target").alias("_level"),
        *[F.avg(n).alias(f"_m{i}") for i, n in enumerate(columns)],
        *[F.var_pop(n).alias(f"_v{i}") for i, n in enumerate(columns)]).collect()
    out = []
    for span in spans:
        rows = [g for g in groups if span.within(g["_part"], g["_stage"])]
        n = np.array([g["_n"] for g in rows], float)
        if sum(g["_known"] for g in rows) < max(n.sum(), 1):
            raise ValueError("a fit needs rows, each with a target")
        mean, var = (np.array([[g[f"_{k}{i}"] for i in range(len(columns))] for g in rows]) for k in "mv")
        centre = n @ mean / n.sum()
        spread = n @ (var + (mean - centre) ** 2) / max(n.sum() - 1.0, 1.0)
        steady = spread <= (1e-12 * np.abs(centre)) ** 2
        out.append((n.sum(), n @ [g["_level"] for g in rows] / n.sum(), centre,
                    np.where(steady, 0.0, 1.0 / np.sqrt(np.where(steady, 1.0, spread)))))
    return out


def _newton_sums(columns: Sequence[str], spans: Sequence[Span], centre, scale, betas):
    """Per fit: the objective, its gradient and curvature over the rows of a task, as numbered cells."""
    def run(batches):
        p = len(columns) + 1
        total = np.zeros((len(spans), 1 + p + p * p))
        for batch in batches:
            x = np.ones((batch.num_rows, p))
            for i, n in enumerate(columns):
                x[:, i + 1] = (batch.column(n).to_numpy(zero_copy_only=False) - centre[i]) * scale[i]
            y, part, stage = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("target", "_part", "_stage"))
            # Most fits take the first rows of this order, without a copy.
            order = np.lexsort((part, stage))
            x, y, part, stage = x[order], y[order], part[order], stage[order]
            for out, span, beta in zip(total, spans, betas):
                inside = span.within(part, stage)
                count = np.count_nonzero(inside)
                if not count:
                    continue
                xs, ys = (x[:count], y[:count]) if inside[:count].all() else (x[inside], y[inside])
                with np.errstate(over="ignore", invalid="ignore"):
                    log_mean = xs @ beta
                    mean = np.exp(log_mean)
                    out[0] += mean.sum() - ys @ log_mean
                    out[1:p + 1] += (mean - ys) @ xs
                    out[p + 1:] += ((xs * mean[:, None]).T @ xs).ravel()
        flat = total.ravel()
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(flat))), "value": pa.array(flat)})
    return run


def fit_poisson(train: DataFrame, columns: Sequence[str], spans: Sequence[Span]) -> list[PoissonFit]:
    """Penalised Poisson fits of all ``spans`` by Newton steps, one pass over the rows a step.

    ``train`` has the columns, ``target``, ``_part`` and ``_stage``. Each fit
    minimises the mean of ``mean - target * log(mean)`` plus alpha/2 of the squared
    coefficients of its own standardised columns; a step that does not lower it
    is halved. Only sums leave a task, so rows may be any number.
    """
    p = len(columns) + 1
    train = train.select(*columns, "target", "_part", "_stage")
    moments = _moments(train, columns, spans)
    # Tasks see columns of one scale for all fits; ``turn`` leads from those to the fit's own.
    _, _, centre, scale = max(moments, key=lambda m: m[0])
    scale = np.where(scale > 0, scale, 1.0)
    turns = []
    for _, _, own_centre, own_scale in moments:
        turn = np.diag(np.append(1.0, own_scale / scale))
        turn[0, 1:] = -(own_centre - centre) * own_scale
        turns.append(turn)
    penalty = ALPHA * np.append(0.0, np.ones(p - 1))
    at = [np.append(np.log(max(m[1], 1e-9)), np.zeros(p - 1)) for m in moments]
    kept, best, step = list(at), [np.inf] * len(spans), [np.zeros(p)] * len(spans)
    left = list(range(len(spans)))
    for _ in range(100):
        sums = train.mapInArrow(_newton_sums(columns, [spans[j] for j in left], centre, scale,
                                             [turns[j] @ at[j] for j in left]), "cell long, value double")
        got = {r["cell"]: r["v"] for r in sums.groupBy("cell").agg(F.sum("value").alias("v")).collect()}
        cells = np.array([got[i] for i in range(len(got))]).reshape(len(left), -1)
        stay = []
        for j, row in zip(left, cells):
            row, turn = row / moments[j][0], turns[j]
            value = row[0] + 0.5 * penalty @ at[j] ** 2
            if value <= best[j] + 1e-12 * abs(best[j]) or not np.isfinite(best[j]) and np.isfinite(value):
                kept[j], best[j] = at[j], value
                slope = turn.T @ row[1:p + 1] + penalty * at[j]
                step[j] = -np.linalg.solve(turn.T @ row[p + 1:].reshape(p, p) @ turn + np.diag(penalty), slope)
            else:
                step[j] = 0.5 * step[j]
            at[j] = kept[j] + step[j]
            if np.abs(step[j]).max() > 1e-7:
                stay.append(j)
        left = stay
        if not left:
            break
    return [PoissonFit(tuple(columns), float(b[0]), *(tuple(map(float, v)) for v in (b[1:], m[2], m[3])))
            for b, m in zip(at, moments)]


def fit_estimator(train: DataFrame, kind: str = "glm", columns: Sequence[str] = C.FEATURE_COLUMNS,
                  seed: int = 0) -> PoissonFit | PipelineModel:
    """``train`` has the design columns and ``target``.

    The penalised Poisson fit uses the mean deviance plus alpha/2 of the squared
    coefficients. Spark's boosting has no Poisson loss: kind "gbm" is an approximate
    squared-error analogue.
    """
    # Every pass of a solver reads the rows again: only the design is written, once.
    train = written(train.select(*columns, "target"))
    if kind == "glm":
        return fit_poisson(train.withColumns({"_part": F.lit(0), "_stage": F.lit(0)}), columns, [Span(1)])[0]
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw"),
              GBTRegressor(featuresCol="raw", labelCol="target", predictionCol="mean",
                           maxIter=40, maxDepth=4, stepSize=0.1, minInstancesPerNode=60, seed=seed)]
    return Pipeline(stages=stages).fit(train)


@dataclass(frozen=True)
class RunsModel:
    estimator: PoissonFit | PipelineModel
    width: Width
    kind: str
    columns: tuple[str, ...] = C.FEATURE_COLUMNS

    def raw(self, df: DataFrame) -> DataFrame:
        return self.estimator.transform(design(df, self.columns)).drop("raw", "x")

    def expected(self, features: DataFrame, *kept: str) -> DataFrame:
        """(game_pk, home_mean, away_mean), each within 0.2 and 20, and the columns ``kept``."""
        row = features.withColumn("_row", F.struct(*features.columns))
        home = self.raw(row).select("_row", S.clip(c("mean"), 0.2, 20.0).alias("_home"))
        away = self.raw(mirror(home.select("_row.*", "_home"), self.columns))
        return away.select("game_pk", c("_home").alias("home_mean"), S.clip(c("mean"), 0.2, 20.0).alias("away_mean"),
                           *kept)

    def price(self, features: DataFrame, games: DataFrame, points=C.USUAL_LINES) -> DataFrame:
        lengths = games.select("game_pk", c("scheduled_innings").alias("innings"))
        return P.price_games(self.expected(features).join(lengths, "game_pk", "left"), self.width, points)


def with_outcomes(features: DataFrame, games: DataFrame) -> DataFrame:
    return features.join(games.select("game_pk", *OUTCOMES), "game_pk").where(c("home_score").isNotNull())


def quarter_marks(merged: DataFrame, parts: Sequence[int], folds: int, floor: int) -> list[tuple | None]:
    """Per bound of parts: (day, game) of the last game of all but the latest quarter of the games below it.

    None where either side would be below ``floor``. Days are counted first; only
    the games of the day of a mark are put in order."""
    days = merged.groupBy("_part", "official_date").count().collect()
    found = []
    for bound in parts:
        mine = [d for d in days if d["_part"] < bound]
        total = sum(d["count"] for d in mine)
        cut = total * (folds - 1) // folds
        if cut < floor or total - cut < floor:
            found.append(None)
            continue
        per_day = Counter()
        for d in mine:
            if d["official_date"] is not None:
                per_day[d["official_date"]] += d["count"]
        mark = (max(per_day), per_day[max(per_day)]) if per_day else None
        for day in sorted(per_day):
            if cut <= per_day[day]:
                mark = day, cut
                break
            cut -= per_day[day]
        found.append(mark)
    wanted = [(bound, *mark) for bound, mark in zip(parts, found) if mark]
    if not wanted:
        return found
    near = reduce(DataFrame.unionByName, [
        merged.where((c("_part") < bound) & (c("official_date") == F.lit(day))).select(
            "official_date", "game_pk", F.lit(bound).alias("_bound")) for bound, day, _ in wanted])
    # Read by several jobs.
    placed = position(written(near), ["_bound"], day_order("official_date", "game_pk"), "_at")
    last = {r["_bound"]: r["game_pk"] for r in placed.where(reduce(or_, [
        (c("_bound") == bound) & (c("_at") == at) for bound, _, at in wanted])).collect()}
    return [mark and (mark[0], last[bound]) for bound, mark in zip(parts, found)]


def staged(rows: DataFrame, marks: Sequence[tuple]) -> DataFrame:
    """``_stage``: how many of the marks, in order, lie before a game; null without a day."""
    past = [((c("official_date") > F.lit(day)) | (c("official_date") == F.lit(day)) & (c("game_pk") > F.lit(game)))
            .cast("int") for day, game in marks]
    return rows.withColumn("_stage", reduce(add, past, F.when(c("official_date").isNotNull(), 0)))


def fit_parts(merged: DataFrame, parts: Sequence[int], kind: str = "glm", columns: Sequence[str] = C.FEATURE_COLUMNS,
              seed: int = 0, folds: int = 4, floor: int = 200) -> list[RunsModel]:
    """One model per bound, of the games whose ``_part`` lies below it; its spread is
    measured on their latest quarter by a model of the earlier ones.

    A game belongs to the models of all higher bounds: every pass reads it once
    for all of them."""
    marks = quarter_marks(merged, parts, folds, floor)
    order = sorted({m for m in marks if m})
    merged = staged(merged, order)
    spans = [Span(bound) for bound in parts]
    probes = {i: Span(bound, order.index(mark)) for i, (bound, mark) in enumerate(zip(parts, marks)) if mark}
    if kind == "glm":
        # A null stage is above all others.
        rows = both_dugouts(merged.withColumn("_stage", F.coalesce("_stage", F.lit(len(order) + 1))), columns)
        fits = fit_poisson(rows, columns, [*spans, *probes.values()])
        estimators, probing = fits[:len(spans)], dict(zip(probes, fits[len(spans):]))
    else:
        estimators = [fit_estimator(both_dugouts(merged.where(s.within(c("_part"), c("_stage"))), columns), kind, columns, seed)
                      for s in spans]
        probing = {i: fit_estimator(both_dugouts(merged.where(s.within(c("_part"), c("_stage"))), columns), kind, columns, seed + 1)
                   for i, s in probes.items()}
    widths = _widths(merged, probes, probing, kind, columns)
    walk = P.walk_off_counts(merged, "_part").collect()
    extra = P.extra_innings_counts(merged, "_part").collect()
    out = []
    for i, bound in enumerate(parts):
        edge, margins = P.extra_innings_shares(_below(extra, bound))
        out.append(RunsModel(estimators[i], replace(
            widths.get(i, Width()), home_edge=edge, extra_margins=margins,
            walk_off_margins=P.walk_off_shares(_below(walk, bound))), kind, tuple(columns)))
    return out


def _below(counts, bound: int) -> Counter:
    """Totals of the counts of all parts below ``bound``."""
    out = Counter()
    for row in counts:
        if row["_part"] < bound:
            out.update({k: v for k, v in row.asDict().items() if k != "_part"})
    return out


def _widths(merged: DataFrame, probes: dict[int, Span], probing: dict, kind: str, columns) -> dict[int, Width]:
    """Spread of the games that each probe has not seen."""
    if not probes:
        return {}
    late = {i: (c("_part") < s.part) & (c("_stage") > s.stage) for i, s in probes.items()}

    def misses(rows, score):
        rows = design(rows, columns)
        if kind == "glm":
            held = rows.select(c(score).alias("y"), F.explode(F.array_compact(F.array(*[
                F.when(late[i], F.struct(F.lit(i).alias("model"), probing[i].mean().alias("mu"))) for i in probes]))).alias("h"))
            return held.select("y", "h.*")
        return reduce(DataFrame.unionByName, [probing[i].transform(rows.where(late[i])).select(
            c(score).alias("y"), F.lit(i).alias("model"), c("mean").alias("mu")) for i in probes])

    merged = merged.where(reduce(or_, late.values()))
    counted = written(P.shape_counts(misses(merged, "home_score").withColumn("s", F.lit("home")).unionByName(
        misses(mirror(merged, columns), "away_score").withColumn("s", F.lit("away"))), "y", "mu", ["model", "s"]))
    sized = {(r["model"], r["s"]): r["dispersion"] for r in P.dispersion_from(counted, ["model", "s"]).collect()}
    out = {}
    for i in probes:
        # Away only: it always bats its full length, so its spread is uncensored.
        shape = P.shape_from(counted.where((c("model") == i) & (c("s") == "away"))).first()
        out[i] = Width(dispersion_home=sized.get((i, "home"), C.DEFAULT_DISPERSION),
                       dispersion_away=sized.get((i, "away"), C.DEFAULT_DISPERSION),
                       shape=(shape["scoreless"], shape["tail"]))
    return out


def fit_runs(features: DataFrame, games: DataFrame, kind: str = "glm",
             columns: Sequence[str] = C.FEATURE_COLUMNS, seed: int = 0) -> RunsModel:
    merged = written(with_outcomes(features, games))
    return fit_parts(merged.withColumn("_part", F.lit(0)), [1], kind, columns, seed)[0]


def walk_forward(features: DataFrame, games: DataFrame, seasons: Sequence[int], kind: str = "glm",
                 columns: Sequence[str] = C.FEATURE_COLUMNS, min_train: int = 1500,
                 points=C.USUAL_LINES) -> DataFrame | None:
    """Price each season by a model that saw only earlier ones. Features and
    outcomes are joined once, the models of all seasons fitted side by side and
    their games priced in one job; only unions and tables of a few rows grow
    with the number of seasons."""
    sizes = {r["season"]: r["count"] for r in features.where(c("season").isNotNull()).groupBy("season").count().collect()}
    wanted = [s for s in seasons if sum(n for k, n in sizes.items() if k < s) >= min_train and sizes.get(s)]
    if not wanted:
        return None
    # Read by every pass of the fits, and by the pricing.
    table = written(features.join(games.select("game_pk", *OUTCOMES), "game_pk", "left"))
    played = table.where(c("home_score").isNotNull() & (c("season") < max(wanted))).withColumn("_part", c("season"))
    models = dict(zip(wanted, fit_parts(played, wanted, kind, columns)))
    means = reduce(DataFrame.unionByName, [
        m.expected(table.where(c("season") == s), "season", c("scheduled_innings").alias("innings")) for s, m in models.items()])
    widths = {s: m.width for s, m in models.items()}
    kept = features.sparkSession.createDataFrame(
        [(s, float(w.dispersion_home), float(w.dispersion_away), float(w.shape[0]), float(w.shape[1])) for s, w in widths.items()],
        "season int, dispersion_home double, dispersion_away double, inning_scoreless double, inning_tail double")
    priced = P.price_games(means, widths, points, "season")
    return priced.join(F.broadcast(kept), "season").select(*[n for n in priced.columns if n != "season"], *kept.columns)
