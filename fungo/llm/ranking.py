"""Quality scores by Bradley-Terry ranking.

Each document has a score, linear in its features; of a pair of a good and a bad
document, the chance that the good one is preferred is the logistic function
of the difference of scores. The weights minimise the logistic loss over
preference pairs of all labelled documents, by Newton steps with a ridge penalty:
documents of either label are numbered along a hash, and each of the label with
more of them meets ``meets`` of the other, in turn, so that every one is in a
pair. Slopes and curvatures are sums over tasks; the driver solves one system of
the size of the features per step. A document is good if its score reaches a
quantile of the scores of all learnable documents, found by rank: the share of
bad labels among them. Scores are moved so that this threshold is 0.7 on a scale
of 0 to 1.

Only labels outside the held-out fold are learnt from; label, language, source
and id are no features. Null and empty texts have features of zero and are
scored like any other. Without labels of both kinds every score is 0.7. An
empty table gives an empty result. Rows with equal ids are judged by their
text; of a learnable id's rows the one of least features is learnt from. Equal
scores get equal verdicts. A very long text is read whole by one task. Features
are written once, beside the checkpoints, and read by every later step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.llm.boosting import sigmoid
from fungo.llm.common import small_batches, stored
from fungo.llm.fertility import repeated_words
from fungo.llm.sampling import fold
from fungo.operators.prefix import id_order, position

#: The ridge is per pair. Ranges of rows that are numbered at once hold about PART_ROWS.
FOLDS, HELD, MEETS, RIDGE, PART_ROWS = 4, 2, 8, 1 / 20_000, 1 << 12
THRESHOLD = 0.7
MARKS = "#*$%&|<>{}[]_~^=+\\/@"
STOPS = ".,;:!?"


def features(text: str) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    words = text.split()
    n, size = max(len(words), 1), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = size - len(words) + 1
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marks = sum(map(text.count, MARKS))
    ends = sum(map(text.count, STOPS))
    bangs = text.count("!") + text.count("?")
    bars = text.count("|")
    top = max(counts.values(), default=0)
    again = repeated_words([w.encode("utf-8", "surrogatepass") for w in words]) / n
    twins = sum(a == b for a, b in zip(words, words[1:])) / n
    distinct = len(counts) / n
    doubled = 1 - len(set(lines)) / max(len(lines), 1)
    digits = sum(map(text.count, "0123456789"))
    return [marks / size, min(marks / n, 2.0), upper / n, min(bangs / n, 1.0), min(bars / n, 1.0), top / n, again, twins, distinct,
            doubled, min(np.log1p(n), 12.0), min(letters / n, 20.0) / 10, min(ends / n, 2.0), digits / size,
            float(marks > 0.05 * n), float(upper > 0.2 * n), float(bars > 0.05 * n), float(again > 0.3), float(twins > 0.1),
            float(doubled > 0.2), float(n < 50)]


NAMES = ("marks marks_per_word upper bangs bars top_word repeated twins distinct doubled_lines log_words letters_per_word "
         "stops digits many_marks much_upper many_bars much_repeated many_twins many_doubled short").split()


def pairs(learn: DataFrame, counts: dict[int, int], meets: int) -> DataFrame:
    """Feature differences of good less bad documents, ``meets`` for each of the label with more documents."""
    placed = position(learn.select("label", F.xxhash64("doc_id").alias("mark"), "doc_id", "x"), ["label"],
                      id_order("mark", "doc_id"), "at", PART_ROWS)
    placed = stored(placed.select("label", (F.col("at") - 1).alias("at"), "x"))
    more = max((1, 0), key=lambda k: counts[k])
    many = placed.where(F.col("label") == more).select(
        F.col("x").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(meets - 1))).alias("k"), "at").select(
        "own", ((F.col("at") * meets + F.col("k")) % counts[1 - more]).alias("at"))
    met = many.join(placed.where(F.col("label") != more).select("at", "x"), "at")
    sign = 1.0 if more else -1.0
    return stored(met.select(F.zip_with("own", "x", lambda a, b: (a - b) * sign).alias("d")))


def slopes(w: np.ndarray, scale: np.ndarray):
    """Sums over a task's pairs: gradient, then curvature, by place."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            d = np.array(batch["d"].tolist()).reshape(-1, len(w)) / scale
            p = sigmoid(d @ w)
            g += d.T @ (1 - p)
            h += (d * (p * (1 - p))[:, None]).T @ d
        yield pd.DataFrame({"at": np.arange(len(w) * (len(w) + 1)), "value": np.concatenate([g, h.ravel()])})
    return run


def fit(differences: DataFrame, scale: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    w, n = np.zeros(len(scale)), len(scale)
    penalty = ridge * differences.count()
    for _ in range(30):
        sums = differences.mapInPandas(slopes(w, scale), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        got = np.array([r.value for r in sorted(sums.collect(), key=lambda r: r.at)])  # features squared, whatever the rows
        g, h = got[:n] - penalty * w, got[n:].reshape(n, n) + penalty * np.eye(n)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray | None = None
    centre: np.ndarray | float = 0.0
    scale: np.ndarray | float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), THRESHOLD) if self.weights is None else sigmoid(self.raw(x) + self.shift)


def scored(how):
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(how(np.array(x.tolist()).reshape(-1, len(NAMES))))
    return of


def train(seen: DataFrame, labels: DataFrame, meets: int = MEETS) -> Ranker:
    """``seen`` has doc_id and features x; every labelled document outside the held-out fold is learnt from."""
    known = labels.where(fold(FOLDS) != HELD).where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    learn = stored(seen.select("doc_id", "x").join(known.distinct(), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")))
    counts = {0: 0, 1: 0} | {r.label: r["count"] for r in learn.groupBy("label").count().collect()}  # two rows
    if not counts[0] or not counts[1]:
        return Ranker()
    moments = learn.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    moments = sorted(moments.collect(), key=lambda r: r.at)  # a row per feature
    centre, scale = np.array([r.m for r in moments]), np.array([r.s for r in moments]) + 1e-6
    ranker = Ranker(fit(pairs(learn, counts, meets), scale), centre, scale)
    scores = stored(learn.select(scored(ranker.raw)("x").alias("score"), F.xxhash64("doc_id").alias("mark"), "doc_id", "label"))
    ends = position(scores, [], id_order("score", "mark", "doc_id", "label"), "at", PART_ROWS).where(
        F.col("at").isin(counts[0], counts[0] + 1)).select("score").collect()  # two rows
    middle = sum(r.score for r in ends) / len(ends)
    return replace(ranker, shift=float(np.log(THRESHOLD / (1 - THRESHOLD)) - middle))


def rank(docs: DataFrame, labels: DataFrame, meets: int = MEETS) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in texts])

    seen = stored(docs.select("doc_id", of("text").alias("x")))
    ranker = train(seen, labels, meets)
    return seen.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), scored(ranker.score)("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
