"""Language identification by a byte convolutional network.

Text is UTF-8 bytes in windows of fixed length. Bytes are embedded, filters of
several widths slide over them, the largest response of each filter over the
window goes through a linear layer and softmax. A document's probabilities are
the mean over all its windows. The network is trained in numpy, by Adam, on
windows drawn from all over a bounded sample of labelled documents (``each``
per language, by hash).

Only text and a language that is given are learnt from, and only outside the
held-out fold. Null text and text without a letter are ``und`` with score 0, as
is everything if no label can be learnt. An empty table gives an empty result.
Rows with equal ids are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.llm.common import small_batches
from fungo.llm.sampling import fold, labelled

FOLDS, EACH, PER_TEXT = 5, 256, 4
WINDOW, BATCH = 128, 128
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 12, 6


OVERLAP = max(WIDTHS) - 1


def windows(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last one padded with zeros (a short text is one window).

    They overlap by the widest filter less one, so no run of bytes is cut."""
    step = length - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    out = np.zeros(n * step + OVERLAP, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(out, length)[::step]


class Network:
    def __init__(self, classes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBEDDED)), "out": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, classes)),
                  "bias": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDED), (w * EMBEDDED, FILTERS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables = None

    def pooled(self, x: np.ndarray):
        """Largest response of each filter, its place, and what each filter saw there."""
        e = self.p["embed"][x]
        tops, places = [], []
        for w in WIDTHS:
            n = x.shape[1] - OVERLAP
            kernel = self.p[f"conv{w}"].reshape(w, EMBEDDED, FILTERS)
            out = e[:, :n].reshape(-1, EMBEDDED) @ kernel[0]
            for k in range(1, w):
                out += e[:, k:k + n].reshape(-1, EMBEDDED) @ kernel[k]
            out = out.reshape(len(x), n, FILTERS)
            places.append(out)
            tops.append(out.max(1))
        return e, tops, places

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What two neighbouring bytes add to the filters that start there, and to the wider ones that started two before."""
        def add(w, k):
            return self.p["embed"] @ self.p[f"conv{w}"].reshape(w, EMBEDDED, FILTERS)[k]
        none = np.zeros((256, FILTERS), np.float32)
        head = [add(w, 0)[:, None] + add(w, 1)[None] for w in WIDTHS]
        tail = [add(w, 2)[:, None] + (add(w, 3) if w > 3 else none)[None] for w in WIDTHS if w > 2]
        return (np.concatenate(head, 2).reshape(1 << 16, -1).astype(np.float32),
                np.concatenate(tail, 2).reshape(1 << 16, -1).astype(np.float32))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = self.pair_tables()
        head, tail = self.tables
        pair = x[:, :-1].astype(np.int64) * 256 + x[:, 1:]
        n = x.shape[1] - OVERLAP
        out = np.take(head, pair[:, :n], axis=0)
        out[:, :, FILTERS:] += np.take(tail, pair[:, 2:2 + n], axis=0)
        z = np.maximum(out.max(1), 0) @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, tops, responses = self.pooled(x)
        hidden = np.maximum(np.concatenate(tops, 1), 0)
        z = hidden @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        error = z / z.sum(1, keepdims=True)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        g = {"out": hidden.T @ error, "bias": error.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = (error @ self.p["out"].T) * (hidden > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS:(i + 1) * FILTERS]
            at = responses[i].argmax(1)
            seen = np.stack([e[rows, at + k] for k in range(w)], 2)
            g[f"conv{w}"] = np.einsum("nfke,nf->kef", seen, own).reshape(w * EMBEDDED, FILTERS)
            kernel = self.p[f"conv{w}"].reshape(w, EMBEDDED, FILTERS)
            for k in range(w):
                np.add.at(g["embed"], x[rows, at + k], own[:, :, None] * kernel[k].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        mean, square, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(3))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 64):
                t += 1
                for k, g in self.gradients(x[order[at:at + 64]], y[order[at:at + 64]]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    step[k] = rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step[k]).astype(np.float32)
        return self


def train(docs: DataFrame, each: int = EACH, per_text: int = PER_TEXT) -> tuple[list[str], Network | None]:
    """The languages and a network that tells them apart."""
    @F.pandas_udf("array<binary>")
    def drawn(ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for i, text in zip(ids, texts):
            rows = windows((text or "").encode("utf-8", "replace"))
            pick = np.random.default_rng(abs(int(i))).choice(len(rows), min(per_text, len(rows)), replace=False)
            out.append([rows[j].tobytes() for j in sorted(pick)])
        return pd.Series(out)

    known = docs.where(fold(FOLDS) != 0).where(F.length("text") > 0)
    chosen = labelled(known, "lang", each)  # languages times ``each`` rows
    rows = (known.join(F.broadcast(chosen), "doc_id").where(F.col("lang") == F.col("label"))
            .select("label", F.explode(drawn("doc_id", "text")).alias("w")).orderBy("label", "w").collect())
    names = sorted({r.label for r in rows})
    if not names:
        return [], None
    x = np.array([np.frombuffer(bytes(r.w), np.uint8) for r in rows])
    return names, Network(len(names)).fit(x, np.array([names.index(r.label) for r in rows]))


def identify(docs: DataFrame, each: int = EACH) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per row of docs."""
    small_batches(docs.sparkSession)
    names, network = train(docs.select("doc_id", "text", "lang"), each)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            labels, scores = ["und"] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
            sums = np.zeros((len(texts), max(1, len(names))))
            held, size = [], 0
            for i in own:
                rows = windows(texts.iloc[i].encode("utf-8", "replace"))
                for at in range(0, len(rows), BATCH):  # a very long text goes in several batches
                    held.append((i, rows[at:at + BATCH]))
                    size += len(held[-1][1])
                    if size >= BATCH:
                        flush(held, sums)
                        held, size = [], 0
            flush(held, sums)
            for i in own:
                mean = sums[i] / sums[i].sum()
                labels[i], scores[i] = names[int(mean.argmax())], float(mean.max())
            yield pd.DataFrame({"lang_pred": labels, "score": scores})

    def flush(held, sums):
        if held:
            p = network.probabilities(np.concatenate([r for _, r in held]))
            np.add.at(sums, np.repeat([i for i, _ in held], [len(r) for _, r in held]), p)

    return docs.select("doc_id", (fold(FOLDS) == 0).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")
