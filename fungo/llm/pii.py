"""Personal data by candidate generation and gradient boosting.

Base patterns find e-mail addresses, IP addresses, card numbers and phone
numbers; these spans always stay. High-recall generators then propose looser,
overlapping spans of the same kinds (spelled-out addresses, IPv6, numbers
without a country code, other separators). Boosted trees score each proposal by
its format and its context; a proposal is added if its calibrated score reaches
the threshold of its kind and no base span or better proposal overlaps it.

The trees are fitted on a bounded sample of documents that hold a digit or an
at sign (``sample`` documents of the least hash, at most ``most`` examples).
Positive are base spans, and rewrites of them in their own place: spelled-out
addresses, IPv6, numbers without a plus, other separators; these are what can
be added. Negative are numbers set at other places of the same documents
(dates, amounts, versions, counters), and proposals that meet no base span,
unless a word before them announces personal data or, of cards, their digits
pass Luhn: of those the truth is not known, and they are left out. On a third
of the sample held out, scores are calibrated by a logistic fit and each kind
gets the least threshold at which its precision over spans that can be added
is ``precision``; a kind that never gets there adds nothing.

Null text is empty and has no spans, as an empty table has no rows. Rows with
equal ids are judged alike. Offsets are code points, ends exclusive. Of equal scores
the first proposal wins. A very long text is searched once per pattern, and
overlaps are found in order of place. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fungo.llm.boosting import Boosted, sigmoid
from fungo.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE, MOST, PRECISION = 2000, 20_000, 0.98
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Equal to the plain patterns, without rescanning long runs of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)|\bat\b) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\bdot\b) ?[A-Za-z0-9-]++)+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{2,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9])")),
)
#: Words that announce personal data, by kind.
CUES = {"email": "mail email e-mail contact write", "ip": "ip host server address addr", "card": "card visa credit iban account",
        "phone": "phone tel telephone call mobile fax cell"}
CUES = {kind: frozenset(words.split()) for kind, words in CUES.items()}


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        local = text[low:at]
        start, low = at - len(local) + len(local.rstrip(LOCAL)), at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            low = m.end()
        at = text.find("@", low)
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    out.append((m.start(), kind, m.end()))
    return sorted(out)


MAY_SPELL = re.compile(r"@|\bat\b")


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose and base spans. A generator is passed over only where it cannot match."""
    digit = DIGIT.search(text) is not None
    may = {"email": MAY_SPELL.search(text) is not None, "ip": ":" in text, "card": digit, "phone": digit}
    found = {(m.start(), KINDS.index(kind), m.end()) for kind, pattern in LOOSE if may[kind] for m in pattern.finditer(text)}
    return sorted(found.union(base))


#: Ways to write what the base patterns do not take; {a} the part before, {b} the part behind the sign.
SPELLED = ("{a} [at] {b}", "{a} (at) {b}", "{a} at {b}", "{a}[at]{b}")
DOTS = (".", " dot ", " [dot] ", " (dot) ")
MARKS = (".", "/", "_", "-", " ", "")


def rewritten(kind: int, body: str, draw: np.random.Generator) -> str:
    """A base span in a form of the same kind that the base pattern does not take whole."""
    pick = lambda values: values[int(draw.integers(len(values)))]
    if kind == 0:
        local, _, domain = body.partition("@")
        return pick(SPELLED).format(a=local, b=domain.replace(".", pick(DOTS)))
    digits = re.sub("[^0-9]", "", body)
    if kind == 1:
        groups = ["%x" % int(draw.integers(1, 1 << 16)) for _ in range(int(draw.integers(4, 9)))]
        return ":".join(groups)
    if kind == 2:
        mark = pick(MARKS[:3])
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    mark = pick((" ", "-", ".", "/"))
    parts = [digits[:2], *(digits[i:i + 3] for i in range(2, len(digits), 3))]
    return pick(("00", "(0", "0")) + mark.join(parts) if draw.random() < 0.5 else mark.join(parts)


def plain(draw: np.random.Generator) -> str:
    """A number that is no personal data."""
    n = lambda low, high: int(draw.integers(low, high))
    forms = (f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d} {n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", f"{n(1, 10**9)}.{n(0, 100):02d}",
             f"v{n(0, 20)}.{n(0, 50)}.{n(0, 999)}.{n(0, 9999)}", f"#{n(10**6, 10**12)}", f"{n(1, 10**4)} {n(1, 10**4)} {n(1, 10**4)}",
             f"{n(1000, 10**4)}/{n(1000, 10**4)}/{n(10, 10**4)}", f"{n(10**7, 10**15)}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}:{n(0, 99):02d}")
    return forms[n(0, len(forms))]


#: Characters of context kept around an example; rewrites of a base span, and plain numbers set in a document.
AROUND, REWRITES, PLAIN = 64, 8, 4


def examples(key: int, text: str) -> list[tuple[list[float], float, bool]]:
    """Features, truth and whether the span could be added, of the examples of a document."""
    draw, base, out = np.random.default_rng(key % (1 << 63)), base_spans(text), []
    own, meets = set(base), Meeting(base)

    def inside(left: str, body: str, right: str, kind: int | None) -> None:
        """Proposals in a text with ``body`` set between two others: right if they are the body whole, wrong if it is no personal data."""
        near = left[-AROUND:] + body + right[:AROUND]
        start = len(left[-AROUND:])
        for s in proposals(near, []):
            if kind is None and s[0] < start + len(body) and s[2] > start:
                out.append((features(near, s), 0.0, True))
            elif kind is not None and (s[0], s[2]) == (start, start + len(body)):
                out.append((features(near, s), float(s[1] == kind), True))

    for s in proposals(text, base):
        if s in own:
            out.append((features(text, s), 1.0, False))
            for _ in range(REWRITES):
                inside(text[:s[0]], rewritten(s[1], text[s[0]:s[2]], draw), text[s[2]:], s[1])
        elif not meets(s):
            x = features(text, s)
            digits = re.sub("[^0-9]", "", text[s[0]:s[2]])
            if not x[-1] and not (s[1] == 2 and luhn(digits)) and s[1] in (2, 3):
                out.append((x, 0.0, True))
    gaps = [m.start() for m in re.finditer(" ", text[:20_000])]
    for at in sorted(draw.choice(gaps, min(PLAIN, len(gaps)), replace=False).tolist()) if gaps else ():
        inside(text[:at + 1], plain(draw), text[at:], None)
    return out


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    body, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 24]
    digits = sum(c in "0123456789" for c in body)
    words = re.findall("[a-z-]+", before.lower())[-3:]
    groups = [len(g) for g in re.findall("[0-9]+", body)] or [0]
    return [*(float(kind == k) for k in range(len(KINDS))), len(body), digits, digits / len(body), body.count("."), body.count("-"),
            body.count(" "), body.count("("), body.count("@"), body.count(":"), float(body[0] == "+"), float(body[0] == "0"),
            len(groups), max(groups), min(groups), float(before[-1:].isalnum()), float(after[:1].isalnum()),
            float(before[-1:] in "@.:/-_#$%&="), float(after[:1] in "@.:/-_#$%&="), float(before[-1:].isspace() or not before),
            sum(c in "0123456789" for c in before) / 24, sum(c in "0123456789" for c in after) / 24,
            float(any(w in CUES[KINDS[kind]] for w in words))]


class Meeting:
    """Whether a span overlaps any of some others, which are kept in order of place."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s[0] for s in sorted(spans)]
        self.ends = list(itertools.accumulate((s[2] for s in sorted(spans)), max))  # the furthest end so far

    def __call__(self, span: tuple[int, int, int]) -> bool:
        before = bisect_left(self.starts, span[2])
        return before > 0 and self.ends[before - 1] > span[0]


class Model:
    """Trees, their calibration and the threshold of each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float, free: np.ndarray | None = None):
        """``free`` marks the examples that could be added; thresholds are read off those alone."""
        free = np.ones(len(y), bool) if free is None else free
        self.slope, self.shift, self.least = 1.0, 0.0, [2.0] * len(KINDS)
        self.trees = None
        if min(y[~held].sum(), (1 - y[~held]).sum(), held.sum()) < 1:
            return
        self.trees = Boosted().fit(x[~held], y[~held])
        held = held & free
        if not held.any():
            self.trees = None
            return
        raw, truth = self.trees.score(x[held]), y[held]
        for _ in range(50):  # Newton steps of a logistic fit of truth on the raw score
            p = sigmoid(self.slope * raw + self.shift)
            w = p * (1 - p) + 1e-6
            design = np.stack([raw, np.ones_like(raw)], 1)
            step = np.linalg.solve((design * w[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (truth - p) - 1e-3 * np.array([self.slope, self.shift]))
            self.slope, self.shift = self.slope + step[0], self.shift + step[1]
        score = self.probability(x[held])
        for k in range(len(KINDS)):
            own = x[held][:, k] == 1
            order = np.argsort(-score[own], kind="stable")
            right = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero((right >= precision) & (np.arange(1, own.sum() + 1) >= 10))
            if len(good):
                self.least[k] = max(float(score[own][order][good[-1]]), 0.5)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.trees.score(x) + self.shift)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        meets = Meeting(base)
        found = [s for s in proposals(text, base) if not meets(s)] if self.trees else []
        if not found:
            return []
        score = self.probability(np.array([features(text, s) for s in found]))
        out: list[tuple[int, int, int]] = []
        for i in np.argsort(-score, kind="stable").tolist():
            s = found[i]
            if score[i] < self.least[s[1]]:
                continue
            at = bisect_left(out, s)  # those kept so far do not overlap
            if (at == 0 or out[at - 1][2] <= s[0]) and (at == len(out) or out[at][0] >= s[2]):
                out.insert(at, s)
        return out


def train(docs: DataFrame, sample: int = SAMPLE, most: int = MOST, precision: float = PRECISION) -> Model:
    @F.pandas_udf("array<struct<x: array<double>, y: double, held: boolean, free: boolean>>")
    def listed(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y, "held": key % 3 == 0, "free": free} for x, y, free in examples(key, text)]
                          for key, text in zip(ids, texts)])

    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    marked = docs.where("text rlike '[@0-9]'").select(key.alias("key"))
    chosen = marked.distinct().orderBy("key").limit(sample)  # a documented bound, so it can be broadcast
    rows = (docs.select(key.alias("key"), "text").join(F.broadcast(chosen), "key", "left_semi")
            .select("key", F.explode(listed("key", "text")).alias("e")).select("key", "e.*").orderBy("key", "x", "y").limit(most).collect())
    width = len(features("0", (0, 0, 1)))
    x = np.array([r.x for r in rows], float).reshape(-1, width)
    return Model(x, np.array([r.y for r in rows], float), np.array([r.held for r in rows], bool), precision,
                 np.array([r.free for r in rows], bool))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def find(docs: DataFrame, sample: int = SAMPLE, most: int = MOST, precision: float = PRECISION) -> DataFrame:
    """doc_id, text, counts of the base spans, base and all spans as text, redacted text; one row per row of docs."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = train(docs, sample, most, precision)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, spans string, redacted string")
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base = base_spans(text)
                spans = sorted(base + model.added(text, base))
                parts, at = [], 0
                for start, kind, end in spans:
                    if start >= at:
                        parts.append(f"{text[at:start]}<{KINDS[kind]}>")
                    at = max(at, end)
                parts.append(text[at:])
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))), said(base),
                             hashlib.sha256(said(base).encode()).hexdigest(), said(spans), "".join(parts)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "spans", "redacted"])
    return docs.select("doc_id", "text", spans_of("text").alias("s")).select("doc_id", "text", "s.*")
