"""Quality rules on tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated word windows. Of
texts that pass them, a public vocabulary with byte fallback measures
characters per token, the share of byte tokens and the token entropy: the mean of
consecutive windows of a fixed number of tokens, divided by that of tokens all
different. A window is no longer than the least number of words that pass, so
every measured text has one and texts of all lengths are compared alike. Each measure has a band per language (per script
where the language is null): the quartiles of all measured documents of the
language, widened by ``reach`` interquartile ranges. A text outside a band is
rejected.

Quartiles come from counts over all documents on a fixed grid, so they do not
depend on partitions. Null text has no words and fails the base rules; so do
empty texts. Rows with equal ids are judged alike. An empty table gives an
empty result. ``passing`` returns all columns unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fungo.llm.common import free_name, landed, numbered, small_batches, stored
from fungo.llm.tokens import vocabulary_path

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
GRID = 500
#: Tokens of a window of the entropy: under MIN_WORDS, as a word is at least one token.
WINDOW = 48
#: Measure: least interquartile range, so that a language of few or equal texts keeps a band.
MEASURES = {"chars_per_token": 0.08, "byte_share": 0.02, "entropy": 0.02}
REACH = 2.5
#: First code points of the scripts told apart.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"),
           (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


def script(text: str) -> str:
    """The script of most letters; ``none`` without letters."""
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return "none"
    place = np.searchsorted([s for s, _ in SCRIPTS], points, "right") - 1
    names = sorted({n for _, n in SCRIPTS})
    own = np.array([names.index(n) for _, n in SCRIPTS])[place]
    return names[int(np.bincount(own).argmax())]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, back, count = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = np.concatenate([(count > 1)[back], [False, False]])
    again[1:] |= again[:-1].copy()
    inside = again.copy()
    inside[1:] |= again[:-1]
    return int(inside.sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").strip()]
    return (len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def entropy(ids: np.ndarray, window: int = 256) -> float:
    """Mean token entropy of consecutive windows over that of tokens all different. The last window ends with the text."""
    n = min(window, len(ids))
    if n < 2:
        return 0.0
    whole = len(ids) // n
    rows = ids[: whole * n].reshape(whole, n)
    if len(ids) % n:
        rows = np.concatenate([rows, ids[None, -n:]])
    rows = np.sort(rows, axis=1)
    starts = np.ones(rows.shape, bool)
    starts[:, 1:] = rows[:, 1:] != rows[:, :-1]
    runs = np.diff(np.append(np.flatnonzero(starts), rows.size))
    return float(1 - (runs * np.log2(runs)).sum() / (rows.size * np.log2(n)))


def _measure(path: str):
    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
                  "language string, chars_per_token double, byte_share double, entropy double")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_file=path)
        size = coder.get_piece_size()
        is_byte = np.array([coder.is_byte(i) for i in range(size)])
        for texts, langs in batches:
            rows = []
            for text, lang in zip(texts, langs):
                base = counts(text)
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED * base[0]
                if failed:
                    rows.append((*base, True, None, None, None, None))
                    continue
                ids = np.array(coder.encode(text.encode("utf-8", "replace").decode()), np.int64)
                rows.append((*base, False, lang or script(text), len(text) / len(ids), float(is_byte[ids].mean()), entropy(ids, WINDOW)))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "base_failed", "language", *MEASURES])
            yield out.astype({m: "float64" for m in MEASURES})
    return measure


def measured(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> Column:
    small_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return _measure(vocabulary_path(vocabulary))(F.coalesce("text", F.lit("")), lang)


def bands(measures: DataFrame, reach: float = REACH) -> DataFrame:
    """language and the lower and upper bound of each measure. One row per language."""
    long = measures.where("not base_failed").select("language", F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * GRID).cast("long").alias("bin")) for m in MEASURES))).alias("x"))
    binned = long.groupBy("language", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("language", "measure")
    upto = binned.select("language", "measure", "bin", F.sum("n").over(whole.orderBy("bin")).alias("upto"),
                         F.sum("n").over(whole).alias("all"))

    def quartile(q: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))) / GRID
    least = reduce(lambda c, m: c.when(F.col("measure") == m, F.lit(MEASURES[m])), MEASURES, F.when(F.lit(False), 0.0))
    ends = (upto.groupBy("language", "measure").agg(quartile(1).alias("low"), quartile(3).alias("high"))
            .withColumn("reach", F.greatest(F.col("high") - F.col("low"), least) * reach))
    return ends.groupBy("language").agg(
        *(F.max(F.when(F.col("measure") == m, F.col("low") - F.col("reach"))).alias(f"{m}_low") for m in MEASURES),
        *(F.max(F.when(F.col("measure") == m, F.col("high") + F.col("reach"))).alias(f"{m}_high") for m in MEASURES))


def kept() -> Column:
    inside = reduce(lambda c, m: c & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), MEASURES, F.lit(True))
    return ~F.col("base_failed") & F.coalesce(inside, F.lit(False))


def judged(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", reach: float = REACH) -> DataFrame:
    """row_id, doc_id, the counts, the measures and kept, one row per row of docs."""
    docs = landed(docs)
    found = stored(numbered(docs).select("row_id", "doc_id", measured(docs, vocabulary).alias("m")).select("row_id", "doc_id", "m.*"))
    limits = stored(bands(found, reach))
    return found.join(limits, "language", "left").withColumn("kept", kept())


def passing(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", reach: float = REACH) -> DataFrame:
    """The rows of docs that all rules keep."""
    docs = landed(docs)
    rows = stored(judged(docs, vocabulary, reach).where("not kept").select("row_id"))
    name = free_name(docs, "row_id")
    return (numbered(docs, name).join(rows.withColumnRenamed("row_id", name), name, "left_anti")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
