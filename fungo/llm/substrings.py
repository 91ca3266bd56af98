"""Substring deduplication: passages of at least ``window`` words that occur twice are removed.

Method: suffix automata of reference shards, with the number of places of each
state; a text streams through the automaton of a shard and its matching
statistics give, word by word, the longest passage that ends there and occurs
at two places; spans of at least ``window`` words go.

The references are all documents, which no executor can hold, so shards are
dealt by content instead of broadcast. Each window of words has an anchor, its
run of ``anchor`` words with the least hash, so equal windows have equal
anchors; consecutive windows of one anchor form a segment. An anchor seen once
holds nothing repeated. Of the others each distinct segment goes once, with its
number of places, to the shard of its anchor; a window belongs to exactly one
segment, so places are not counted twice. What a shard finds in a segment goes
back to all its places by a join. An anchor with more than ``limit`` distinct
segments (the edge of a passage in very many documents) would make an unbounded
shard: its segments are cut into blocks of ``BLOCK`` windows, and a block goes
to the shard of the words that all windows of its full block share. Equal
windows share those, so this is exact too.

Words are compared by 64-bit hashes. Windows are judged on the input. Null text
has no words. Equal rows are copies of each other, so all their windows repeat.
A text shorter than the window stays whole. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.llm.common import landed, numbered, small_batches, stored

WINDOW, ANCHOR, LIMIT, BLOCK = 35, 8, 2048, 4
SHARD_WORDS = 50_000
STEP = 1 << 16
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values."""
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out * FACTOR + h[i:i + len(out)])
    return out


def segments(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first word and number of words of each segment."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = rolled(h, anchor)
    place = np.empty(len(h) - window + 1, np.int64)
    for at in range(0, len(place), STEP):
        view = np.lib.stride_tricks.sliding_window_view(runs[at:at + STEP + window - anchor], window - anchor + 1)
        best = view.argmin(1)
        place[at:at + len(best)] = best + np.arange(at, at + len(best))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return runs[place[first]], first, np.diff(np.concatenate([first, [len(place)]])) + window - 1


SEGMENT = pa.schema([("row_id", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])


def _segments(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            parts = []
            for row, text in zip(b.column("row_id").to_pylist(), b.column("text").to_pylist()):
                h = hashed(words_of(text))
                marks, first, n = segments(h, window, anchor)
                raw = h.tobytes()
                digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a:8 * (a + k)]) for a, k in zip(first.tolist(), n.tolist())),
                                     np.uint64, len(first))
                parts.append((np.full(len(first), row), marks.view(np.int64), digest.view(np.int64), first, n))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), SEGMENT.types)], schema=SEGMENT)
    return run


PART = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("times", pa.int64()), ("crowded", pa.bool_()), ("words", pa.binary())])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed words of the listed segments of each text."""
    for b in batches:
        rows = []
        for text, listed in zip(*(b.column(c).to_pylist() for c in ("text", "listed"))):
            words = words_of(text)
            for s in listed:
                part = hashed(words[s["first"]:s["first"] + s["n"]]).tobytes()
                rows.append((s["anchor"], s["digest"], s["times"], s["crowded"], part))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PART.types)], schema=PART)


class Automaton:
    """Suffix automaton of several sequences; ``places`` counts where the strings of a state end."""

    def __init__(self, sequences: list[tuple[list[int], int]]):
        self.next, self.link, self.length, self.places = [{}], [-1], [0], [0]
        for sequence, times in sequences:
            last = 0
            for word in sequence:
                last = self.extend(last, word)
                self.places[last] += times
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[state]] += self.places[state]

    def add(self, transitions: dict, link: int, length: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.link) - 1

    def split(self, state: int, word: int, target: int) -> int:
        """The target if it is one word longer than the state, else a copy of it that is."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self.add(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self.split(last, word, self.next[last][word])
        new = self.add({}, 0, self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self.split(last, word, self.next[last][word])
        return new

    def spans(self, sequence: list[int], window: int) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of at least ``window`` words that end at two places or more."""
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.places[state] < 2:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window:
                start = i - matched + 1
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, i + 1))
        return out


SPAN = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _match(window: int):
    """Rows come sorted by anchor; whole anchors fill a shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matched(shard):
            sequences = [(np.frombuffer(w, np.uint64).tolist(), times) for _, _, times, w in shard]
            automaton = Automaton(sequences)
            rows = [(anchor, digest, a, z) for (anchor, digest, _, _), (words, _) in zip(shard, sequences)
                    for a, z in automaton.spans(words, window)]
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SPAN.types)], schema=SPAN)] if rows else []

        shard, size, anchor = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "times", "words"))):
                if row[0] != anchor and size >= SHARD_WORDS:
                    yield from matched(shard)
                    shard, size = [], 0
                anchor = row[0]
                shard.append(row)
                size += len(row[3]) // 8
        if shard:
            yield from matched(shard)
    return run


def by_automaton(parts: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, start, stop): what goes of each distinct sequence (anchor, digest, times, words)."""
    return (parts.select("anchor", "digest", "times", "words").repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(_match(window), "anchor long, digest long, start int, stop int"))


BLOCKS = pa.schema([("owner", pa.int64()), ("owner_digest", pa.int64()), ("shift", pa.int32()), ("anchor", pa.int64()),
                    ("digest", pa.int64()), ("times", pa.int64()), ("words", pa.binary())])


def _blocks(window: int, anchor_words: int):
    """Blocks of windows of each segment, keyed by the words that the windows of a full block share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def mark(words: np.ndarray, seed: int = 0) -> int:
            return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes(), seed)).view(np.int64))

        for b in batches:
            rows = []
            for anchor, digest, times, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "times", "words"))):
                h = np.frombuffer(raw, np.uint64)
                place, final = int(rolled(h[:window], anchor_words).argmin()), len(h) - window
                for block in range((place - min(place, final)) // BLOCK, place // BLOCK + 1):
                    top = place - block * BLOCK
                    low, high = max(top - BLOCK + 1, 0), min(top, final)
                    part = h[low:high + window]
                    rows.append((anchor, digest, low, mark(h[top:top - BLOCK + 1 + window], (anchor + block) % (1 << 64)), mark(part), times,
                                 part.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), BLOCKS.types)], schema=BLOCKS)
    return run


def repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, limit: int = LIMIT) -> DataFrame:
    """(row_id, start, stop): spans of words to remove; they may overlap. ``docs`` are rows of files."""
    small_batches(docs.sparkSession)
    texts = numbered(docs.select("text"))
    found = texts.mapInArrow(_segments(window, anchor), "row_id long, anchor long, digest long, first int, n int")
    shared = stored(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"))
    places = stored(found.join(shared, "anchor"))
    distinct = stored(places.groupBy("anchor", "digest").agg(
        F.count("*").alias("times"), F.min(F.struct("row_id", "first", "n")).alias("one")))
    crowded = stored(distinct.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > limit)
                     .select("anchor", F.lit(True).alias("crowded")))
    listed = (distinct.join(crowded, "anchor", "left")
              .select("one.row_id", F.struct("anchor", "digest", "times", F.coalesce("crowded", F.lit(False)).alias("crowded"),
                                             "one.first", "one.n").alias("segment"))
              .groupBy("row_id").agg(F.collect_list("segment").alias("listed")))
    parts = stored(texts.join(listed, "row_id").mapInArrow(
        _words, "anchor long, digest long, times long, crowded boolean, words binary"))
    blocks = stored(parts.where("crowded").mapInArrow(
        _blocks(window, anchor), "owner long, owner_digest long, shift int, anchor long, digest long, times long, words binary"))
    apart = blocks.groupBy("anchor", "digest").agg(F.sum("times").alias("times"), F.min("words").alias("words"))
    back = (blocks.select("owner", "owner_digest", "shift", "anchor", "digest").join(stored(by_automaton(apart, window)), ["anchor", "digest"])
            .select(F.col("owner").alias("anchor"), F.col("owner_digest").alias("digest"),
                    (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop")))
    gone = stored(by_automaton(parts.where("not crowded"), window).unionByName(back))
    return places.join(gone, ["anchor", "digest"]).select(
        "row_id", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))


def _cut():
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, listed in zip(texts, spans):
            words = words_of(text)
            gone = np.zeros(len(words) + 1, np.int64)
            for s in () if listed is None else listed:
                gone[s["start"]] += 1
                gone[s["stop"]] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            kept = [w for w, k in zip(words, stays) if k]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
    return of


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, limit: int = LIMIT) -> DataFrame:
    """row_id, doc_id, n_words, n_removed and kept (the words left, joined by one space), one row per row of docs."""
    docs = landed(docs)
    spans = repeated(docs, window, anchor, limit).groupBy("row_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = numbered(docs.select("doc_id", "text")).join(spans, "row_id", "left")
    return joined.select("row_id", "doc_id", _cut()("text", "spans").alias("c")).select("row_id", "doc_id", "c.*")
