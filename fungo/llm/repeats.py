"""Suffix-array deduplication: strings of at least ``window`` bytes that start at two places are removed.

Method: an enhanced suffix array (suffixes in order, common prefixes of
neighbours, the byte to the left of each). One scan with a stack walks the tree
of common-prefix intervals; an interval of at least ``window`` bytes whose
occurrences have different bytes to their left is a maximal repeat, and all its
occurrences are known, not just neighbours. Every repeated string lies in a
maximal repeat at each of its places, so the occurrences cover what goes.

No task can hold the suffix array of a corpus, so it is built in shards that
are dealt by content. Each window has an anchor, its run of ``gram`` bytes with
the least hash, so equal windows have equal anchors; consecutive windows with
their anchor at one place form a segment of less than two windows. An anchor
that is seen once holds nothing repeated. Of the others each distinct segment
goes once, with its number of places, to the shard of its anchor: a window lies
in one segment only, so no place is counted twice. What a shard finds in a
segment goes back to all its places by a join.

An anchor with more than ``limit`` distinct segments (the edge of a passage in
very many documents) is dealt anew: its segments are cut into blocks of
``BLOCK`` windows, and a block goes to the shard of the bytes that all windows
of its full block share. Equal windows share those, so this is exact as well;
distinct blocks of a shard then differ in a few bytes at the ends only.

Texts are UTF-8 bytes; null is empty. Strings are judged on the input. Equal
rows are copies of each other, so all they hold from ``window`` bytes on goes.
A shorter text stays whole. A very long text is cut into segments piece by
piece. Rows with equal or null ids are documents of their own. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.llm.common import landed, numbered, small_batches, stored

WINDOW, GRAM, LIMIT, BLOCK = 200, 32, 4096, 4
SHARD_BYTES = 400_000
STEP = 1 << 16
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a value in which its place in a piece is kept.
PLACE = np.uint64((1 << 17) - 1)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the edges between them."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if edges[-1] == edges[0]:
        return np.zeros(0, np.uint8), edges - edges[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[edges[0]:edges[-1]], edges - edges[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_at(data: np.ndarray, spare: int) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``spare`` zero bytes follow the data."""
    padded = np.zeros(len(data) + spare, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes (8 times a power of two), by doubling."""
    h, size = mixed(words_at(data, 0) * FACTOR), 8
    while size < gram:
        h = mixed(h[:-size] * FACTOR + h[size:])
        size *= 2
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each run of ``width``, the first where values tie."""
    ranked = (values & ~PLACE) | np.arange(len(values), dtype=np.uint64)
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        ranked = np.minimum(ranked[:-size], ranked[size:])
        size *= 2
    return (np.minimum(ranked[:n], ranked[width - size:width - size + n]) & PLACE).astype(np.int64)


def segments(data: np.ndarray, edges: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, anchor hash, first byte (of all data) and number of bytes of each segment, piece by piece."""
    for at in range(0, len(data) - window + 1, STEP):
        n = min(STEP, len(data) - window + 1 - at)
        h = grams(data[at:at + n + window - 1], gram)
        place = least(h, window - gram + 1)
        a, z = np.searchsorted(edges, (at, at + n - 1), "right") - 1
        texts = np.arange(a, z + 1)
        inside = np.clip(edges[a + 1:z + 2], at, at + n) - np.clip(edges[a:z + 1], at, at + n)
        text = np.repeat(texts, inside)
        valid = np.arange(at, at + n) + window <= edges[text + 1]
        first = valid.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        first = np.flatnonzero(first)
        if len(first):
            ends = np.flatnonzero(valid & ~np.append(valid[1:] & (place[1:] == place[:-1]), False))
            yield text[first], h[place[first]], first + at, ends - first + window


SEGMENT = pa.schema([("row_id", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("first", pa.int64()), ("n", pa.int32())])


def table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _segments(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            data, edges = flat(b.column("text"))
            rows, view = b.column("row_id").to_numpy(zero_copy_only=False), memoryview(data)
            for text, anchor, first, n in segments(data, edges, window, gram):
                own = np.fromiter((digest(view[f:f + k]) for f, k in zip(first.tolist(), n.tolist())), np.uint64, len(first))
                yield table([rows[text], anchor.view(np.int64), own.view(np.int64), first - edges[text], n], SEGMENT)
    return run


PART = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("times", pa.int64()), ("crowded", pa.bool_()), ("body", pa.binary())])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed segments of each text."""
    for b in batches:
        data, edges = flat(b.column("text"))
        raw, rows = memoryview(data), []
        for start, listed in zip(edges.tolist(), b.column("listed").to_pylist()):
            for s in listed:
                first = start + s["first"]
                rows.append((s["anchor"], s["digest"], s["times"], s["crowded"], bytes(raw[first:first + s["n"]])))
        if rows:
            yield table(list(zip(*rows)), PART)


def suffix_array(bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``window`` bytes: body and offset of each, their order, the common
    prefix of each in order with the one before (0 for the first), and the byte to the left
    of each in order (a number of its own at the start of a body)."""
    count = np.array([max(len(s) - window + 1, 0) for s in bodies], np.int64)
    owner = np.repeat(np.arange(len(bodies)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    suffixes = [s[i:] for s, k in zip(bodies, count.tolist()) for i in range(k)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
    size = np.array([len(s) for s in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    place = (np.cumsum(size) - size)[owner] + offset
    p, room = place[order], (size[owner] - offset)[order]
    words = words_at(data, 16)
    common = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    most = np.minimum(room[1:], room[:-1])
    done = 0
    while len(open_):
        differ = words[np.minimum(p[open_] + done, len(words) - 1)] ^ words[np.minimum(p[open_ - 1] + done, len(words) - 1)]
        low = differ & (~differ + np.uint64(1))
        common[open_] = done + np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        done += 8
        open_ = open_[(differ == 0) & (most[open_ - 1] > done)]
    common[1:] = np.minimum(common[1:], most)
    left = np.where(offset > 0, data[np.maximum(place - 1, 0)].astype(np.int64), -1 - np.arange(len(owner)))[order]
    return owner, offset, order, common, left


#: Bytes to the left that differ.
DIVERSE = -(1 << 62)


def maximal(common: np.ndarray, left: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(first, last, length) in suffix order of each maximal repeat of at least ``window`` bytes, inner ones before outer ones.

    The stack holds the open intervals: length, first place and the byte to the left, or DIVERSE."""
    out: list[tuple[int, int, int]] = []
    runs = np.flatnonzero(common >= window)
    if not len(runs):
        return out
    cut = np.flatnonzero(np.diff(runs) > 1) + 1
    prefixes, lefts = common.tolist(), left.tolist()
    for a, z in zip(runs[np.append(0, cut)].tolist(), runs[np.append(cut - 1, len(runs) - 1)].tolist()):
        stack: list[list[int]] = []
        for i in range(a, z + 2):
            now = prefixes[i] if i <= z else 0
            first, seen = i - 1, lefts[i - 1]
            while stack and stack[-1][0] > now:
                length, first, held = stack.pop()
                seen = held if held == seen else DIVERSE
                if seen == DIVERSE:
                    out.append((first, i - 1, length))
            if stack and stack[-1][0] == now:
                if stack[-1][2] != seen:
                    stack[-1][2] = DIVERSE
            elif i <= z:
                stack.append([now, first, seen])
    return out


def occurrences(bodies: list[bytes], times: list[int], window: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Body and offset of each suffix; and the maximal repeats, outer ones before inner ones: length and suffixes.

    A body at several places is a repeat of its whole length."""
    owner, offset, order, common, left = suffix_array(bodies, window)
    found = [(length, order[first:last + 1]) for first, last, length in reversed(maximal(common, left, window))]
    several = np.flatnonzero((offset == 0) & (np.array(times)[owner] > 1)) if len(owner) else owner
    found.extend((len(bodies[owner[i]]), np.array([i])) for i in several.tolist())
    return owner, offset, found


def covered(bodies: list[bytes], times: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Body, start and stop of each stretch that the maximal repeats cover."""
    owner, offset, found = occurrences(bodies, times, window)
    longest = np.zeros(len(owner), np.int64)
    for length, where in found:
        longest[where] = np.maximum(longest[where], length)
    start = np.flatnonzero(longest)
    if not len(start):
        return start, start, start
    of, at = owner[start], offset[start]
    base = of << 32  # bodies apart, so that stops of one never reach another
    stop = np.maximum.accumulate(base + at + longest[start])
    new = np.append(True, base[1:] + at[1:] > stop[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return of[new], at[new], stop[last] - base[last]


SPAN = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


GROUP = pa.schema([("repeat", pa.int64()), ("length", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64()), ("start", pa.int32())])


def _shards(report):
    """Rows come sorted by anchor; whole anchors fill a shard, which ``report`` turns into batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, bodies, size = [], [], [], 0
        for b in batches:
            for anchor, digest, n, body in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "times", "body"))):
                if size >= SHARD_BYTES and anchor != keys[-1][0]:
                    yield from report(np.array(keys, np.int64), times, bodies)
                    keys, times, bodies, size = [], [], [], 0
                keys.append((anchor, digest))
                times.append(n)
                bodies.append(body)
                size += len(body)
        if keys:
            yield from report(np.array(keys, np.int64), times, bodies)
    return run


def _spans(window: int):
    def report(keys: np.ndarray, times: list[int], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        of, start, stop = covered(bodies, times, window)
        if len(of):
            yield table([keys[of, 0], keys[of, 1], start, stop], SPAN)
    return report


def _groups(window: int):
    def report(keys: np.ndarray, times: list[int], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        import xxhash

        owner, offset, found = occurrences(bodies, times, window)
        for length, where in found:
            of, at = owner[where], offset[where]
            string = bodies[of[0]][at[0]:at[0] + length]
            name = np.full(len(of), xxhash.xxh3_64_intdigest(string) - (1 << 63))
            yield table([name, np.full(len(of), length), keys[of, 0], keys[of, 1], at], GROUP)
    return report


BLOCKS = pa.schema([("owner", pa.int64()), ("owner_digest", pa.int64()), ("shift", pa.int32()), ("anchor", pa.int64()),
                    ("digest", pa.int64()), ("times", pa.int64()), ("body", pa.binary())])


def _blocks(window: int, gram: int):
    """Blocks of windows of each segment, keyed by the bytes that the windows of a full block share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for anchor, digest, times, body in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "times", "body"))):
                place = int(least(grams(np.frombuffer(body, np.uint8)[:window], gram), window - gram + 1)[0])
                final = len(body) - window
                for block in range((place - min(place, final)) // BLOCK, place // BLOCK + 1):
                    top = place - block * BLOCK
                    low, high = max(top - BLOCK + 1, 0), min(top, final)
                    core = body[top:top - BLOCK + 1 + window]
                    part = body[low:high + window]
                    key = xxhash.xxh3_64_intdigest(core, (anchor + block) % (1 << 64))
                    rows.append((anchor, digest, low, key - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), times, part))
            if rows:
                yield table(list(zip(*rows)), BLOCKS)
    return run


def shards(parts: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, start, stop): what goes of each distinct body (anchor, digest, times, body)."""
    return (parts.select("anchor", "digest", "times", "body").repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(_shards(_spans(window)), "anchor long, digest long, start int, stop int"))


def dealt(docs: DataFrame, window: int, gram: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Places (row_id, anchor, digest, first, n) of all segments of shared anchors, and their distinct bodies
    (anchor, digest, times, crowded, body)."""
    texts = numbered(docs.select("text"))
    found = stored(texts.mapInArrow(_segments(window, gram), "row_id long, anchor long, digest long, first long, n int"))
    shared = stored(found.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))
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
        _bodies, "anchor long, digest long, times long, crowded boolean, body binary"))
    return places, parts


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(row_id, start, stop): spans of bytes to remove; they may overlap. ``docs`` are rows of files."""
    places, parts = dealt(docs, window, gram, limit)
    spans = shards(parts.where("not crowded"), window)
    blocks = stored(parts.where("crowded").mapInArrow(
        _blocks(window, gram), "owner long, owner_digest long, shift int, anchor long, digest long, times long, body binary"))
    apart = blocks.groupBy("anchor", "digest").agg(F.sum("times").alias("times"), F.min("body").alias("body"))
    back = (blocks.select("owner", "owner_digest", "shift", "anchor", "digest").join(stored(shards(apart, window)), ["anchor", "digest"])
            .select(F.col("owner").alias("anchor"), F.col("owner_digest").alias("digest"),
                    (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop")))
    gone = stored(spans.unionByName(back))
    return places.join(gone, ["anchor", "digest"]).select(
        "row_id", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))


def _cut():
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, listed in zip(texts, spans):
            start = np.array([s["start"] for s in listed], np.int64)
            order = np.argsort(start, kind="stable")
            start = start[order]
            stop = np.maximum.accumulate(np.array([s["stop"] for s in listed], np.int64)[order])
            new = np.append(True, start[1:] > stop[:-1])
            start, stop = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
            kept = b"".join(text[a:z] for a, z in zip([0, *stop.tolist()], [*start.tolist(), len(text)]))
            rows.append((len(text), len(text) - len(kept), len(start), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
    return of


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """row_id, doc_id, n_bytes, n_removed, n_spans and kept (the bytes left), one row per row of docs."""
    small_batches(docs.sparkSession)
    docs = landed(docs.select("doc_id", "text"))
    spans = stored(repeated(docs, window, gram, limit).groupBy("row_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    texts = numbered(docs).withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    cut = texts.join(spans, "row_id").select("row_id", "doc_id", _cut()("text", "spans").alias("c")).select("row_id", "doc_id", "c.*")
    whole = texts.join(spans.select("row_id"), "row_id", "left_anti").select(
        "row_id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept"))
    return cut.unionByName(whole)


def repeat_groups(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(repeat, length, row_id, start): every occurrence of each maximal repeat, maximal within the segments of its anchor.

    ``repeat`` is a hash of the string. No anchor is dealt anew here, so a shard may be as large as its anchor."""
    small_batches(docs.sparkSession)
    places, parts = dealt(landed(docs.select("text")), window, gram, 1 << 62)
    found = (parts.select("anchor", "digest", "times", "body").repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(_shards(_groups(window)), "repeat long, length int, anchor long, digest long, start int"))
    return places.join(found, ["anchor", "digest"]).select("repeat", "length", "row_id", (F.col("first") + F.col("start")).alias("start"))
