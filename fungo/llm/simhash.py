"""Near-duplicates by SimHash fingerprints of word shingles.

A bit of a fingerprint is 1 if it is set in over half the hashes of a text's
shingles. To find all fingerprints within ``distance`` bits, the 64 bits are
split into ``distance + shared`` blocks: two that differ in at most
``distance`` bits agree on at least ``shared`` blocks, so they meet under some
choice of ``shared`` blocks (pigeonhole). Within such a bucket the Hamming
distance is verified and only a spanning forest of the links leaves the task;
components follow from those.

Only distinct fingerprints are compared, so exact copies cost one row. A bucket
of more than ``bucket`` fingerprints is cut into slices and each pair of slices
is one group, so no task holds more than two slices, and no link is lost.

A text of fewer words than a shingle is one shingle; null text and a text
without words have fingerprint zero and link like any other. An empty table
gives an empty result. Rows with equal ids are documents of their own.

``drop_near`` removes copies by word similarity (Jaccard of the sets of
shingles). Fingerprints within ``distance`` bits, and texts that agree on a band
of minimum hashes, are candidates; candidates form coarse components, and within
each the similarity of all pairs is decided by the sets themselves. A coarse
component too large for a task is cut into slices like a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.llm.common import LOWER, UPPER, components, free_name, landed, numbered, small_batches, stored

SEED = 42
BUCKET = 50_000
#: Least word similarity of near copies. A pair at 0.8 agrees on one of BANDS bands of ROWS minimum hashes with a chance of 0.9994.
SHARE = 0.8
BANDS, ROWS = 40, 8
#: A coarse component is cut into SLICES slices of SLICE[0] to SLICE[1] texts, and none of over SHINGLES shingles on average.
SLICES, SLICE, SHINGLES = 32, (64, 4096), 1_000_000
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle's UTF-8 bytes, in order; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - width, 0)
    spans = zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", last + 1)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of the hashes of a text's shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    return majority(shingles(text, width))


def _fingerprints(width: int):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, width) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))
    return of


def masks(distance: int, shared: int) -> list[int]:
    """A mask, as a signed long, for each choice of ``shared`` out of ``distance + shared`` blocks."""
    blocks = np.array_split(np.arange(64), distance + shared)
    out = []
    for chosen in combinations(blocks, shared):
        mask = sum(1 << int(b) for block in chosen for b in block)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (value, smaller root) that span the components of values within ``distance`` bits of each other.

    Each step takes one value off the queue and finds all unvisited values near it."""
    values = np.unique(values.view(np.uint64))
    links, left = [], values
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                found = left[near]
                links.extend((int(v), int(root)) for v in found.view(np.int64))
                queue.extend(found)
                left = left[~near]
    return [(v, int(np.uint64(r).view(np.int64))) for v, r in links]


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket."""
        def done(parts):
            values = np.concatenate(parts)
            links = forest(values, distance) if len(values) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=LINK)] if links else []

        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("choice", "block", "slice", "other")], 1)
            values = b.column("fp").to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edges = [0, *cut.tolist(), len(values)]
            for s, e in zip(edges, edges[1:]):
                now = tuple(keys[s])
                if now != key and held:
                    yield from done(held)
                    held = []
                key = now
                held.append(values[s:e])
        if held:
            yield from done(held)
    return run


def links(distinct: DataFrame, distance: int, shared: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fp within ``distance`` bits."""
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("block"))
                        for i, m in enumerate(masks(distance, shared))))
    keys = distinct.select("fp", F.explode(choices).alias("k")).select("fp", "k.*")
    large = stored(keys.groupBy("choice", "block").count().where(F.col("count") > bucket)
                   .select("choice", "block", F.ceil(F.col("count") / bucket).cast("int").alias("slices")))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    dealt = (keys.join(large, ["choice", "block"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
             .select("choice", "block", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("j"))
             .select("choice", "block", F.least("own", "j").alias("slice"), F.greatest("own", "j").alias("other"), "fp"))
    order = ["choice", "block", "slice", "other"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verify(distance), "a long, b long")


def near_groups(docs: DataFrame, width: int = 4, distance: int = 4, shared: int = 3, bucket: int = BUCKET) -> DataFrame:
    """row_id, doc_id, fp, component_id (smallest doc_id reachable) and keeper (its row), one row per row of docs."""
    small_batches(docs.sparkSession)
    docs = landed(docs)
    marked = stored(numbered(docs.select("doc_id", "text")).select("row_id", "doc_id", _fingerprints(width)("text").alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_id")).alias("first")
    distinct = stored(marked.groupBy("fp").agg(first))
    roots = components(links(distinct.select("fp"), distance, shared, bucket))
    rooted = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("least")))
    named = stored(rooted.join(least, "root").select("fp", "least"))
    return marked.join(named, "fp").select(
        "row_id", "doc_id", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.row_id").alias("keeper"))


FACTORS = np.random.default_rng(SEED).integers(1 << 32, size=(2, BANDS * ROWS), dtype=np.uint32) | np.array([[1], [0]], np.uint32)


def bands(own: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of minimum hashes of a set of shingles; none of an empty set."""
    import xxhash

    if not len(own):
        return []
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), 256):
        least = np.minimum(least, (short[at:at + 256, None] * FACTORS[0] + FACTORS[1]).min(0))
    keys = np.array([xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, ROWS)], np.uint64)
    return keys.view(np.int64).tolist()


def _sketches(width: int):
    @F.pandas_udf("fp long, same string, n long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for text in texts:
            hashes = shingles(text, width)
            own = np.unique(hashes)
            rows.append((int(np.uint64(majority(hashes)).view(np.int64)), xxhash.xxh3_128_hexdigest(own.tobytes()), len(own), bands(own)))
        return pd.DataFrame(rows, columns=["fp", "same", "n", "bands"])
    return of


def similar(ids: list[int], sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Links (id, root) that span the components of sets whose Jaccard similarity is ``share`` or more.

    As in ``forest``: each step takes one set off the queue and finds all unvisited sets near it."""
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    left, links = np.ones(len(sets), bool), []

    def unvisited(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stays = left[owner]
        return values[stays], owner[stays]
    for root in range(len(sets)):
        if not left[root]:
            continue
        queue, left[root] = [root], False
        values, owner = unvisited(values, owner)
        while queue and len(values):
            at = queue.pop()
            low, high = np.searchsorted(values, sets[at], "left"), np.searchsorted(values, sets[at], "right")
            n = high - low
            met = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            common = np.bincount(met, minlength=len(sets))
            near = np.flatnonzero(left & (common > 0) & (common >= share * (sizes[at] + sizes - common) - 1e-9))
            if len(near):
                links.extend((ids[i], ids[root]) for i in near)
                queue.extend(near.tolist())
                left[near] = False
                values, owner = unvisited(values, owner)
    return links


def _similar(width: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by component and slices."""
        def done(ids, sets):
            links = similar(ids, sets, share) if len(ids) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=LINK)] if links else []

        ids, sets, key = [], [], None
        for b in batches:
            for *now, row, text in zip(*(b.column(c).to_pylist() for c in ("root", "slice", "other", "row_id", "text"))):
                if now != key:
                    yield from done(ids, sets)
                    ids, sets, key = [], [], now
                ids.append(row)
                sets.append(np.unique(shingles(text, width)))
        yield from done(ids, sets)
    return run


def candidates(alike: DataFrame, distance: int, shared: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between rows of alike (node, fp, bands) that agree on a band or have fingerprints within ``distance`` bits."""
    keys = alike.select("node", F.posexplode("bands").alias("band", "key"))
    least = stored(keys.groupBy("band", "key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"))
    banded = keys.join(least, ["band", "key"]).select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    first = stored(alike.groupBy("fp").agg(F.min("node").alias("node")))
    equal = alike.select("fp", F.col("node").alias("a")).join(first.withColumnRenamed("node", "b"), "fp").select("a", "b")
    near = (links(first.select("fp"), distance, shared, bucket).toDF("x", "y")
            .join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y").select("a", "b"))
    return banded.unionByName(equal.where("a <> b")).unionByName(near.where("a <> b"))


def verified(docs: DataFrame, coarse: DataFrame, width: int, share: float) -> DataFrame:
    """(a, b): links whose components are those of all pairs of a coarse component (node, root, n) with similarity ``share``."""
    most = F.least(F.greatest(F.ceil(F.col("texts") / SLICES), F.lit(SLICE[0])), F.lit(SLICE[1]))
    sliced = stored(coarse.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
                    .select("root", F.greatest(F.ceil(F.col("texts") / most), F.ceil(F.col("n") / SHINGLES)).cast("int").alias("slices")))
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    dealt = stored(coarse.join(sliced, "root")
                   .select("root", F.col("node").alias("row_id"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("j"))
                   .select("root", "row_id", F.least("own", "j").alias("slice"), F.greatest("own", "j").alias("other")))
    order = ["root", "slice", "other"]
    return (numbered(docs.select("text")).join(dealt, "row_id").select(*order, "row_id", "text")
            .repartition(*order).sortWithinPartitions(*order).mapInArrow(_similar(width, share), "a long, b long"))


def near_rows(docs: DataFrame, width: int = 5, distance: int = 6, shared: int = 3, share: float = SHARE) -> DataFrame:
    """row_id and keeper (the row that stays of its component), one row per row of docs; null and wordless texts are alike."""
    small_batches(docs.sparkSession)
    docs = landed(docs)
    marked = stored(numbered(docs.select("doc_id", "text")).select("row_id", "doc_id", _sketches(width)("text").alias("s"))
                    .select("row_id", "doc_id", "s.*"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_id")).alias("first")
    alike = stored(marked.groupBy("same").agg(first, F.min("fp").alias("fp"), F.max("n").alias("n"), F.min("bands").alias("bands"))
                   .withColumn("node", F.col("first.row_id")))
    coarse = components(candidates(alike.where("n > 0"), distance, shared))
    coarse = stored(coarse.join(alike.select("node", "n"), "node"))
    roots = components(verified(docs, coarse, width, share))
    rooted = stored(alike.join(roots, "node", "left").select("same", "first", F.coalesce("root", "node").alias("root")))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("least")))
    named = stored(rooted.join(least, "root").select("same", F.col("least.row_id").alias("keeper")))
    return marked.select("row_id", "same").join(named, "same").select("row_id", "keeper")


def drop_near(docs: DataFrame, width: int = 5, distance: int = 6, shared: int = 3, share: float = SHARE) -> DataFrame:
    """One document of each group stays: the one with the smallest id. All columns pass unchanged.

    A group is a component of the pairs whose sets of shingles have a Jaccard similarity of ``share`` or more."""
    docs = landed(docs)
    gone = stored(near_rows(docs, width, distance, shared, share).where("row_id <> keeper").select("row_id"))
    name = free_name(docs, "row_id")
    return (numbered(docs, name).join(gone.withColumnRenamed("row_id", name), name, "left_anti")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
