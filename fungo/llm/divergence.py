"""Source divergence audit: how far the vocabularies of the sources of a language lie apart.

Method: length-bucketed packing. A term of up to 8 bytes is one 64-bit word, one
of up to 16 bytes two; a task sorts the words of many terms by radix (16 bits at
a time, stable) and counts runs. Longer terms go to buckets by width (powers of
two) of fixed-width byte strings that are sorted as such. A task counts a few
megabytes of text at a time and merges these counts, so it holds distinct terms
and not occurrences. It lets go of them, one row per source and term, when they
fill its memory or it ends; counts then add up by map-side combining.

Shares ``p`` are whole numbers of billionths, smoothed by two occurrences, and
the divergence of two shares is ``(p - q)**2 / (p + q)``, rounded down. Part
``term`` compares a source with its language and lists the first ``top`` terms
that it uses more; part ``pair`` sums over all kept terms for each pair of
sources. For pairs the sources of a language are dealt to blocks and its terms
to blocks; a task gets two source blocks and one term block, fills a table of
shares and sums over it, so neither all sources nor all terms of a language
meet in one task, and pairs of rows never leave it. A term that a block of
sources lacks adds what two sources without it have between them; that is added
once for all terms.

Null text, lang and source are ''. A group without terms has its pairs, and no
rows of part ``term``. A language of no kept terms has value 0 in all pairs.
Equal rows count as often as they occur; ids are not looked at. A very long text
is held whole by one task and counted in pieces, cut between terms, that merge to
one document; a very long term is one row of its bucket.
Equal values are ranked by item. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fungo.llm.common import small_batches, stored

DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Bytes of text a task sorts and counts at once, and bytes of distinct terms and counts it holds.
PIECE, HELD = 4 << 20, 48 << 20
SOURCES, TERMS = 256, 4096

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, A-Z lowered and a zero byte behind each, and where each starts."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    out = np.zeros(len(data) + len(texts), np.uint8)
    own = np.ones(len(out), bool)
    own[edges[1:] - edges[0] + np.arange(len(texts))] = False
    out[own] = LOWER[data]
    return out, edges[:-1] - edges[0] + np.arange(len(texts))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and number of bytes of each term of data that ends with another byte."""
    inside = LETTER[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.append(0, change)
    return change[::2], change[1::2] - change[::2]


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """A stable order by unsigned keys, least significant first: 16 bits at a time; digits that are all equal are passed over."""
    order = None
    for key in keys:
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = ((key >> key.dtype.type(shift)) & key.dtype.type(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys[0])) if order is None else order


def runs(group: np.ndarray, doc: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, rows and documents of each run; ``same`` tells whether a row has the key of the row before. Documents are in order in a run."""
    new = np.append(True, ~same[1:])
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.append(first, len(group))), np.add.reduceat(other.astype(np.int64), first)


def ordered(group: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by term and group, and which of its rows have the key of the row before."""
    if terms.dtype.itemsize > 16:
        keys = [group, terms]
        order = np.lexsort(keys)
    else:
        words = terms.view(">u8").reshape(len(terms), -1)
        keys = [group, *(words[:, i].astype(np.uint64) for i in reversed(range(words.shape[1])))]
        order = radix_order(keys)
    same = np.ones(len(order), bool)
    same[:1] = False
    for key in keys:
        key = key[order]
        same[1:] &= key[1:] == key[:-1]
    return order, same


def counted(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
    """Group, terms (padded bytes), occurrences and documents of each group and term, one bucket of lengths at a time."""
    padded = np.append(data, np.zeros(16, np.uint8))
    words = np.ndarray((len(padded) - 7,), ">u8", padded.data, strides=(1,))

    def packed(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Up to eight bytes from a place, padded with zero bytes."""
        spare = np.clip(8 - length, 0, 8).astype(np.uint64) * np.uint64(8)
        word = words[np.minimum(at, len(words) - 1)].astype(np.uint64)
        return np.where(spare < 64, (word >> (spare & np.uint64(63))) << (spare & np.uint64(63)), np.uint64(0))

    for width in (8, 16):
        own = np.flatnonzero((size <= width) & (size > width - 8))
        if not len(own):
            continue
        at, length, g, d = start[own], size[own], group[own], doc[own]
        terms = np.stack([packed(at + 8 * i, length - 8 * i) for i in range(width // 8)], 1).astype(">u8").view(f"S{width}")[:, 0]
        yield _bucket(g, terms, d)
    width = 32
    while (size > width // 2).any():
        own = np.flatnonzero((size > max(width // 2, 16)) & (size <= width))
        if len(own):
            terms = np.array([data[a:a + n].tobytes() for a, n in zip(start[own].tolist(), size[own].tolist())], f"S{width}")
            yield _bucket(group[own], terms, doc[own])
        width *= 2


def _bucket(group: np.ndarray, terms: np.ndarray, doc: np.ndarray) -> tuple:
    order, same = ordered(group, terms)
    first, times, docs = runs(group, doc[order], same)
    return group[order[first]], terms[order[first]], times, docs


class Tally:
    """Counts by bucket of lengths; equal groups and terms are added up whenever what is held has grown to ``limit`` bytes and doubled."""

    def __init__(self, limit: int):
        self.limit = self.next = limit
        self.parts: dict[int, list[tuple]] = {}
        self.size = 0

    def add(self, found: Iterator[tuple]) -> None:
        for part in found:
            self.parts.setdefault(part[1].dtype.itemsize, []).append(part)
            self.size += sum(c.nbytes for c in part)
            if self.size >= self.next:
                for _ in self.merged():
                    pass
                self.size = sum(c.nbytes for parts in self.parts.values() for part in parts for c in part)
                self.next = max(self.limit, 2 * self.size)

    def merged(self) -> Iterator[tuple]:
        for width, parts in self.parts.items():
            if len(parts) > 1:
                group, terms, times, docs = (np.concatenate(c) for c in zip(*parts))
                parts.clear()
                order, same = ordered(group, terms)
                first = np.flatnonzero(~same)
                parts.append((group[order[first]], terms[order[first]], np.add.reduceat(times[order], first), np.add.reduceat(docs[order], first)))
            yield parts[0]


def stretches(length: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and end of stretches of at most ``most`` bytes, or of one longer row."""
    edges = np.append(0, np.cumsum(length))
    a = 0
    while a < len(length):
        b = max(int(np.searchsorted(edges, edges[a] + most, "right")) - 1, a + 1)
        yield a, b
        a = b


def pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Data that ends with another byte than a term's, cut behind such bytes: at most ``most`` bytes, or up to the end of a longer term."""
    a = 0
    while a < len(data):
        b = a + most
        if b < len(data):
            other = np.flatnonzero(~LETTER[data[a:b]])
            if len(other):
                b = a + int(other[-1]) + 1
            else:
                while LETTER[data[b:b + most]].all():
                    b += most
                b += int(np.argmin(LETTER[data[b:b + most]])) + 1
        yield data[a:b]
        a = b


COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch], piece: int = PIECE, limit: int = HELD) -> Iterator[pa.RecordBatch]:
    """Counts of as many texts as have ``limit`` bytes of distinct terms and groups. A row without a term marks a group."""
    def emptied():
        langs, sources = (np.array(c, object) for c in zip(*names))
        for a in range(0, len(langs), 50_000):
            n = len(langs[a:a + 50_000])
            yield pa.RecordBatch.from_arrays([
                pa.array(langs[a:a + n], pa.string()), pa.array(sources[a:a + n], pa.string()), pa.nulls(n, pa.binary()),
                *[pa.array(np.zeros(n, np.int64))] * 2], schema=COUNT)
        for group, terms, times, docs in held.merged():
            for a in range(0, len(group), 50_000):
                g = group[a:a + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(langs[g], pa.string()), pa.array(sources[g], pa.string()), pa.array(terms[a:a + 50_000], pa.binary()),
                    pa.array(times[a:a + 50_000]), pa.array(docs[a:a + 50_000])], schema=COUNT)

    names: dict[tuple[str, str], int] = {}
    held, named = Tally(limit), 0
    for b in batches:
        lang, source, text = (pc.fill_null(b.column(c), "") for c in ("lang", "source", "text"))
        for first, end in stretches(pc.binary_length(text).to_numpy().astype(np.int64), piece):
            keys = list(zip(lang[first:end].to_pylist(), source[first:end].to_pylist()))
            named += sum(200 + len(k[0]) + len(k[1]) for k in set(keys) - names.keys())
            groups = np.array([names.setdefault(k, len(names)) for k in keys], np.uint32)
            data, edges = flat(text[first:end])
            if end - first > 1:
                start, size = spans(data)
                doc = np.searchsorted(edges, start, "right") - 1
                held.add(counted(data, start, size, groups[doc], doc))
            else:
                long = Tally(limit)
                for part in pieces(data, piece):
                    start, size = spans(part)
                    long.add(counted(part, start, size, np.repeat(groups, len(start)), np.zeros(len(start), np.int64)))
                held.add((g, terms, times, np.minimum(docs, 1)) for g, terms, times, docs in long.merged())
            if held.next > limit or named > limit // 2:  # a merge left more than half
                yield from emptied()
                names, held, named = {}, Tally(limit), 0
    if names:
        yield from emptied()


def whole(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """Billionths of a smoothed share: 1 + floor(UNIT * (count + 2) / (total + 2 * kinds))."""
    of = (total + 2 * kinds).cast("decimal(28,0)")
    return F.when(of > 0, F.call_function("div", (F.lit(UNIT) * (count + 2).cast("decimal(28,0)")), of).cast("long") + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all terms; term is null in one row per group."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(_counts, "lang string, source string, term binary, n long, docs long")
    return stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def shares(docs: DataFrame, least: int = DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, kinds, none: the share of a term that the group lacks) and terms (lang, source, term, p, q)."""
    found = counts(docs)
    kept = stored(found.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
                  .where(F.col("docs") >= least).select("lang", "term", "all"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all").alias("lang_total"))
    terms = stored(found.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        found.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kinds", "lang_total")))
        .withColumn("none", F.coalesce(share(F.lit(0), F.col("total"), F.col("kinds")), F.lit(0).cast("long"))))
    priced = stored(
        terms.join(groups, ["lang", "source"])
        .select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"),
                share(F.col("all"), F.col("lang_total"), F.col("kinds")).alias("q")))
    return groups, priced


def _pairs(table: pa.Table) -> pa.Table:
    """Sums of divergences between two blocks of sources over a block of terms, less what sources without the terms have between them."""
    named = pc.is_null(table["term"])
    names = table.filter(named).sort_by("source")
    terms = table.filter(pc.invert(named))
    source = names["source"].combine_chunks()
    none, block, kinds = (names[c].to_numpy() for c in ("p", "block", "kinds"))
    term = terms["term"].combine_chunks().dictionary_encode()
    full = np.repeat(none[:, None], len(term.dictionary), 1)
    full[pc.index_in(terms["source"], source).to_numpy(), term.indices.to_numpy()] = terms["p"].to_numpy()
    lang, i, j, t = (table[c][0].as_py() for c in ("lang", "i", "j", "t"))
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    out = []
    for a in first.tolist():
        others = second[second != a]
        p, q = full[a], full[others]
        plain = (none[a] - none[others]) ** 2 // np.maximum(none[a] + none[others], 1)
        value = ((p - q) ** 2 // np.maximum(p + q, 1)).sum(1) + plain * ((kinds[a] if t == 0 else 0) - full.shape[1])
        out.extend([(np.full(len(others), a), others, value)] + [(others, np.full(len(others), a), value)] * (i != j))
    a, b, value = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": source.take(pa.array(a)), "item": source.take(pa.array(b)),
                     "value": pa.array(value, pa.int64())})


def pairs(groups: DataFrame, terms: DataFrame, sources: int = SOURCES, block_terms: int = TERMS) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language."""
    sizes = stored(groups.groupBy("lang").agg(F.count("*").alias("groups"), F.max("kinds").alias("most")).select(
        "lang", F.ceil(F.col("groups") / sources).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.col("most") / block_terms), F.lit(1)).cast("int").alias("slices")))
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    named = (groups.join(sizes, "lang").select("*", own, other)
             .select("lang", "source", F.lit(None).cast("binary").alias("term"), F.col("none").alias("p"), "kinds", "block", "other",
                     F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("t")))
    used = (terms.join(sizes, "lang").select("*", own, other)
            .select("lang", "source", "term", "p", F.lit(0).cast("long").alias("kinds"), "block", "other",
                    F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("t")))
    rows = named.unionByName(used).select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "t", "source", "term", "p", "kinds", "block")
    found = rows.groupBy("lang", "i", "j", "t").applyInArrow(_pairs, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = DOCS, top: int = TOP, sources: int = SOURCES, block_terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and the first terms of each source."""
    groups, terms = shares(docs, least)
    apart = pairs(groups, terms, sources, block_terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    more = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
                                       divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = stored(more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return apart.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def sql(least: int = DOCS, top: int = TOP) -> str:
    p = f"1 + {UNIT}::HUGEINT * (%s + 2) // (%s + 2 * %s)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
  x AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
  c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM x GROUP BY ALL),
  k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {least}),
  v AS (SELECT lang, count(*) AS kinds, sum(total) AS lang_total FROM k GROUP BY lang),
  g AS (SELECT lang, source FROM d GROUP BY ALL),
  f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, kinds, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
          {p % ("k.total", "lang_total", "kinds")} AS q
        FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  s AS (SELECT *, {p % ("n", "total", "kinds")} AS p FROM f),
  pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL),
  parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}"""
