"""Brute-force versions of the SimHash, packing, mixing and exact deduplication operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fungo.llm import common, exact, mixing, packing, simhash, tokens
from fungo.llm.queries import QUERIES
from fungo.session import ship_package

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string"
LONG = "word " * 30000
ODD = [(1, None, None, None, 0, "x"), (2, "", "en", "a", 0, "x"), (3, " \n\t", "en", "a", 3, "x"), (4, LONG, "en", "a", 1, "x"),
       (5, LONG, "en", "b", 1, "x"), (6, "One two  three", "en", "b", 1, None), (6, "One two  three", "en", "b", 1, None),
       (7, "one TWO three", "fr", "c", 1, "x"), (None, "One two\nthree", "de", None, 1, "x"), (None, None, None, None, None, None),
       (8, "é Ä ß ſ ⱥ İ 日本語 <|endoftext|> it's 5²", "de", "c", 1, "x"), (9, "a\x00b \x1c c\x1fd", "de", "c", 1, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    ship_package(spark)
    return common.stored(spark.createDataFrame(ODD, SCHEMA))


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, distance):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_simhash_query(spark, rows):
    rows = sorted(rows)
    prints = [slow_fingerprint(t, 4) for _, t, _ in rows]
    want = {d: (f"{p:016x}", rows[r][0]) for (d, _, _), p, r in zip(rows, prints, slow_components(prints, 4))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, FOLDER).collect()}
    assert got == want


def test_simhash_chains_in_large_buckets(spark):
    """A chain of near fingerprints is one component, however buckets are sliced."""
    ship_package(spark)
    rng = np.random.default_rng(3)
    chain = [int(rng.integers(1 << 62))]
    for _ in range(300):
        chain.append(chain[-1] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    far = [int(x) for x in rng.integers(1 << 62, size=200)]
    signed = [x - (1 << 64) if x >> 63 else x for x in {*chain, *far}]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    values = [x % (1 << 64) for x in signed]
    want = defaultdict(set)
    for x, r in zip(signed, slow_components(values, 4)):
        want[r].add(x)
    for bucket in (7, 50_000):
        roots = {r.node: r.root for r in common.components(simhash.links(df, 4, 3, bucket)).collect()}
        got = defaultdict(set)
        for x in signed:
            got[roots.get(x, x)].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_rows(odd):
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r.fp == 0]
    assert {r.component_id for r in zero} == {1} and len(zero) == 4
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r.keeper for r in simhash.near_groups(odd, 5, 6).collect()})
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 90)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 90)}}


def test_exact_odd_rows(odd):
    want = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ODD]
    sizes = Counter(norm)
    for small in (16, exact.PIECE):
        got = exact.groups(odd, small).collect()
        assert len(got) == len(ODD) and sum(r.kept for r in got) == len(sizes)
        for r in got:
            ids = [(d is None, d) for (d, *_), t in zip(ODD, norm) if hashlib.sha256(t.encode()).hexdigest() == r.sha]
            assert r.group_size == len(ids) and r.keep_id == min(ids, key=lambda x: (x[0], x[1] or 0))[1]
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(sizes)
    assert exact.groups(odd.limit(0)).count() == 0
    assert not want


def test_polynomials_combine(spark):
    data = bytes(range(256)) * 67
    whole = exact.polynomial(data)
    a, b = data[:5001], data[5001:]
    joined = [(x * pow(base, len(b), exact.PRIME) + y) % exact.PRIME
              for x, y, base in zip(exact.polynomial(a), exact.polynomial(b), exact.BASES)]
    slow = []
    for base in exact.BASES:
        h = 0
        for c in data:
            h = (h * base + c + 1) % exact.PRIME
        slow.append(h)
    assert whole == joined == slow


def test_equal_fingerprints_of_different_texts_part(spark, odd, monkeypatch):
    monkeypatch.setattr(exact, "fingerprints", lambda docs, piece: common.stored(
        common.numbered(docs.select("doc_id", "text")).select(
            "row_id", "doc_id", F.sha2(exact.normalised(F.col("text")), 256).alias("sha"), F.lit(1).alias("size"),
            *(F.lit(0).alias(h) for h in exact.HASHES))))
    got = exact.groups(odd).collect()
    sizes = Counter(r.sha for r in got)
    assert all(r.group_size == sizes[r.sha] for r in got) and sum(r.kept for r in got) == len(sizes)


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in full}, **share}
        full |= over


def test_mixing(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op5_mixing"](spark, FOLDER).collect()}
    again = {r.doc_id: r for r in QUERIES["op5_mixing"](spark, FOLDER).collect()}
    assert got == again and len(got) == len(rows)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    total = Counter()
    for d, _, s in rows:
        total[s] += size[d]
    target = slow_targets(total)
    taken, largest = Counter(), Counter()
    for d, _, s in rows:
        r = got[d]
        assert r.size == size[d] and r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], size[d])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)


def test_mixing_odd_rows(odd, spark):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and {r.target for r in got if r.source_size == 0} <= {0.0}
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r.copies for r in got if r["size"])
    assert mixing.mix(odd.limit(0)).count() == 0
    caps = spark.createDataFrame([("a", 5), ("b", 1000), ("c", 20), ("d", 1), (None, 300), ("e", 0)], "source string, source_size long")
    want = slow_targets({r.source: r.source_size for r in caps.collect()})
    assert {r.source: r.target for r in mixing.targets(caps).collect()} == pytest.approx(want)


def check_pieces(pieces, texts, length):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
    ids = Counter((d, tuple(coder.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in texts)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes)))
    assert all(n == length or n < length and n & (n - 1) == 0 for n in sizes)
    assert sum(sizes) == sum(len(x) * n for (_, x), n in ids.items())
    return ids


def test_packing(spark, rows):
    pieces = [r.asDict() for r in QUERIES["op4_packing"](spark, FOLDER).collect()]
    ids = {d: np.array(x, "<u4") for d, x in check_pieces(pieces, [(d, t) for d, t, _ in rows], 2048)}
    ends = Counter()
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == ends[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"]:p["start"] + p["length"]].tobytes())
        ends[p["doc_id"]] += p["length"]
    assert all(ends[d] == len(x) for d, x in ids.items())


def test_packing_odd_rows(odd):
    pieces = [r.asDict() for r in packing.pack(odd, 64).collect()]
    ids = check_pieces(pieces, [r[:2] for r in ODD], 64)
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(d for d, x in ids.elements())
    assert packing.pack(odd.limit(0)).count() == 0


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_word_tokens_are_those_of_the_tokenizer(rows):
    from tokenizers import Tokenizer, models
    import json

    path = tokens.vocabulary_path("word_bpe_49k.json")
    coder = tokens.WordTokens(path)
    texts = [t or "" for _, t, _ in rows] + [r[1] or "" for r in ODD] + ["".join(map(chr, range(1, 0x24F))), "O'Brien'S x'll 'tis"]
    want = [e.ids for e in coder.exact.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(texts)] == want
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    bare = models.BPE(vocab=vocab, merges=[tuple(m) for m in model["merges"]])
    for word, i in vocab.items():
        if word.startswith("<|"):
            continue
        whole = word.endswith(end) and len(word) > len(end)
        alone = coder.exact.model.tokenize(word[: -len(end)]) if whole else bare.tokenize(word)
        assert [t.id for t in alone] == [i], word
