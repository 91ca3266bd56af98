"""Brute-force versions of whitening, divergence audit and suffix-array deduplication; row numbers, word blocks, spans that can be added."""

import random
import re
import textwrap
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fungo.llm import bidiagonal, common, divergence, exact, fertility, licenses, packing, pii, repeats, tokens, whitening
from fungo.llm.queries import QUERIES
from fungo.session import ship_package

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, _metadata string, term string, anchor int"
LONG = "Lorem ipsum, dolor! " * 20000
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, LONG, "en", "a"), (5, LONG, "en", "b"), (6, "One two", "en", "b"),
       (6, "One two", "en", "b"), (7, "x" * 900, "fr", "c"), (None, "One two\nthree", "de", None), (None, None, None, None),
       (8, "é Ä ß ſ ⱥ İ 日本語 <|endoftext|> it's 5²", "de", "c"), (9, "a\x00b \x1c c\x1fd" + "é" * 40000, "de", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    ship_package(spark)
    return spark.createDataFrame([(*r, 1, "x", "m", "t", 3) for r in ODD], SCHEMA)


def uncovered(texts, window):
    """Bytes, removed bytes, removed runs and what is left of each text, from a count of all windows."""
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)


def mosaics(seed, n=60):
    draw = random.Random(seed)
    letters = ["ab", "abcdefgh", "aéß日"][seed % 3]
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 300))) for _ in range(6)]
    texts = []
    for _ in range(n):
        cuts = [(draw.choice(base), draw.randint(0, 200), draw.randint(0, 120)) for _ in range(draw.randint(0, 4))]
        texts.append("".join(b[i:i + k] for b, i, k in cuts))
    return [*texts, "a" * 150, "a" * 90, "ab" * 60, None, "", texts[0], texts[0]]


@pytest.mark.parametrize("seed,limit", [(0, 4096), (1, 4096), (2, 4096), (3, 1), (4, 2), (5, 1)])
def test_repeats_against_all_windows(spark, seed, limit):
    texts = mosaics(seed)
    ship_package(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs, 40, 8, limit).collect()}
    assert [got[i] for i in range(len(texts))] == list(uncovered([(t or "").encode() for t in texts], 40))


def test_repeat_query_on_whole_table(spark):
    docs = common.documents(spark, FOLDER).select("doc_id", "text").collect()
    want = {r.doc_id: w[:3] for r, w in zip(docs, uncovered([(r.text or "").encode() for r in docs], 200))}
    got = QUERIES["op13_repeats"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == want and any(w[1] for w in want.values())


def test_repeat_groups_hold_all_occurrences(spark):
    texts = mosaics(1)
    docs = common.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    text = {r.row_id: (r.text or "").encode() for r in common.numbered(docs).select("row_id", "text").collect()}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(docs, 40, 8).collect():
        groups[r["repeat"], r.length].add((r.row_id, r.start))
    assert groups
    for (_, length), places in groups.items():
        strings = {text[row][at:at + length] for row, at in places}
        assert len(strings) == 1 and len(places) > 1
        string = strings.pop()
        assert places == {(row, i) for row, t in text.items() for i in range(len(t)) if t[i:i + length] == string}


def test_maximal_repeats_of_a_suffix_array():
    bodies = [b"xabcdefgh1", b"yabcdefgh2", b"xabcdefgZZ"]
    owner, offset, found = repeats.occurrences(bodies, [1, 1, 1], 4)
    got = {(length, frozenset(zip(owner[w].tolist(), offset[w].tolist()))) for length, w in found}
    # a suffix of fewer than four bytes counts no more, so each group holds one length
    assert (8, frozenset({(0, 1), (1, 1)})) in got and (7, frozenset({(0, 1), (1, 1), (2, 1)})) in got and (8, frozenset({(0, 0), (2, 0)})) in got
    assert len(got) == 3


def test_repeats_odd_rows(odd):
    got = repeats.without_repeats(odd).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got if r.n_bytes < 200)
    by = {r.doc_id: r for r in got if r.doc_id}
    assert (by[4].n_removed, by[4].kept) == (len(LONG), b"") and by[7].n_removed == 900 and by[6].n_removed == 0
    assert bytes(by[9].kept) == "a\x00b \x1c c\x1fd".encode() and by[9].n_spans == 1
    assert repeats.without_repeats(odd.limit(0)).count() == 0


def audit_sql(spark, docs, **kw):
    db = duckdb.connect()
    db.register("documents", docs.select("text", "lang", "source").toPandas().astype(object).where(lambda t: t.notna(), None))
    return sorted(db.sql(divergence.sql(**kw)).fetchall())


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 50), (1, 7)])
def test_divergence_against_sql(spark, blocks):
    ship_package(spark)
    docs = common.documents(spark, FOLDER)
    got = sorted(tuple(r) for r in divergence.audit(docs, 3, 4, *blocks).collect())
    assert got == audit_sql(spark, docs, least=3, top=4) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_odd_rows(spark, odd):
    for least in (1, 2, 10):
        assert sorted(tuple(r) for r in divergence.audit(odd, least).collect()) == audit_sql(spark, odd, least=least)
    assert {r.value for r in divergence.audit(odd).collect()} == {0}
    assert divergence.audit(odd.limit(0)).count() == 0


def test_terms_of_all_lengths_are_counted():
    draw = np.random.default_rng(3)
    terms = [bytes(draw.choice(np.frombuffer("abz\xc3\xa9\xff".encode("latin-1"), np.uint8), n)) for n in draw.integers(1, 70, 400)] * 3
    terms += [b"a" * n for n in range(1, 140)] + [b"a"] * 5
    draw.shuffle(terms)
    data = np.frombuffer(b"".join(t + b" " for t in terms), np.uint8)
    start, size = divergence.spans(data)
    doc, group = np.arange(len(terms)) // 7, (np.arange(len(terms)) // 7 % 3).astype(np.uint32)
    want, docs = Counter(zip(group.tolist(), terms)), defaultdict(set)
    for g, t, d in zip(group.tolist(), terms, doc.tolist()):
        docs[g, t].add(d)
    got = {}
    for g, t, n, k in divergence.counted(data, start, size, group, doc):
        for key, *v in zip(zip(g.tolist(), t), n.tolist(), k.tolist()):
            assert key not in got
            got[key] = v
    assert got == {k: [n, len(docs[k])] for k, n in want.items()}
    key = draw.integers(0, 1 << 63, 5000).astype(np.uint64) % np.uint64(1 << 20)
    assert (divergence.radix_order([key]) == np.argsort(key, kind="stable")).all()


def batches_of(rows, n):
    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "text")])
    return (pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i:i + n]], schema) for i in range(0, len(rows), n))


@pytest.mark.parametrize("piece,limit", [(16, 1), (100, 2000), (4096, 20_000), (divergence.PIECE, divergence.HELD)])
def test_counts_in_pieces_are_those_of_whole_texts(piece, limit):
    draw = random.Random(piece)
    words = ["".join(draw.choice("abC\u00e9") for _ in range(draw.choice([1, 2, 3, 7, 9, 15, 17, 40, 90]))) for _ in range(60)]
    rows = [(draw.choice([None, "en", "de"]), draw.choice("abc"), draw.choice(" 7\n").join(draw.choices(words, k=draw.choice([0, 1, 5, 60])))) for _ in range(150)]
    rows += [("en", "a", None), ("en", "a", "x" * 5000 + " y"), ("en", "a", "one two " * 3000), ("fr", None, "z" * 300), ("fr", None, "")]
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        found = Counter(re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower()))
        n.update({(lang or "", source or "", t): k for t, k in found.items()})
        docs.update((lang or "", source or "", t) for t in found)
    got = [r for b in divergence._counts(batches_of(rows, 40), piece, limit) for r in b.to_pylist()]
    for column, want in (("n", n), ("docs", docs)):
        total = Counter()
        for r in got:
            if r["term"] is not None:
                total[r["lang"], r["source"], r["term"]] += r[column]
        assert total == want
    assert {(r["lang"], r["source"]) for r in got if r["term"] is None} == {(lang or "", source or "") for lang, source, _ in rows}


def test_counting_holds_distinct_terms_and_not_occurrences():
    draw = np.random.default_rng(5)
    words = np.array(["".join(map(chr, draw.integers(97, 123, n))) for n in draw.integers(2, 9, 2000)])
    rows = [("en", "abc"[i % 3], " ".join(words[draw.integers(0, 2000, 500)])) for i in range(8000)]
    held = list(batches_of([*rows, ("en", "a", " ".join(r[2] for r in rows[:4000]))], 1000))
    tracemalloc.start()
    size = sum(b.num_rows for b in divergence._counts(iter(held)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == 6003 - 3 * (2000 - len(set(words))) and peak < 150e6


MATRICES = {
    "plain": lambda r: r.standard_normal((200, 24)), "graded": lambda r: r.standard_normal((200, 24)) * 10.0 ** -np.arange(0, 8, 1 / 3),
    "equal": lambda r: np.linalg.qr(r.standard_normal((60, 24)))[0], "near": lambda r: np.diag(1 + np.arange(24) * 1e-11),
    "clusters": lambda r: np.diag(np.repeat([3.0, 2.0, 2 * (1 + 1e-9), 1.0], 6)) @ np.linalg.qr(r.standard_normal((24, 24)))[0],
    "copies": lambda r: np.hstack([x := r.standard_normal((90, 12)), x]), "few": lambda r: r.standard_normal((3, 24)),
    "zero": lambda r: np.zeros((4, 24)), "one": lambda r: r.standard_normal((9, 1))}


@pytest.mark.parametrize("name", MATRICES)
def test_bidiagonal_solver(name):
    a = MATRICES[name](np.random.default_rng(5))
    r = whitening.triangle(a)
    r = np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
    values, found = bidiagonal.right_vectors(r)
    want = np.linalg.svd(a)[1] ** 2
    want = np.append(want, np.zeros(len(values) - len(want)))
    big = want > want[0] * 1e-22
    assert (np.diff(values) <= 0).all() and np.allclose(values[big], want[big], rtol=1e-7 if name == "graded" else 1e-12)
    assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-11
    assert np.abs(r.T @ (r @ found) - found * values).max() <= 1e-13 * max(values[0], 1e-300) * len(values)
    main, upper, right = bidiagonal.bidiagonal(r)
    b = np.diag(main) + np.diag(upper, 1)
    assert np.allclose(right @ b.T @ b @ right.T, r.T @ r, atol=1e-12 * max(values[0], 1))


def whitened_rows(spark, rows, **kw):
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, x int"), **kw)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return out.collect()


def test_whitening_against_numpy(spark):
    ship_package(spark)
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    c = np.array([r.embedding for r in rows], float)
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    d = (n * x - total) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    e, v = e[::-1], v[:, ::-1]
    place = {r.vec_id: i for i, r in enumerate(rows)}
    got = np.zeros((n, 32))
    for r in QUERIES["op11_whitening"](spark, FOLDER).collect():
        i, k = place[r.vec_id], r.component - 1
        got[i, k] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[i] - total) ** 2).sum()) and r.identity_error < 1e-10
        assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    want = d @ v[:, :32] / np.sqrt(e[:32])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8


def test_whitening_odd_rows(spark):
    ship_package(spark)
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 1.0]), (1, [1.0, 2.0, 1.0]), (None, [3.0, 4.0, 3.0]), (2, [0.0, 7.5, 0.0])]
    bad = [(3, None), (4, [None, 1.0, 1.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [-inf, 0.0, 0.0]), (8, []), (9, [1.0])]
    got = whitened_rows(spark, [(*r, "c", 1) for r in good + bad])
    assert sorted((r.vec_id or 0) for r in got) == [0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 2]
    assert {r.whitened for r in got if r.component == 3} == {0.0} and got[0].identity_error < 1e-10
    assert sum(r.explained for r in got if r.vec_id == 2) == pytest.approx(1)
    assert [r.whitened for r in whitened_rows(spark, [(1, [5.0, 6.0], "c", 1)] * 3)] == [0.0] * 6
    assert whitened_rows(spark, [(*r, "c", 1) for r in bad[:5]]) == []
    huge = whitened_rows(spark, [(1, [1e30, 1.0], "c", 1), (2, [-1e30, 1.0], "c", 1)])
    assert {r.deviation for r in huge} == {None} and sorted(abs(r.whitened) for r in huge if r.component == 1) == pytest.approx([1, 1])
    many = [(i, [float(i % 7), float(i % 5), 1.0], "c", 1) for i in range(500)]
    assert {r.component for r in whitened_rows(spark, many, components=2)} == {1, 2}


def test_factors_merge_in_a_tree(spark, monkeypatch):
    ship_package(spark)
    rows = np.random.default_rng(8).integers(0, 1000, (700, 5))
    vectors = common.stored(spark.createDataFrame([(i, list(map(int, r))) for i, r in enumerate(rows)], "vec_id long, x array<long>").repartition(40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    n, total = whitening.sums(vectors)
    r = whitening.factor(vectors, n, total)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    d = rows - rows.mean(0)
    assert n == 700 and total == rows.sum(0).tolist() and np.allclose(r.T @ r, d.T @ d)


def test_row_numbers_need_files(spark, odd):
    with pytest.raises(ValueError):
        common.numbered(odd)
    rows = common.numbered(common.landed(odd), "_row")
    assert rows.columns == [*odd.columns, "_row"] and rows.select("_row").distinct().count() == len(ODD)
    files = common.stored(odd)
    assert common.landed(files) is files and common.numbered(files.select("_metadata", "text")).select("row_id").distinct().count() == len(ODD)
    assert common.numbered(common.landed(odd.limit(0))).count() == 0


def test_neighbours_on_the_curve_are_nearer_than_random_pairs(spark):
    ship_package(spark)
    coder = tokens.word_tokens(tokens.vocabulary_path("word_bpe_49k.json"))
    table = packing.signs(np.arange(len(coder.last)))
    texts = [r.text for r in common.documents(spark, "/root/testdata/sf0.01").collect() if len(r.text or "") > 3000]
    points = np.array([packing.point(np.frombuffer(x, coder.kind), table) for x in coder.encode(texts)])
    line = points[np.argsort(packing.hilbert(points), kind="stable")]
    near = np.abs(np.diff(line, axis=0)).sum(1).mean()
    draws = np.random.default_rng(1).permutation(points)
    assert near < 0.5 * np.abs(np.diff(draws, axis=0)).sum(1).mean()


def test_curve_points_of_texts_of_any_length():
    table = packing.signs(np.arange(500))
    lanes = np.stack([(table >> np.uint64(packing.LANE * d)) & np.uint64(1) for d in range(packing.DIMENSIONS)], 1)
    for n in (1, 7, 65_535, 65_536, 200_001):
        ids = np.random.default_rng(n).integers(0, 500, n)
        plus = lanes[ids].sum(0).astype(int)
        assert packing.point(ids, table) == [min(int(p) * 4096 // n, 4095) for p in plus]
    assert packing.point(np.zeros(100_000, int), table) == packing.point(np.zeros(1, int), table)


def test_entropy_compares_texts_of_all_lengths_alike(spark):
    got = QUERIES["op6_fertility"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed and quality = 1").collect()
    short, long = ([r for r in got if low <= r.n_words < high] for low, high in ((50, 121), (250, 10**9)))
    assert len(short) > 30 and sum(r.kept for r in short) / len(short) > 0.95
    assert abs(np.mean([r.entropy for r in short]) - np.mean([r.entropy for r in long])) < 0.01
    draw = np.random.default_rng(2)
    ids = draw.zipf(1.3, 300_000) % 5000
    whole = fertility.entropy(ids, fertility.WINDOW)
    assert all(abs(np.mean([fertility.entropy(ids[i:i + n], fertility.WINDOW) for i in range(0, 100 * n, n)]) - whole) < 0.02 for n in (48, 60, 130, 500, 3000))


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
       "(the \"Software\"), to deal in the Software without restriction")
APACHE = ("you may not use this file except in compliance with the License.\n\nYou may obtain a copy of the License at\n\n"
          "    http://www.apache.org/licenses/LICENSE-2.0")
BSD = "Redistribution and use in source and binary forms, with or without modification, are allowed provided that the following conditions are met"


def test_licences_by_word_blocks(spark):
    ship_package(spark)
    filler = "lorem ipsum dolor sit amet " * 9
    scattered = " ".join(f"{w} " + "sunt " * 60 for w in MIT.split())
    texts = {1: textwrap.fill(MIT, 40), 2: "\n".join(f" * {x}" for x in textwrap.wrap(MIT, 30)), 3: APACHE, 4: scattered, 5: filler + MIT + filler,
             6: BSD, 7: "\n\n".join(f"# {x}" for x in textwrap.wrap(f"{filler} {APACHE}", 35)), 8: " ".join(MIT.split()[:14]), 9: filler * 40}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "mit", 2: "mit", 3: "apache", 4: "", 5: "mit", 6: "bsd", 7: "apache", 8: "", 9: ""}
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = {r["doc_id"]: (r["labels"], r["score"]) for r in db.sql(licenses.sql()).df().to_dict("records")}
    assert got == want


def test_personal_data_that_can_be_added_is_learned(spark):
    """Rewrites of the base spans of whole documents, drawn anew: found, while plain numbers are left alone."""
    ship_package(spark)
    docs = common.documents(spark, "/root/testdata/sf0.01")
    model = pii.train(docs)
    draw, hits, spans, false, numbers = np.random.default_rng(11), 0, 0, 0, 0
    for text in (r.text or "" for r in docs.select("text").collect()):
        for start, kind, end in pii.base_spans(text):
            body = pii.rewritten(kind, text[start:end], draw)
            changed = text[:start] + body + text[end:]
            hits += any(a < start + len(body) and z > start for a, _, z in model.added(changed, pii.base_spans(changed)))
            spans += 1
        at = text.find(" ", len(text) // 2)
        if at > 0:
            body = pii.plain(draw)
            changed = text[:at + 1] + body + text[at:]
            false += any(a < at + 1 + len(body) and z > at + 1 for a, _, z in model.added(changed, pii.base_spans(changed)))
            numbers += 1
    assert spans > 50 and hits / spans > 0.85 and numbers > 500 and false / numbers < 0.02


def test_personal_data_odd_rows(spark, odd):
    assert pii.proposals("jane at example dot com", []) == [(0, 0, 23)]
    got = pii.find(odd).collect()
    assert len(got) == len(ODD) and all(r.spans == "" and r.n_email == 0 for r in got)
    twice = spark.createDataFrame([(1, "mail a@b.cd now", "x")] * 2 + [(None, None, None)], "doc_id long, text string, spans string")
    assert sorted((r.spans, r.n_email) for r in pii.find(twice).collect()) == [("", 0), ("email:5:11", 1), ("email:5:11", 1)]
    long = " ".join(f"u{i}@m{i % 7}.org 10.0.{i % 250}.1 {i * 7919 % 10**9:09d}" for i in range(60_000))
    model = pii.Model(np.zeros((0, 26)), np.zeros(0), np.zeros(0, bool), 0.98)
    base = pii.base_spans(long)
    meets = pii.Meeting(base)
    assert len(base) == 120_000 and model.added(long, base) == [] and sum(meets(s) for s in pii.proposals(long, base)) >= 120_000
    for spans in ([], [(5, 0, 9)], [(0, 1, 30), (2, 0, 4), (40, 2, 41)]):
        overlap = pii.Meeting(spans)
        assert all(overlap((a, 0, z)) == any(a < s[2] and s[0] < z for s in spans) for a in range(45) for z in range(a + 1, 46))


def test_a_text_is_cut_once(spark):
    text = "aé日𝄞\n\r" * 40_000
    got = spark.createDataFrame([(text,), ("",)], "t string").select(exact.cut(F.col("t"), 1000).alias("p")).collect()
    assert "".join(got[0].p) == text and {len(p) for p in got[0].p} == {1000} and got[1].p == [""]
