"""Brute force, held-out accuracy and odd rows for the other corpus operators and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fungo.llm import boosting, common, fertility, langid, licenses, pii, ranking, substrings
from fungo.llm.queries import QUERIES
from fungo.session import ship_package
from tests.llm.test_first import FOLDER, ODD, SCHEMA, odd, rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_removed(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substrings_query(spark, rows):
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, *_), (n, k, t) in zip(rows, slow_removed([r[1] for r in rows], 35))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_substrings"](spark, FOLDER).collect()}
    assert got == want


def test_substrings_of_few_words_and_crowded_anchors(spark):
    """Small alphabets make overlapping repeats; a low limit sends anchors to the count of windows."""
    ship_package(spark)
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{i}" for i in range(9))
    texts = [" ".join(rng.choice(list("abc"), size=rng.integers(0, 40))) for _ in range(60)]
    texts += [f"{' '.join(rng.choice(list('abcdefgh'), 5))} {passage} {' '.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(60)]
    texts += ["x " * 300, None, ""]
    docs = common.stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = dict(enumerate(slow_removed(texts, 6)))
    for limit in (2, 1000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs, 6, 3, limit).collect()}
        assert got == want


def test_substrings_odd_rows(odd):
    got = substrings.without_repeats(odd)
    rows = got.collect()
    assert len(rows) == len(ODD)
    assert {r.n_removed for r in rows if r.doc_id in (4, 5)} == {30000}
    assert substrings.without_repeats(odd.limit(0)).count() == 0


def slow_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if least <= len(d) <= most and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(rows):
    rng = np.random.default_rng(2)
    parts = ["@", "a", "b.c", "_", "..", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "a@b.c", "1.2.3.4", "4111111111111111", "é", "0" * 9]
    made = ["".join(rng.choice(parts, size=rng.integers(1, 25))) for _ in range(4000)]
    for text in made + [t or "" for _, t, _ in rows]:
        assert pii.base_spans(text) == slow_base(text), text


def test_pii_query(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op3_pii"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        base = slow_base(text or "")
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.said(base).encode()).hexdigest()
        assert set(filter(None, pii.said(base).split(","))) <= set(r.spans.split(","))


def test_pii_adds_loose_spans_and_redacts(spark):
    ship_package(spark)
    docs = [(i, f"call phone +1 ({200 + i % 700}) 555-{1000 + i} or mail user{i}@host{i % 9}.example.com now, part {i} of 77 in 12.5 days 2021-{i % 12 + 1}-03")
            for i in range(400)]
    docs += [(1000, "please mail first.last at host1.example.com or call phone 00 1 (222) 555-0199 now"), (1001, None), (1002, ""), (None, "1 2 3")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    assert got[0].spans.count(":") == 4 and "<email>" in got[0].redacted and "<phone>" in got[0].redacted
    assert got[1001].spans == got[1002].spans == "" and got[1000].n_email == 0
    assert "email" in got[1000].spans or "phone" in got[1000].spans
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.Boosted().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == (y[2000:] == 1)).mean() > 0.95


def slow_counts(text):
    words = WORD.findall(text)
    seen, twins = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twins += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twins, len(inside))


def test_fertility_query(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op6_fertility"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        r, want = got[d], slow_counts(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_fertility_bands_cover_all_rows(spark):
    """Quartiles on the grid equal those of the sorted values; other languages and odd texts are rejected."""
    rng = np.random.default_rng(4)
    values = [("en", *map(float, v)) for v in rng.uniform(0.1, 3, (500, 3))] + [("xx", 1.0, 0.0, 0.5)]
    df = spark.createDataFrame([(False, *v) for v in values], "base_failed boolean, language string, chars_per_token double, byte_share double, entropy double")
    got = {r.language: r for r in fertility.bands(df, 1.0).collect()}
    for k, m in enumerate(fertility.MEASURES, 1):
        own = sorted(round(v[k] * fertility.GRID) / fertility.GRID for v in values if v[0] == "en")
        q1, q3 = own[-(-len(own) // 4) - 1], own[-(-3 * len(own) // 4) - 1]
        width = max(q3 - q1, fertility.MEASURES[m])
        assert got["en"][f"{m}_low"] == pytest.approx(q1 - width) and got["en"][f"{m}_high"] == pytest.approx(q3 + width)
    assert got["xx"].chars_per_token_low < 1.0 < got["xx"].chars_per_token_high


def test_fertility_odd_rows(odd, spark):
    got = fertility.judged(odd).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got if not r.n_words)
    kept = fertility.passing(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert fertility.judged(odd.limit(0)).count() == 0
    assert [fertility.script(t) for t in ("abc é", "где abc по-русски", "日本の人", "12 !")] == ["latin", "cyrillic", "han", "none"]


def test_junk_is_rejected_and_clean_text_stays(spark):
    got = QUERIES["op6_fertility"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    rate = {r.quality: r.rate for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.6


def test_licenses_odd_rows(odd, spark):
    got = licenses.scan(odd).collect()
    assert len(got) == len(ODD) and {r.labels for r in got} == {""} and {r.score for r in got} == {0.0}
    assert licenses.scan(odd.limit(0)).count() == 0
    texts = [(1, "x the MIT-License and MIT license"), (2, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of "
             "this software and associated documentation files\n(the Software), to deal in the Software without restriction"),
             (3, "GNU General Public Licence"), (4, "a general\npublic license"), (5, "Licensed under CC BY-SA 4.0.")]
    rows = {r.doc_id: r for r in licenses.scan(common.stored(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (2, 2, 5, "mit")
    assert (rows[2].n_base, rows[2].labels, rows[2].score, rows[2].first_word) == (0, "mit", 1.0, None)
    assert rows[3].labels == "" and (rows[4].base_labels, rows[4].first_word) == ("gpl", 1) and rows[5].labels == "cc-by-sa"


def test_language_accuracy(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3))
    assert langid.identify(odd.limit(0)).count() == 0


def test_network_tables_and_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(3)
    x, y = rng.integers(0, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    hidden = np.maximum(np.concatenate(net.pooled(x)[1], 1), 0)
    z = np.exp(hidden @ net.p["out"] + net.p["bias"])
    assert np.allclose(net.probabilities(x), z / z.sum(1, keepdims=True), atol=1e-4)
    g = net.gradients(x, y)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)

    def loss():
        hidden = np.maximum(np.concatenate(net.pooled(x)[1], 1), 0)
        z = np.exp(hidden @ net.p["out"] + net.p["bias"])
        return -np.log((z / z.sum(1, keepdims=True))[np.arange(5), y]).mean()
    for name, at in (("out", (3, 1)), ("conv3", (4, 2)), ("embed", (int(x[0, 3]), 2)), ("bias", (0,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], abs=2e-3)


def test_windows_hold_every_run_of_bytes():
    for n in (0, 1, 127, 128, 129, 253, 254, 1000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n).astype(np.uint8))
        own = {w.tobytes()[i:i + 4] for w in langid.windows(data) for i in range(langid.WINDOW - 3)}
        assert {data[i:i + 4] for i in range(n - 3)} <= own


def test_quality_ranking(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op10_ranking"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    rows = ranking.rank(odd, labels.limit(0)).collect()
    assert len(rows) == len(ODD) and all(r.score == 0.7 and r.predicted == 1 for r in rows)
    odd_labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (7, None), (None, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    assert len(ranking.rank(odd, odd_labels).collect()) == len(ODD)
    assert ranking.rank(odd.limit(0), odd_labels).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = corpus_pipeline.run(spark, FOLDER).collect()
    step, columns = docs, docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = common.stored(stage(spark, step, FOLDER))
        assert step.columns == columns
        counts.append(step.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in step.dropDuplicates(["doc_id"]).collect()]
    assert len(norm) == len(set(norm))
    per_doc = defaultdict(int)
    for r in got:
        per_doc[r.doc_id] += r.length
    assert set(per_doc) == {r.doc_id for r in step.collect()}
    last = max(got, key=lambda r: (r.sequence_id, r.offset))
    full = [r for r in got if r.sequence_id < sum(per_doc.values()) // 2048]
    assert sum(r.length for r in full) % 2048 == 0 and last.length <= 2048


def test_pipeline_takes_clashing_columns_and_empty_tables(spark, odd):
    for docs in (odd, odd.limit(0)):
        step = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = common.stored(stage(spark, step, ""))
            assert step.columns == odd.columns
        corpus_pipeline.pack(spark, step, "").count()


def test_quality_learns_from_every_label(spark):
    """Weights and threshold are those of all labelled documents, also where one label has far more of them."""
    docs = spark.createDataFrame([(i, "plain words " * (60 + i % 7) if i % 11 else "bad * # | " * (3 + i % 5)) for i in range(2600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 11 != 0).cast("int").alias("quality"))
    seen = spark.createDataFrame([(r.doc_id, [float(v) for v in ranking.features(r.text)]) for r in docs.collect()], "doc_id long, x array<double>")
    learn = labels.where(ranking.fold(4) != 2).join(seen, "doc_id").withColumnRenamed("quality", "label")
    counts = {r.label: r["count"] for r in learn.groupBy("label").count().collect()}
    assert counts[1] > 1000 > counts[0]
    assert ranking.pairs(learn, counts, 2).count() == 2 * counts[1]
    ranker = ranking.train(seen, labels, 2)
    rows = learn.collect()
    x = np.array([r.x for r in rows])
    assert np.allclose(ranker.centre, x.mean(0)) and np.allclose(ranker.scale, x.std(0) + 1e-6)
    raw = np.sort(ranker.raw(x))
    k = counts[0]
    assert np.isclose(np.log(0.7 / 0.3) - ranker.shift, (raw[k - 1] + raw[k]) / 2)
    assert (ranker.score(x) >= 0.7).sum() == counts[1]
