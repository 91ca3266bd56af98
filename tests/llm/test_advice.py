"""What the second review asked for, each held against brute force."""

import numpy as np
import pytest

from fungo.llm import common, fertility, simhash
from fungo.session import ship_package
from tests.llm.test_first import low


def jaccard(a, b, width=5):
    a, b = ({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} for w in (low(a).split(), low(b).split()))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def near_texts():
    """Texts and copies in which some words differ: similarities on both sides of 0.8, chains and equal texts among them."""
    rng = np.random.default_rng(5)
    texts = []
    for n in (80, 150, 400):
        for _ in range(15):
            base = [f"w{i}" for i in rng.integers(5000, size=n)]
            texts.append(" ".join(base))
            for changes in (0, 1, n // 45, n // 40, n // 20):
                copy = list(base)
                for at in rng.integers(n, size=changes):
                    copy[at] = f"x{rng.integers(5000)}"
                texts.append(" ".join(copy))
    return texts


def test_near_copies_at_a_word_similarity_of_eight_tenths_go(spark, near_texts, monkeypatch):
    ship_package(spark)
    root = list(range(len(near_texts)))
    for i in range(len(near_texts)):
        for j in range(i):
            if jaccard(near_texts[i], near_texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = common.stored(spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string"))
    assert {r.doc_id for r in simhash.drop_near(docs).collect()} == set(root)
    monkeypatch.setattr(simhash, "SLICE", (2, 3))  # every component is cut
    assert {r.doc_id for r in simhash.drop_near(docs).collect()} == set(root)


def test_row_numbers_do_not_depend_on_the_split_of_a_scan(spark, tmp_path):
    """An executor that is lost or joins between two passes changes the size of splits."""
    path = str(tmp_path / "docs")
    spark.range(40_000).selectExpr("id as doc_id", "repeat(sha2(string(id), 256), 4) as text").repartition(3).write.option(
        "parquet.block.size", 1 << 16).parquet(path)
    docs = spark.read.parquet(path)
    found = []
    for most in ("1g", "200k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found.append({r.doc_id: r.row_id for r in common.numbered(docs).select("doc_id", "row_id").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(set(found[0].values())) == 40_000
    assert found[0] == found[1]


def test_a_clean_text_of_megabytes_passes(spark):
    """Clean English documents joined end to end are as good as each of them."""
    ship_package(spark)
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    clean = fertility.judged(docs).where("kept").join(docs, "doc_id").where("lang = 'en'").select("doc_id", "text").orderBy("doc_id")
    texts = list(dict.fromkeys(r.text for r in clean.collect()))
    whole = "\n".join(texts)
    whole = "\n".join([whole] + [" ".join(reversed(t.split())) for t in texts] * (len(whole) < 3_000_000))
    judged = fertility.judged(common.stored(docs.unionByName(spark.createDataFrame([(-1, whole, "en")], "doc_id long, text string, lang string"))))
    row = judged.where("doc_id = -1").first()
    assert len(whole) > 2_000_000 and not row.base_failed and row.kept


def test_entropy_of_windows():
    ids = np.random.default_rng(0).integers(40, size=1000)
    for n in (1, 2, 100, 256, 257, 512, 1000):
        parts = [ids[:n][at:at + 256] for at in range(0, n - n % 256, 256)] or [ids[:n]]
        parts += [ids[:n][-256:]] if n > 256 and n % 256 else []
        want = []
        for part in parts:
            share = np.unique(part, return_counts=True)[1] / len(part)
            want.append(-(share * np.log2(share)).sum() / np.log2(max(len(part), 2)))
        assert abs(fertility.entropy(ids[:n]) - np.mean(want)) < 1e-9
