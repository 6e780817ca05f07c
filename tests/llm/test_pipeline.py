"""The pipeline's stages against plain Python on a small table, and the registered queries."""

import random

import pytest

import corpus_pipeline
from facet.llm import queries
from facet.llm.simhash import fingerprint

WORDS = {"en": "the of and to in that is was for with thing house water river stone".split(), "fr": "le la des une est pour dans que éléve maison eau où rivière".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(WORDS[k], k=80)), k, f"s{i % 3}", 0) for i, k in enumerate(["en", "fr"] * 60)]
    rows += [(200 + i, rows[i][1].replace(" ", "  "), "en", "s0", 0) for i in range(5)]  # copies
    rows += [(300, None, "en", "s1", 0), (301, "!!! 123", None, None, 0), (302, "zxqj kkvw " * 30, None, "s1", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.mode("overwrite").parquet(f"{path}/out/{name}")
        out = spark.read.parquet(f"{path}/out/{name}")
        if name != "tokens":
            assert out.columns == docs.columns
        docs, kept[name] = out, out.collect()
    ids = lambda n: sorted(r["doc_id"] for r in kept[n])
    assert ids("language") == sorted(i for i, *_ in rows if i not in (300, 301, 302))
    first = {}
    for i, t, *_ in rows:
        if i < 300:
            first.setdefault(" ".join(t.split()), i)
    assert ids("exact") == sorted(first.values())
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in kept["exact"]}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert ids("near") == sorted({find(i) for i in fps})
    copies = {i: ids("mix").count(i) for i in ids("near")}
    assert set(copies.values()) <= {0, 1, 2} and set(ids("mix")) <= set(ids("near"))
    words = sum(copies[r["doc_id"]] * len(r["text"].split()) for r in kept["near"])
    assert abs(words - 1.5 * sum(len(r["text"].split()) for r in kept["near"])) <= 240
    assert ids("tokens") == ids("mix") and all(r["n_tokens"] == len(r["ids"]) > 0 for r in kept["tokens"])


def test_run(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() == spark.read.parquet(f"{path}/documents.parquet").count() * 0 + len(corpus_pipeline.run(spark, path).collect())


def test_ten_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]
