"""The registered queries against plain Python, and rows that are hard to carry: null and large ids, repeats, clashing names."""

import gzip
import hashlib
import html.parser
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from facet.llm import langid, mixing, quality, queries, simhash, toxicity, warc
from facet.llm.common import bounded_sample
from facet.llm.components import components
from facet.llm.simhash import fingerprint, near_dedup
from facet.llm.suffix import repeated_spans

SF = "/root/testdata/sf0.001"
BIG = (1 << 53) + 1
crc = lambda i, n: None if i is None else zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


# ---- ids in one batch: null beside numbers that doubles can't hold


def odd_ids(spark, texts, name="doc_id"):
    ids = [BIG, None, BIG + 2, BIG + 4, BIG + 6]
    return ids, spark.createDataFrame([(i, t, "en", t) for i, t in zip(ids, texts)], f"{name} long, text string, lang string, html string").coalesce(1)


def test_ids_of_near_and_span_dedup(spark):
    base = " ".join(f"w{k}" for k in range(120))
    texts = [base, base, base, "other words " * 30, base]
    ids, d = odd_ids(spark, texts)
    got = near_dedup(d).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i in ids)
    assert {r["component_id"] for r in got} == {BIG, BIG + 4}
    got = {r["doc_id"]: r["n_removed"] for r in repeated_spans(d).collect()}
    assert got[BIG] == 0 and got[BIG + 2] == got[BIG + 6] == got[None] == len(base)
    named = d.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    assert {r["doc_id"]: r["n_removed"] for r in repeated_spans(named).collect()} == {None if i is None else f"x{i}": n for i, n in got.items()}


def test_ids_of_models(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choices("the of and to in that is was".split(), k=40)) for _ in range(5)]
    ids, d = odd_ids(spark, texts)
    want = Counter(ids)
    assert Counter(r["doc_id"] for r in langid.identify(d, langid.train(d)).collect()) == want
    assert Counter(r["doc_id"] for r in toxicity.score(d, toxicity.fit(texts, np.array([0, 1, 0, 1, 0]))).collect()) == want


def test_ids_of_derivatives(spark):
    ids, d = odd_ids(spark, ["<p>a</p>"] * 5, "page_id")
    d = d.withColumn("url", F.lit("http://x.org/"))
    got = {(r["page_id"], r["kind"]): r["record_id"] for r in warc.derivatives(d).collect()}
    assert {i for i, _ in got} == set(ids) and len(set(got.values())) == 10
    alone = warc.derivatives(d.where(F.col("page_id") == BIG)).collect()
    assert all(got[BIG, r["kind"]] == r["record_id"] for r in alone)


def test_sample_keeps_groups_of_repeated_rows(spark):
    same = [("a", 1, "one text") for _ in range(5000)]
    few = [("b", i % 7, "few") for i in range(3000)]
    many = [("c", i, f"t{i}") for i in range(3000)]
    d = spark.createDataFrame(same + few + many, "g string, i long, t string")
    got = Counter(r["g"] for r in bounded_sample(d, "g", ["i", "t"], 20).collect())
    assert got == {"a": 1, "b": 7, "c": 20}
    again = {(r["g"], r["i"]) for r in bounded_sample(d.repartition(7), "g", ["i", "t"], 20).collect()}
    assert again == {(r["g"], r["i"]) for r in bounded_sample(d, "g", ["i", "t"], 20).collect()}
    model = langid.train(d.select(F.col("g").alias("lang"), F.col("i").alias("doc_id"), F.concat("g", F.lit(" "), "t").alias("text")))
    assert model.languages == ["a", "b", "c"]


def test_toxicity_of_repeated_ids_and_long_words(spark):
    rows = [(1, f"text {k}") for k in range(50)] + [(2, "x" * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    low, high = model.scores(["text 0", "x" * 200])
    assert low < high
    flat = toxicity.fit(["", " ", "", ""], np.array([1, 0, 0, 0]))
    assert np.allclose(flat.scores(["anything"]), 0.25, atol=0.01)


# ---- near-duplicates


def test_dense_classes(spark):
    """Classes without all pairs are those of all pairs."""
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for plan in (simhash.plan(np.array(fps, np.uint64), 1000, 3), simhash.plan(np.array(fps, np.uint64), 10**8, 3)):
        for hot in (4096, 20):
            got = {r["node"]: r["root"] for r in simhash.linked(df, 3, plan, hot).collect()}
            want = {r["node"]: r["root"] for r in components(simhash.links(df, 3, plan)).collect()}
            assert got == want


def test_crowded_bands(spark):
    """Buckets that are split give the same classes."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = []
    for k in range(60):
        w = list(base)
        for i in rng.sample(range(100), 2 if k % 2 else 40):
            w[i] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r["doc_id"]: r["component_id"] for r in near_dedup(d, width=5, least=0.8).collect()}
    two = {r["doc_id"]: r["component_id"] for r in near_dedup(d, width=5, least=0.8, hot=5).collect()}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(96)}
    sets = [grams(t) for t in texts]
    linked = [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert linked and one == two and all(one[i] == one[j] for i, j in linked)


# ---- WARC


def test_headers_repeat_and_fold():
    raw = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x>\r\nwarc-target-uri: http://h/\r\nX-Note: a\r\n b\r\nX-Note: c\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    ((h, block),) = list(warc.parse(raw % (len(body), body)))
    assert block == body and [v for k, v in h.pairs if k == "X-Note"] == ["a b", "c"]
    meta, text = warc.derive(h, block)
    env = json.loads(meta[1])["Envelope"]
    assert env["HTTP"]["Headers"]["Set-Cookie"] == ["a=1", "b=2"] and ["set-cookie", "b=2"] in env["HTTP"]["Header-Pairs"]
    assert env["WARC-Header"]["X-Note"] == ["a b", "c"] and dict(text[0])["WARC-Refers-To"] == "<urn:x>" and dict(text[0])["WARC-Target-URI"] == "http://h/"
    assert text[1] == b"hi"


@pytest.mark.parametrize("codings", ["gzip", "deflate", "raw", "chunked", "chunked gzip", "cut", "none"])
def test_bodies_are_decoded(codings):
    page, heads = b"<title>T</title><p>" + "wörd ".encode() * 3000 + b"</p>", []
    body = page
    if "gzip" in codings or codings == "cut":
        body = gzip.compress(body)
        heads.append("Content-Encoding: gzip")
    if codings == "cut":
        body = body[: len(body) - 12]
    if codings == "deflate":
        body, heads = zlib.compress(body), ["content-encoding: deflate"]
    if codings == "raw":
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body, heads = z.compress(body) + z.flush(), ["Content-Encoding: deflate"]
    if "chunked" in codings:
        body = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(body[i : i + 7000]), body[i : i + 7000]) for i in range(0, len(body), 7000)) + b"0\r\nTrailer: x\r\n\r\n"
        heads.append("Transfer-Encoding: chunked")
    block = ("HTTP/1.1 200 OK\r\n" + "".join(h + "\r\n" for h in heads) + "Content-Type: text/html; charset=utf-8\r\n\r\n").encode() + body
    meta, text = warc.derive({"WARC-Record-ID": "<x>"}, block)
    got = text[1].decode()
    assert got.startswith("T\nwörd wörd") and (codings == "cut" or got.split() == ["T"] + ["wörd"] * 3000)
    assert json.loads(meta[1])["Envelope"]["Digests"]["Payload-Computed"] == warc.digest(body)


class Text(html.parser.HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template", "noscript")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template", "noscript")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_pages_against_another_parser(spark):
    pages = [r.asDict() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {}
    for r in queries.op3_warc_derivatives(spark, SF).collect():
        got.setdefault(r["page_id"], {})[r["kind"]] = r
    assert set(got) == {p["page_id"] for p in pages}
    for p in pages:
        conv, meta = got[p["page_id"]]["conversion"], got[p["page_id"]]["metadata"]
        assert conv["block"].split() == "".join(Text(p["html"] or "").out).split(), p["html"]
        assert conv["target_uri"] == meta["target_uri"] == p["url"] and conv["refers_to"] == meta["refers_to"]
        assert conv["block_digest"] == warc.digest(conv["block"].encode()) and conv["content_length"] == len(conv["block"].encode())
        assert conv["source_digest"] == warc.digest((p["html"] or "").encode()) == json.loads(meta["block"])["Envelope"]["Digests"]["Payload-Computed"]


# ---- the registered queries at sf0.001


def test_op1(spark, documents):
    got = run(spark, "op1_simhash_dedup")
    fps = {d["doc_id"]: fingerprint(d["text"]) for d in documents}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
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
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in fps}


def test_op2(spark, documents):
    got, seen = run(spark, "op2_suffix_dedup"), set()
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        t, gone = (d["text"] or "").encode(), set()
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in seen:
                gone.update(range(p, p + 100))
            seen.add(w)
        r = got[d["doc_id"]]
        kept = bytes(c for i, c in enumerate(t) if i not in gone)
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(t), len(gone), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == sum(i - 1 not in gone for i in gone)


def test_op4_and_op10(spark, documents):
    got = run(spark, "op4_toxicity")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == {d["doc_id"] for d in documents}
    assert all(r["held_out"] == (crc(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(r["predicted"], toxic[i]) for i, r in got.items() if r["held_out"] and toxic.get(i) is not None]
    assert np.mean([a == b for a, b in held]) > 0.85
    got = run(spark, "op10_language_id")
    lang = {d["doc_id"]: d["lang"] for d in documents}
    assert all(r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(r["lang_pred"], lang[i]) for i, r in got.items() if r["held_out"] and lang[i]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_op5(spark, documents):
    got = run(spark, "op5_minimax_sharding")
    shards, groups = {}, {}
    for d in documents:
        r, t = got[d["doc_id"]], (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        shards.setdefault(r["shard"], []).append(r)
        groups.setdefault(d["text"], set()).add(r["shard"])
    assert set(shards) <= set(range(40)) and all(len(s) == 1 for s in groups.values())
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in shards.values())


def test_op6(spark, documents):
    got = run(spark, "op6_quality_rules")
    labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    h = lambda b, seed=42: xxhash.xxh64_intdigest(b.encode(), seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        import regex

        shape = regex.sub(r"\p{N}+", "0", regex.sub(r"\p{L}{4,}", "w", regex.sub(r"\p{Lu}{4,}", "W", t)))
        s = re.split(r"[\x20\x09-\x0D]+", shape)
        pairs = [h(b, h(a)) for a, b in zip(s, s[1:])] + [h(s[-1])]
        return [signed(x) % quality.BUCKETS for x in [h(w) for w in words] + pairs]

    of = {d["doc_id"]: grams(d["text"] or "") for d in documents}
    raw, own = Counter(), Counter()
    for i, g in of.items():
        raw.update(g)
        if i in labels:
            own.update(g)
    z, y = sum(raw.values()) + quality.BUCKETS, sum(own.values())
    ratio = lambda b: math.log((own[b] + quality.PRIOR * (raw[b] + 1) / z) / (y + quality.PRIOR) / ((raw[b] + 1) / z))
    for d in documents:
        r, t = got[d["doc_id"]], d["text"] or ""
        score = sum(map(ratio, of[d["doc_id"]])) / len(of[d["doc_id"]])
        assert abs(r["score"] - score) < 1e-5 and r["n_words"] == len(t.split())
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_op7_and_op8(spark, documents):
    got = run(spark, "op7_sentencepiece")
    assert all(r["round_trip"] or "▁" in next(d["text"] for d in documents if d["doc_id"] == i) for i, r in got.items()) and len(got) == len(documents)
    got, groups = run(spark, "op8_exact_dedup"), {}
    for d in documents:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d["text"] or ""), []).append(d["doc_id"])
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


def targets(sizes, weights, budget):
    """Shares by weight under the cap of twice a size, by bisection of the common level."""
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * s, w * mid) for s, w in zip(sizes, weights)) < budget else (low, mid)
    return [min(2 * s, w * high) for s, w in zip(sizes, weights)]


def test_op9(spark, documents):
    got, by = run(spark, "op9_entropy_mixing"), {}
    for d in documents:
        by.setdefault(d["source"], []).append((d["doc_id"], len((d["text"] or "").split())))
    names = sorted(by, key=lambda s: (s is None, s))
    sizes = [sum(n for _, n in by[s]) for s in names]
    want = targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(sizes))
    for s, total, t in zip(names, sizes, want):
        rows = [got[i] for i, _ in by[s]]
        assert all(r["size"] == n and r["source_size"] == total and abs(r["target"] - t) <= 1e-6 * t for r, (_, n) in zip(rows, by[s]))
        assert all(r["taken"] <= 2 * r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - t) <= max(0.02 * t, max(n for _, n in by[s]))
    # each source's rates are the tilted ones that meet its target
    out = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    rate = {r["doc_id"]: r["rate"] for r in out}
    for s, total, t in zip(names, sizes, want):
        if t >= 2 * total * (1 - 1e-12):
            assert all(rate[i] == (2.0 if n else 1.0) for i, n in by[s])
            continue
        mean = total / len(by[s])
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(2.0, math.exp(min(50, mid * n / mean))) for _, n in by[s]) < t else (low, mid)
        assert all(abs(rate[i] - (min(2.0, math.exp(min(50, low * n / mean))) if n else 1.0)) < 1e-3 for i, n in by[s])


# ---- Kneser-Ney by its definition


def test_kneser_ney():
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["aba", "abb", "cab", "bca", "aa"], k=12)) for _ in range(9)]
    model = langid.fit({"x": texts}, order=3)
    padded = [" " * 1 + " " + t + " " for t in texts]
    alphabet = len(set("".join(padded))) + 1
    tops = Counter(p[i : i + 3] for p in padded for i in range(len(p) - 2))

    def counts(n):
        if n == 3:
            return tops
        return Counter(g[1:] for g in counts(n + 1))

    def prob(g):
        if not g:
            return 1 / alphabet
        c = counts(len(g))
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(v for k, v in c.items() if k[:-1] == g[:-1])
        kinds = sum(k[:-1] == g[:-1] for k in c)
        if not total:
            return prob(g[1:])
        return max(c[g] - d, 0) / total + d * kinds / total * prob(g[1:])

    for g in ["aba", "abz", "zab", "  a", "b c", "zzz", "ab "]:
        got = float(model.logs(np.array([ord(c) for c in g], np.uint32))[0, 0])
        assert abs(got - math.log(prob(g))) < 1e-4, g


def test_ties_and_rejection():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("one two three four five six".split(), k=60)) for _ in range(40)]
    lang, score, rejected = langid.fit({"b": texts, "a": texts}).predict([texts[0], "zvxq " * 20, "Правительство объявило о законе для городских школ"])
    assert lang[0] == "a" and abs(score[0] - 0.5) < 1e-6 and rejected.tolist() == [False, True, True]


# ---- the pipeline on odd rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, repeated and large ids, repeated rows, and columns named as the stages name theirs."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("etaoinshr", k=5))
    rows = [(i, " ".join(word() for _ in range(80)), "en") for i in range(60)]
    edit = lambda t: t.rsplit(" ", 1)[0] + " " + word()
    rows += [(5, edit(rows[5][1]), "en"), (None, edit(rows[6][1]), "en"), (None, edit(rows[6][1]), "en"), (None, rows[7][1], "en"), (BIG, rows[8][1], "en"), rows[9], rows[9]]
    rows += [(None, " ".join(word() for _ in range(80)), None), (80, None, "en"), (81, "", "en"), (82, " ".join(word() for _ in range(4000)), "en")]
    cols = "doc_id long, text string, lang string, source string, _key string, _doc string, score string, rejected string, copies string, id string"
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(*r, "s", *"abcdef") for r in rows], cols).coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_pipeline_of_odd_rows(spark, odd):
    path, rows = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.columns == cols
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language":
            assert sorted(got, key=str) == sorted([(i, t) for i, t, _ in rows if t], key=str)
        if name in ("exact", "near"):
            assert len(got) == len(set(got)) and Counter(i for i, _ in got)[9] == 1
        if name == "near":
            assert sorted(i for i, _ in got if i is not None) == [*range(60), 82] and sum(i is None for i, _ in got) == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{path}/documents.parquet").limit(0), path).count() == 0


def test_each_stage_runs_once(spark, odd, monkeypatch):
    path, rows = odd
    seen = spark.sparkContext.accumulator(0)

    def first(spark, docs, sf_dir):
        @F.udf("string")
        def note(t):
            seen.add(1)
            return t

        return docs.withColumn("text", note.asNondeterministic()("text"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", first), *corpus_pipeline.STAGES[1:]])
    assert corpus_pipeline.run(spark, path).count() > 0
    assert seen.value == len(rows)
