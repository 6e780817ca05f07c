import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facet.llm import langid, quality, toxicity, warc
from facet.llm.common import n_words
from facet.llm.sentencepiece import MARK, Vocabulary, decode, encode


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, "p", "x", 3) for i, t, lang in rows], "doc_id long, text string, lang string, score double, lang_pred string, t string, n_words int")


# ---- language

WORDS = {"en": "the of and to in that is was for with thing house water".split(), "fr": "le la des une est pour dans que éléve maison eau où".split(), "de": "der die das und nicht straße über können haus wasser".split()}


def sentence(lang, rng, n=40):
    return " ".join(rng.choices(WORDS[lang], k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    return langid.fit({k: [sentence(k, rng) for _ in range(60)] for k in WORDS})


def test_probabilities_sum_to_one(model):
    letters = sorted({chr(c) for k in WORDS for w in WORDS[k] for c in map(ord, w)} | {" "})
    for context in ("the", "  l", "xqz", "straße"[-3:]):
        codes = np.array([[ord(c) for c in context] + [ord(x)] for x in letters], np.uint32)
        p = np.exp(np.concatenate([model.logs(c) for c in codes]))
        rest = np.exp(model.logs(np.array([ord(c) for c in context] + [0x4E00], np.uint32)))
        total = p.sum(0) + rest[0]
        assert np.allclose(total, 1, atol=0.02), (context, total)


def test_batches_and_long_texts_score_like_single_ones(model, monkeypatch):
    rng = random.Random(2)
    texts = [sentence("fr", rng, n) for n in (1, 5, 300)] + [None, "12 !", "x"]
    alone = np.concatenate([model.entropy([t])[0] for t in texts])
    assert np.allclose(model.entropy(texts)[0], alone, atol=1e-5)
    monkeypatch.setattr(langid, "_CHUNK", 50)
    assert np.allclose(model.entropy(texts)[0], alone, atol=1e-5)


def test_predictions(model):
    rng = random.Random(5)
    for k in WORDS:
        lang, score, rejected = model.predict([sentence(k, rng, 30)])
        assert (lang, bool(rejected[0])) == ([k], False) and score[0] > 0.9
    lang, score, rejected = model.predict([None, "", "123 --", "qxzj vwkq zzxq jjqx " * 20])
    assert lang[:3] == ["und"] * 3 and rejected.all() and (score[:3] == 0).all()


def test_identify(spark):
    rng = random.Random(1)
    rows = [(i, sentence(k, rng), k) for i, k in enumerate(["en", "fr", "de"] * 40)] + [(900, None, "en"), (901, "", "fr"), (902, "77", None), (903, sentence("de", rng), None), (None, sentence("en", rng), "en"), (5, sentence("fr", rng), "fr")]
    d = docs(spark, rows)
    out = langid.identify(d, langid.train(d.where("doc_id % 4 <> 2 OR doc_id IS NULL"))).collect()
    want = {t: k or "de" for _, t, k in rows if t and t != "77"}
    assert len(out) == len(rows)
    assert all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (900, 901, 902))
    assert sorted(r["lang_pred"] for r in out if r["doc_id"] not in (900, 901, 902)) == sorted(want[t] for _, t, _ in rows if t in want)
    none = langid.train(d.where("false"))
    assert {r["lang_pred"] for r in langid.identify(d, none).collect()} == {"und"}
    assert langid.identify(d.limit(0), none).count() == 0


# ---- toxicity


def test_toxicity(spark):
    rng = random.Random(0)
    clean = ["".join(rng.choices("aeioudnrst", k=rng.randrange(3, 8))) for _ in range(300)]
    bad = ["vilesome", "grotwit", "snarkle"]

    def text(y):
        w = rng.choices(clean, k=60)
        for _ in range(4 * y):
            w[rng.randrange(60)] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), None) for i in range(400)] + [(500, None, None), (501, "", None), (502, "vilesomme you grotwitt, " + text(0), None), (503, text(0), None), (503, text(0), None)]
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0, "x") for i in range(300)] + [(301, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    d = docs(spark, rows)
    m = toxicity.train(d, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, m).collect()}
    held = [(got[i] >= 0.7, i % 3 == 0) for i in range(300, 400)]
    assert sum(a == b for a, b in held) >= 95
    assert got[502] > 0.7 and got[500] == got[501] < 0.5 and got[503] < 0.5
    assert toxicity.score(d, m).count() == len(rows) and toxicity.score(d.limit(0), m).count() == 0
    flat = toxicity.train(d, labels.where("false"))
    assert {r["score"] for r in toxicity.score(d, flat).collect()} == {0.5}


def test_scores_do_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(0)
    m = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -1.0, np.array([0.1, 0.5, 0.2, 0.4, -0.3]))
    texts = ["one two three", None, "", "Über-straße x", "a" * 3000 + " b c d", "1 2"]
    alone = np.concatenate([m.scores([t]) for t in texts])
    assert np.allclose(m.scores(texts), alone)
    monkeypatch.setattr(toxicity, "_CHUNK", 64)
    assert np.allclose(m.scores(texts), np.concatenate([m.scores([t]) for t in texts]))


# ---- quality


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality(spark):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choices("the cat sat on a mat and it was so very happy indeed today".split(), k=60)) + "."
    junk = lambda: " ".join(w + "###" for w in rng.choices("alpha beta gamma delta".split(), k=60))
    rows = [(i, good() if i % 4 else junk(), None) for i in range(200)]
    rows += [(300, None, None), (301, "", None), (302, "a b c d e f g h " * 5, None), (303, "x\nx\n\n \nx \nx", None), (304, "one two three four five six seven eight", None), (305, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(40))), None), (306, good(), None), (306, good(), None), (None, "é ü " * 20, None)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 150)] + [(1, 1), (150, None), (None, 1)], "doc_id long, quality int")
    out = quality.judge(docs(spark, rows), labels).collect()
    assert len(out) == len(rows)
    text = {}
    for i, t, _ in rows:
        text.setdefault(i, []).append(t)
    for r in out:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got in [counts(t) for t in text[r["doc_id"]]], r
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
        if r["doc_id"] is not None and r["doc_id"] < 200 and not r["base_failed"]:
            assert r["kept"] == (r["doc_id"] % 4 > 0)
    nothing = quality.judge(docs(spark, rows), labels.where("false")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in nothing)
    assert quality.judge(docs(spark, []), labels).count() == 0


def test_number_of_words(spark):
    texts = [None, "", " ", "a", " a", "a\t\nb ", "a  b\x0bc"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n_words(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in d.collect()} == {t: len((t or "").split()) for t in texts}


# ---- sentencepiece


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def best(v, s):
    """Plain Viterbi over the whole text."""
    at = [(0.0, [])] + [None] * len(s)
    for i in range(len(s)):
        single = False
        for k in range(1, min(v.longest, len(s) - i) + 1):
            p = v.pieces.get(s[i : i + k])
            if p:
                single |= k == 1
                new = at[i][0] + p[1]
                if at[i + k] is None or new > at[i + k][0]:
                    at[i + k] = (new, at[i][1] + [p[0]])
        if not single:
            new = at[i][0] + v.floor
            if at[i + 1] is None or new > at[i + 1][0]:
                at[i + 1] = (new, at[i][1] + [v.bytes_[b] for b in s[i].encode()])
    return at[-1][1]


TEXTS = ["", "a", "  two  spaces ", "Hello, world! It is fine.", "déjà vu über straße", "日本語 text 😀\n\t\x00", "x" * 500, "ab" * 200 + " " + "antidisestablishmentarianism" * 5]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_is_viterbi_and_decodes(vocabulary, text):
    ids = vocabulary.encode(text).tolist()
    marked = MARK + text.replace(" ", MARK)
    assert vocabulary.decode(ids) == text
    if text:
        assert ids == best(vocabulary, marked) == [i for run in vocabulary.search(iter(marked)) for i in run]


def test_ids_are_committed_before_the_end(vocabulary):
    text = MARK + "internationalization" * 200
    fed = 0

    def feed():
        nonlocal fed
        for c in text:
            fed += 1
            yield c

    first = next(vocabulary.search(feed()))
    assert first and fed < 200


def test_against_the_library():
    """Short words: the library's best path over the same pieces as a unigram model."""
    import sentencepiece

    from facet.llm.sentencepiece import MODEL

    def field(b, i):
        def varint(i):
            x = s = 0
            while True:
                c = b[i]
                i, x, s = i + 1, x | (c & 127) << s, s + 7
                if c < 128:
                    return x, i

        tag, i = varint(i)
        if tag & 7 == 0:
            _, i = varint(i)
            return tag, None, i
        if tag & 7 == 2:
            n, i = varint(i)
            return tag, b[i : i + n], i + n
        return tag, None, i + (4 if tag & 7 == 5 else 8)

    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    raw, out, i = open(MODEL, "rb").read(), b"", 0
    while i < len(raw):
        tag, body, j = field(raw, i)
        if tag >> 3 == 2:
            new, k = b"", 0
            while k < len(body):
                t, _, e = field(body, k)
                new += number(3 << 3) + number(1) if t >> 3 == 3 else body[k:e]
                k = e
            out += number(tag) + number(len(new)) + new
        else:
            out += raw[i:j]
        i = j
    lib = sentencepiece.SentencePieceProcessor(model_proto=out)
    v = Vocabulary.load()
    score = lambda ids: sum(lib.get_score(i) for i in ids)
    for w in "the nation internationalization hello thing under standing retrieval theatre".split():
        assert score(v.encode(w).tolist()) == max(score(x) for x in lib.nbest_encode_as_ids(w, 5))


def test_encode_and_decode_tables(spark):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(90, None, "x"), (0, "", None), (None, "n", None)]
    d = docs(spark, rows)
    enc = encode(d, keep=("doc_id", "text", "t"))
    out = decode(enc, keep=("doc_id", "text", "ids"), text="back").collect()
    assert len(out) == len(rows) and all(r["back"] == r["text"] for r in out)
    assert [r["ids"] for r in out if r["doc_id"] == 90] == [None]
    assert encode(d.limit(0)).count() == 0


# ---- WARC

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><meta name="k" content="v"><style>p{}</style><script>var x = "</p>";</script></head>
<body><nav><a href="/one?x=1&amp;y=2">One</a> <a href='two#f'>Two <b>bold</b></a></nav><!-- hidden <p>no</p> --><p>First&nbsp;para <i>it</i>alic</p>
<div title="a > b">Second<br>line</div><p>unclosed"""


def test_page():
    p = warc.read_html(PAGE, "http://h.org/d/e")
    assert p["title"] == "A & B" and p["meta"] == [{"name": "k", "content": "v"}]
    assert p["links"] == [{"url": "http://h.org/one?x=1&y=2", "text": "One"}, {"url": "http://h.org/d/two#f", "text": "Two bold"}]
    assert p["text"].split("\n") == ["A & B", "One Two bold", "First para italic", "Second", "line", "unclosed"]
    for odd in ("", "<", "<a href=", "<script>alert(1)", "<!-- x", "a < b > c", "<p" * 50, '<a "' * 2000):
        warc.read_html(odd)


@pytest.mark.parametrize("compress", [False, True])
def test_records_round_trip(compress):
    h, b = warc.response(1, "http://x.org/", PAGE)
    records = [(h, b), *warc.derive(dict(h), b)]
    data = warc.write_bytes(records, compress)
    got = list(warc.parse(data))
    assert [(k, v) for k, v in got] == [({**dict(h), "Content-Length": str(len(b))}, b) for h, b in records]
    for own, block in got[1:]:
        assert own["WARC-Refers-To"] == dict(h)["WARC-Record-ID"] and own["WARC-Target-URI"] == "http://x.org/" and own["WARC-Block-Digest"] == warc.digest(block)
    import json

    env = json.loads(got[1][1])["Envelope"]
    assert env["WARC-Header"]["WARC-Record-ID"] == dict(h)["WARC-Record-ID"] and env["Digests"]["Payload"] == warc.digest(PAGE.encode()) and env["HTTP"]["Headers"]["Content-Type"] == "text/html; charset=utf-8"


def test_charset_of_the_headers():
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n".encode() + "<p>é</p>".encode("latin-1")
    assert warc.derive({"WARC-Record-ID": "<x>"}, block)[1][1].decode() == "é"
    assert warc.derive({}, b"no headers at all")[1][1] == b"no headers at all"


def test_derivatives(spark, tmp_path):
    rows = [(1, "http://x.org/", PAGE), (2, None, "<p>t</p>"), (3, "", None), (None, "http://y.org", ""), (1, "http://x.org/", PAGE)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, kind string, block string")
    out = warc.derivatives(d).collect()
    assert len(out) == 10 and Counter(r["kind"] for r in out) == {"metadata": 5, "conversion": 5}
    assert [r["block"] for r in out if r["page_id"] == 2 and r["kind"] == "conversion"] == ["t"]
    assert all(r["target_uri"] is None for r in out if r["page_id"] in (2, 3))
    assert warc.derivatives(d.limit(0)).count() == 0
    (tmp_path / "a.warc.gz").write_bytes(warc.write_bytes([warc.response(i, u, h) for i, u, h in rows[:2]]))
    files = warc.derive_files(warc.read(spark, str(tmp_path))).collect()
    assert sorted((r["place"], r["kind"], r["record_id"]) for r in files) == sorted((i, r["kind"], r["record_id"]) for i, k in enumerate((1, 2)) for r in [x for x in out if x["page_id"] == k][:2])
