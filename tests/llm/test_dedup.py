import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from facet.llm import simhash, suffix
from facet.llm.components import components
from facet.llm.exact_dedup import exact_dedup
from facet.llm.simhash import fingerprint, near_dedup
from facet.llm.suffix import repeated_spans

SCHEMA = "doc_id long, text string, lang string, size int, shard string, h int, name string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, 1, "x", 2, "n") for i, t in rows], SCHEMA)


ODD = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, " a b"), (6, "a\tb"), (6, "a\tb"), (None, "a b"), (7, "x" * 30000), (8, "x" * 29999 + "y"), (9, "x" * 30000), (10, "é" * 5000), (11, "é" * 5000)]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]]
        out.append((i, min(x for x in ids if x is not None), len(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, bits", [(8192, 64), (7, 64), (5, 3)])
def test_exact(spark, block, bits):
    """Small blocks give many levels; a weak block hash is told apart by the blocks' bytes."""
    got = exact_dedup(docs(spark, ODD), block_bytes=block, hash_bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute_exact(ODD)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_fingerprint():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in [None, "", " \n", "A", "a B", "a b c", "Éa b c d e a b c d", "x " * 100, "one two three four five six seven eight nine"]:
        assert fingerprint(t) == brute(t), t


def classes(fps):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("rows, hot", [(1000, 4096), (20_000_000, 4096), (1000, 3)])
def test_all_links_are_found(spark, rows, hot):
    """Under each plan, and with hot values split, against all pairs."""
    rng = random.Random(rows + hot)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    plan = simhash.plan(np.array(fps, np.uint64), rows, 3)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(df, 3, plan, hot).collect()}
    want = {(simhash._signed(x), simhash._signed(y)) for x in fps for y in fps if (x ^ y).bit_count() <= 3 and simhash._signed(x) < simhash._signed(y)}
    assert got == want and sum(t for _, t in plan) <= 3


def test_thresholds_by_dynamic_programme():
    assert simhash.allot([[0, 1, 50], [0, 1, 2], [0, 9, 99]], 0) in ([0, 1, -1], [-1, 1, 0]) and simhash.allot([[0, 1, 50], [0, 1, 2], [0, 9, 99]], 0) == [0, 1, -1]


def test_near(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k:])) for i, k in enumerate([10, 200, 390, 399])] + [(20, " ".join(rng.choices(words, k=300))), (21, None), (22, ""), (23, "A b"), (24, "a B"), (24, "a B"), (None, "q r s t")]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_dedup(docs(spark, rows)).collect()}
    fps = [fingerprint(t) for _, t in rows]
    roots = classes(fps)
    for (i, _), f, r in zip(rows, fps, roots):
        ids = [j for (j, _), q in zip(rows, roots) if q == r and j is not None]
        assert got[i, f"{f:016x}"] == (min(ids) if ids else None)
    assert near_dedup(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500 + k) for k in range(1, 40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


# ---- repeated substrings


def brute_removed(texts):
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        out.append(gone)
    return out


def test_cover_is_a_difference_cover():
    assert {(int(a) - int(b)) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


@pytest.mark.parametrize("letters, room", [(b"ab", 1 << 20), (b"abcdefgh", 400)])
def test_sorting_a_block(monkeypatch, letters, room):
    monkeypatch.setattr(suffix, "_PASS", room)
    rng = random.Random(len(letters))
    base = bytes(rng.choices(letters, k=1500))
    text = b"".join(base[(i := rng.randrange(1400)) : i + rng.randrange(40, 400)] for _ in range(20)) + b"ab" * 300 + b"z" * 400
    windows = np.arange(len(text) - 99)
    seen, want = set(), []
    for p in windows:
        want.append(text[p : p + 100] in seen)
        seen.add(text[p : p + 100])
    assert suffix.repeated(text, windows).tolist() == want


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_spans(spark, monkeypatch, crowd):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh ", k=rng.randrange(100, 500)))
    shared = word() * 2
    rows = [(i, word() + (shared[: rng.randrange(120, 300)] if i % 3 else "") + word()) for i in range(30)]
    rows += [(40, rows[4][1]), (41, rows[4][1]), (42, "ab" * 200), (43, "x" * 99), (44, "x" * 100), (45, "x" * 101), (46, "é" * 80), (47, "é" * 80), (48, None), (49, ""), (50, shared)]
    if crowd == 20_000:  # ids that repeat or are null: in the order of ids, null last
        rows += [(50, shared), (None, shared)]
    got = sorted(repeated_spans(docs(spark, rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    texts = [(t or "").encode() for _, t in rows]
    for r, gone, t in zip(got, brute_removed(texts), texts):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"]) == (len(t), gone.sum())
        assert r["kept_sha256"] == __import__("hashlib").sha256(kept).hexdigest()
        assert r["n_spans"] == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()


def test_crowded_buckets():
    """Windows that travel one by one give what runs give."""
    import pandas as pd

    rng = random.Random(9)
    base = bytes(rng.choices(b"abcdefgh ", k=900))
    texts = [bytes(rng.choices(b"xyz", k=60)) + base[rng.randrange(300) : 600 + rng.randrange(300)] + bytes(rng.choices(b"uvw", k=60)) for _ in range(25)]
    want = brute_removed(texts)
    for crowd in (2, 20_000):
        suffix._CROWD, old = crowd, suffix._CROWD
        try:
            a = pd.concat(suffix._run_rows(iter([pd.DataFrame({"t": texts[i : i + 5], "ord": range(i, i + 5)}) for i in range(0, 25, 5)])))
            b = pd.concat(suffix._sift(iter([a])))
        finally:
            suffix._CROWD = old
        kinds = b["at"] & 3
        found = [(r.ord, r.at >> 16, (r.at >> 2) & 0x3FFF) for r in b[kinds == 1].itertuples()]
        rest = [(o, texts[o], [{"h": r.h, "at": r.at} for r in g.itertuples()]) for o, g in b[kinds != 1].groupby("ord")]
        if crowd == 2:
            assert (kinds == 3).any()
        pieces = pd.concat(suffix._fetched(iter([pd.DataFrame(rest, columns=["ord", "t", "places"])]))).sort_values("h")
        found += [(r.ord, r.start, r.n) for x in suffix._sorted_runs(iter([pieces])) for r in x.itertuples()]
        for i, t in enumerate(texts):
            gone = np.zeros(len(t), bool)
            for s, e in suffix.merged([(s, n) for o, s, n in found if o == i]):
                gone[s:e] = True
            assert (gone == want[i]).all()


def test_runs_that_share_no_window_are_not_sorted():
    """Texts that only share strings too short for a window send nothing to the sort; of those that share windows, the right bytes go."""
    import pandas as pd

    rng = random.Random(11)
    noise = lambda n: bytes(rng.choices(b"abcdefghijklmnop ", k=n))
    sifted = lambda texts: pd.concat(suffix._sift(suffix._run_rows(iter([pd.DataFrame({"t": texts, "ord": range(len(texts))})]))))
    for n in (30, 50, 70):  # at all places a bucket's string can have in a window
        shared = [noise(n) for _ in range(20)]
        assert len(sifted([noise(150) + x + noise(150) for x in shared for _ in range(6)])) == 0
    for _ in range(60):
        x = noise(rng.randrange(95, 190))
        texts = [noise(rng.randrange(150)) + x + noise(rng.randrange(150)) for _ in range(3)] + [noise(80) + x[:99] + noise(80), x[:50] * 5 + x]
        b = sifted(texts)
        found = [(r.ord, r.at >> 16, r.at >> 2 & 0x3FFF) for r in b[b["at"] & 3 == 1].itertuples()]
        rest = [(o, texts[o], [{"h": r.h, "at": r.at} for r in g.itertuples()]) for o, g in b[b["at"] & 3 != 1].groupby("ord")]
        pieces = pd.concat([pd.DataFrame({"h": [], "b": []}), *suffix._fetched(iter([pd.DataFrame(rest, columns=["ord", "t", "places"])]))]).sort_values("h")
        found += [(r.ord, r.start, r.n) for y in suffix._sorted_runs(iter([pieces] if len(pieces) else [])) for r in y.itertuples()]
        for i, (t, want) in enumerate(zip(texts, brute_removed(texts))):
            gone = np.zeros(len(t), bool)
            for s, e in suffix.merged([(s, n) for o, s, n in found if o == i]):
                gone[s:e] = True
            assert (gone == want).all()


def test_spans_of_nothing(spark):
    assert repeated_spans(docs(spark, [])).count() == 0
