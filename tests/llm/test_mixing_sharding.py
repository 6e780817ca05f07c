import random
import zlib

import pytest

from facet.llm.mixing import mix_sources, water_fill
from facet.llm.sharding import _Search, shard_documents


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, rank int, target string")


def test_water_fill():
    assert water_fill([10, 10, 10], [5, 2, 1], 45, 2) == [20.0, 50 / 3, 25 / 3]
    assert water_fill([10, 0, 10], [1, 1, 1], 100, 2) == [20.0, 0.0, 20.0]
    assert water_fill([], [], 0, 2) == []


def test_mixture(spark):
    rng = random.Random(0)
    sizes = {"b": 400, "a": 30, "é": 60, None: 20, "c": 1}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), s))
            i += 1
    rows += [(i, None, "a"), (i + 1, "", "b"), (i + 1, "", "b"), (None, "x y", "b"), (None, None, "empty")]
    first = mix_sources(docs(spark, rows)).collect()
    again = mix_sources(docs(spark, rows[::-1])).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)
    total = sum(r["size"] for r in first)
    names = ["a", "b", "c", "empty", "é", None]
    by = {s: [len((t or "").split()) for _, t, x in rows if x == s] for s in names}
    targets = water_fill([sum(by[s]) for s in names], [5.0, 2.0, 1.0, 5.0, 2.0, 1.0], 1.5 * total, 2)
    got = {}
    for r in first:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        got.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for s, t in zip(names, targets):
        taken = sum(got[sum(by[s]), round(t, 6)])
        assert abs(taken - t) <= max(2, 0.02 * t, max(by[s]) if len(by[s]) < 5 else 0), (s, t, taken)


def test_mixture_of_nothing(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    (r,) = mix_sources(docs(spark, [(1, None, None)])).collect()
    assert (r["size"], r["target"], r["taken"]) == (0, 0.0, 0)


def test_hot_source_and_hot_cell(spark):
    rows = [(i, "same words here", "hot") for i in range(300)] + [(1000 + i, "a b " * (i % 9 + 1), f"s{i % 3}") for i in range(90)]
    out = mix_sources(docs(spark, rows)).collect()
    hot = [r for r in out if r["source_size"] == 900]
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 3 and len(out) == 390


def fits(sizes, capacity, shards):
    used, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used <= shards


@pytest.mark.parametrize("points", [4, 7, 65536])
def test_capacity_is_the_least(spark, points):
    rng = random.Random(points)
    texts = ["t%d " % rng.randrange(400) + "x" * int(rng.paretovariate(1) * 30 % 4000) for _ in range(300)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(1000 + i, "copy" * 40, None) for i in range(50)] + [(2000, None, None), (2001, "", None), (2001, "", None), (None, "n", None)]
    out = shard_documents(docs(spark, rows), shards=7, points=points).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in out:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert sum(r["size"] for r in rs) <= out[0]["capacity"]
    # the least capacity, by brute force over the groups in their order
    import hashlib

    total = {}
    for _, t, _ in rows:
        k = hashlib.sha256((t or "").encode()).digest()
        total[k] = total.get(k, 0) + len((t or "").encode()) + 16
    ordered = [total[k] for k in sorted(total)]
    least = next(c for c in range(max(ordered), sum(ordered) + 1) if fits(ordered, c, 7))
    assert out[0]["capacity"] == least
    t = next(t for i, t, _ in rows if i == 3)
    r = next(r for r in out if r["doc_id"] == 3)
    assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t.encode()))


def test_few_groups_and_none(spark):
    assert shard_documents(docs(spark, [])).count() == 0
    out = shard_documents(docs(spark, [(1, "a", None), (2, "b", None), (3, "a", None)]), shards=40).collect()
    assert len({r["shard"] for r in out}) == 2 and all(0 <= r["shard"] < 40 for r in out)


def test_search_alone():
    s = _Search(100, 3, 30)
    s.learn([(0, 100)], [(30, 30, 1), (55, 55, 1), (70, 70, 1)])
    assert s.capacity(True) == s.capacity(False) == 40 and s.level(40) == [30, 70, 100]
