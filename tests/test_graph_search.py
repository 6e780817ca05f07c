import numpy as np
import pytest
from pyspark.sql import functions as F

from facet.catalog import Index
from facet.engine import Engine
from facet.functions.values import LanguageError
from facet.operators import graph, search
from facet.operators.search import Analyzer


@pytest.fixture(scope="module")
def social(spark):
    e = Engine(spark)
    e.execute("""DEFINE COLLECTION user; DEFINE COLLECTION post;
        INSERT INTO user {id: 'ann', name: 'Ann', years: 51}, {id: 'ben', name: 'Ben', years: 44}, {id: 'cleo', name: 'Cleo', years: 39};
        INSERT INTO post {id: 'p1', title: 'One'}, {id: 'p2', title: 'Two'};
        RELATE user:ann->follows->user:ben SET since = 2024; RELATE user:ann->follows->user:cleo SET since = 2023;
        RELATE user:ben->follows->user:cleo SET since = 2024; RELATE user:cleo->follows->user:ann SET since = 2022;
        RELATE user:ann->wrote->post:p1; RELATE user:ben->wrote->post:p2; RELATE [user:ann, user:cleo]->likes->post:p2""")
    return e


def walk(e, text):
    return {r["id"].split(":")[1]: sorted(x["id"].split(":")[1] if ":" in x["id"] else x["id"] for x in r["x"]) for r in e.collect(text)}


def test_hops(social):
    assert walk(social, "SELECT ->follows->user AS x FROM user") == {"ann": ["ben", "cleo"], "ben": ["cleo"], "cleo": ["ann"]}
    assert walk(social, "SELECT <-follows<-user AS x FROM user") == {"ann": ["cleo"], "ben": ["ann"], "cleo": ["ann", "ben"]}
    assert walk(social, "SELECT <->follows<->user AS x FROM user:ben") == {"ben": ["ann", "cleo"]}
    assert walk(social, "SELECT ->(follows WHERE since > 2023)->user AS x FROM user:ann") == {"ann": ["ben"]}


def test_two_hops_leave_out_what_one_hop_reaches(social):
    assert walk(social, "SELECT ->follows->user->follows->user AS x FROM user") == {"ann": [], "ben": ["ann"], "cleo": ["ben"]}
    assert walk(social, "SELECT ->follows{2}->user AS x FROM user:cleo") == {"cleo": ["ben"]}
    assert walk(social, "SELECT ->follows{..}->user AS x FROM user:cleo") == {"cleo": ["ann", "ben"]}
    assert walk(social, "SELECT ->follows{2 ALL}->user AS x FROM user:ann") == {"ann": ["ann", "cleo"]}


def test_fields_and_expressions(social):
    (r,) = social.collect("SELECT ->follows.{since, who: to.name} AS x FROM user:ann")
    assert sorted((x["since"], x["who"]) for x in r["x"]) == [(2023, "Cleo"), (2024, "Ben")]
    assert [r["name"] for r in social.collect("SELECT name FROM user WHERE array::length(->likes) > 0 ORDER name")] == ["Ann", "Cleo"]
    (r,) = social.collect("SELECT ->follows->user->wrote->post.{title} AS x FROM user:cleo")
    assert [x["title"] for x in r["x"]] == ["One"]
    with pytest.raises(LanguageError):
        social.query("SELECT COUNT(->follows) FROM user")


def test_edges_are_replaced_and_cascade(spark):
    e = Engine(spark)
    e.execute("DEFINE COLLECTION u; INSERT INTO u {id: 'a'}, {id: 'b'}; RELATE u:a->k->u:b SET w = 1; RELATE u:a->k->u:b SET w = 2")
    assert e.collect("SELECT ->k.{w} AS x FROM u:a")[0]["x"][0]["w"] == 2
    with pytest.raises(LanguageError):
        e.execute("RELATE u:a->k->u:zz")
    assert e.collect("DELETE u:a->k->u:b") == [{"deleted": 1}]
    e.execute("RELATE u:a->k->u:b; DELETE u:b")
    assert e.catalog.edges["k"].df.count() == 0
    e.define_edges("r", on_delete="restrict")
    e.execute("INSERT INTO u {id: 'c'}; RELATE u:a->r->u:c")
    with pytest.raises(LanguageError):
        e.execute("DELETE u:c")


def test_traversal_matches_breadth_first_search(spark):
    rng = np.random.default_rng(0)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2))})
    edges = spark.createDataFrame([(f"e{i}", f"n:{a}", f"n:{b}") for i, (a, b) in enumerate(pairs)], "id string, from string, to string")
    starts = spark.createDataFrame([(f"n:{i}",) for i in range(30)], "start string")
    got = {(r["start"], r["node"]) for r in graph.traverse(starts, [graph.Step(edges, "->", 2, 4)]).collect()}
    want = set()
    for s in range(30):
        seen, level = {s}, {s}
        for d in range(1, 5):
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(f"n:{s}", f"n:{x}") for x in level if d >= 2}
    assert got == want


TEXTS = ["rust database engine", "Rust is a language. Rust!", "database systems and database theory", None, "", "cooking with rust-free pans"]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([(f"a:{i}", t) for i, t in enumerate(TEXTS)], "id string, body string")


def bm25(term):
    docs = [[w.lower() for w in __import__("re").findall(r"\w+", t)] for t in TEXTS if t is not None]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = sum(term in d for d in docs)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return {i: idf * d.count(term) * 2.2 / (d.count(term) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for i, d in zip([i for i, t in enumerate(TEXTS) if t is not None], docs) if term in d}


def test_bm25(articles):
    got = {int(r["id"][2:]): r["$score"] for r in search.bm25(articles, [("body", 1.0)], "rust").collect()}
    want = bm25("rust")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    ids = lambda q: sorted(int(r["id"][2:]) for r in search.bm25(articles, [("body", 1.0)], q).collect())
    assert ids("+rust -database") == [1, 5] and ids('"database theory"') == [2] and ids("rust AND engine") == [0] and ids("zzz") == [] and ids("") == []


@pytest.mark.parametrize("a", [Analyzer(), Analyzer(("whitespace",), ()), Analyzer(("pattern", "[ .]"), (("lowercase",),)), Analyzer(("ngram", 2, 3), (("lowercase",), ("ascii_folding",))), Analyzer(("standard",), (("lowercase",), ("stopwords", "english"), ("length", 3, 9), ("stemmer", "english")))])
def test_constants_and_columns_have_the_same_terms(articles, a):
    got = {r["id"]: r["t"] for r in articles.select("id", a.terms(F.col("body")).alias("t")).collect()}
    assert got == {f"a:{i}": a.of(t or "") for i, t in enumerate(TEXTS)}


def test_search_in_the_language(spark, articles):
    e = Engine(spark)
    e.catalog.put("a", articles, indexes=[Index("f", ("body",), "fulltext")])
    rows = e.collect("SELECT id, fts::score() AS s FROM a WHERE body @@ 'rust database' ORDER s DESC LIMIT 2")
    assert rows[0]["s"] >= rows[1]["s"] > 0
    with pytest.raises(LanguageError):
        e.query("SELECT * FROM a WHERE id @@ 'x'")
    (r,) = e.collect("SELECT fts::score('x') AS x, fts::score('y') AS y FROM a WHERE body @:x@ 'engine' AND body @:y@ 'rust'")
    assert r["x"] > 0 and r["y"] > 0


@pytest.mark.parametrize("metric, want", [("COSINE", ["v:1", "v:4", "v:2"]), ("EUCLIDEAN", ["v:1", "v:4", "v:2"]), ("DOT", ["v:1", "v:4", "v:2"])])
def test_nearest(spark, metric, want):
    e = Engine(spark)
    rows = [("v:1", [1.0, 0.0, 0.0], "a"), ("v:2", [0.0, 1.0, 0.0], "b"), ("v:3", [-1.0, 0.0, 0.0], "a"), ("v:4", [0.7, 0.7, 0.0], "b"), ("v:5", None, "a")]
    e.catalog.put("v", spark.createDataFrame(rows, "id string, embedding array<double>, k string"), indexes=[Index("h", ("embedding",), "hnsw", (("dimension", 3), ("metric", metric)))])
    got = e.collect("SELECT id, vector::distance() AS d FROM v WHERE embedding <|3|> [1, 0, 0]")
    assert [r["id"] for r in got] == want
    assert [r["id"] for r in e.collect("SELECT id FROM v WHERE embedding <|2, 50|> [1, 0, 0] AND k = 'b'")] == ["v:4"]
    with pytest.raises(LanguageError):
        e.query("SELECT id FROM v WHERE embedding <|2|> [1, 0]")


def test_rrf(spark):
    e = Engine(spark)
    rows = e.collect("SELECT id, a, _rrf_score AS s FROM search::rrf([(SELECT * FROM [{id: 'x', a: 1}, {id: 'y', a: 2}]), (SELECT * FROM [{id: 'y', a: 9}, {id: 'z', a: 3}])], 10, 60)")
    assert [(r["id"], r["a"]) for r in rows] == [("y", 2), ("x", 1), ("z", 3)]
    assert abs(rows[0]["s"] - (1 / 62 + 1 / 61)) < 1e-12


def test_undirected_edges_are_walked_both_ways(spark):
    e = Engine(spark)
    e.execute("DEFINE COLLECTION u; INSERT INTO u {id: 'a', n: 1}, {id: 'b', n: 2}, {id: 'c', n: 3}")
    e.define_edges("pal", directed=False)
    e.execute("RELATE u:b->pal->u:a SET w = 5; RELATE u:b->pal->u:c SET w = 6")
    walk = lambda q: sorted(x["n"] for x in e.collect(q)[0]["x"])
    assert walk("SELECT ->pal->u.{n} AS x FROM u:a") == [2] and walk("SELECT <-pal<-u.{n} AS x FROM u:b") == [1, 3]
    assert walk("SELECT ->pal{2}->u.{n} AS x FROM u:a") == [3]
    assert sorted(x["w"] for x in e.collect("SELECT ->pal.{w, n: to.n} AS x FROM u:b")[0]["x"]) == [5, 6]


def test_ranks_of_long_lists(spark, monkeypatch):
    from facet.operators import search

    lists = [spark.createDataFrame([(f"d{i}", (i * k) % 101) for i in range(100)], "id string, o long") for k in (7, 13)]
    run = lambda: [tuple(r) for r in search.rrf([(d, [F.col("o"), F.col("id")]) for d in lists], 12).select("id", "_rrf_score").collect()]
    want = run()
    monkeypatch.setattr(search, "ONE_TASK", 0)
    assert run() == want and len(want) == 12
