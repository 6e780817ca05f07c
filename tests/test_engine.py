import datetime as dt
from decimal import Decimal

import pytest

from facet.engine import Engine
from facet.functions.values import LanguageError


@pytest.fixture
def e(spark):
    return Engine(spark)


@pytest.fixture(scope="module")
def people(spark):
    e = Engine(spark)
    e.execute("""
        DEFINE COLLECTION users; DEFINE COLLECTION orders;
        INSERT INTO users {id: 'ann', name: 'ann', age: 30}, {id: 'ben', name: 'ben', age: 25}, {id: 'cleo', name: 'cleo', age: 35};
        INSERT INTO orders {id: 'o1', user_name: 'ann', amount: 100, status: 'active'}, {id: 'o2', user_name: 'ann', amount: 200, status: 'inactive'},
            {id: 'o3', user_name: 'ben', amount: 50, status: 'active'}, {id: 'o4', user_name: 'dan', amount: 300, status: 'active'}
    """)
    return e


def values(e, text, *names):
    return [tuple(r[n] for n in names) for r in e.collect(text)]


def test_rows_carry_their_id(people):
    assert people.collect("SELECT name FROM users WHERE age > 30") == [{"id": "users:cleo", "name": "cleo"}]


def test_aggregates(people):
    (r,) = people.collect("SELECT COUNT(*), SUM(age), AVG(age) AS a, MIN(name) AS m, COUNT(DISTINCT age) AS d FROM users")
    assert (r["count(*)"], r["sum(age)"], float(r["a"]), r["m"], r["d"]) == (3, Decimal(90), 30.0, "ann", 3)


def test_group_rules(people):
    assert values(people, "SELECT status, COUNT(*) AS n FROM orders GROUP status ORDER n DESC", "status", "n") == [("active", 3), ("inactive", 1)]
    for bad in ("SELECT name, COUNT(*) FROM users", "SELECT SUM(*) FROM users", "SELECT age + COUNT(*) FROM users"):
        with pytest.raises(LanguageError):
            people.query(bad)


def test_correlated_subqueries(people):
    got = values(people, "SELECT name, (SELECT COUNT(*) AS n, SUM(amount) AS s FROM orders WHERE user_name = $parent.name)[0] AS o FROM users ORDER name", "name", "o")
    assert [(n, o["n"], o["s"]) for n, o in got] == [("ann", 2, 300), ("ben", 1, 50), ("cleo", 0, None)]
    got = values(people, "SELECT name, (SELECT VALUE amount FROM orders WHERE user_name = $parent.name AND amount > $parent.age ORDER amount DESC) AS a FROM users ORDER name", "name", "a")
    assert got == [("ann", [200, 100]), ("ben", [50]), ("cleo", [])]


def test_semi_and_anti(people):
    assert values(people, "SELECT name FROM users WHERE name IN (SELECT user_name FROM orders) ORDER name", "name") == [("ann",), ("ben",)]
    assert values(people, "SELECT name FROM users WHERE name NOT IN (SELECT user_name FROM orders)", "name") == [("cleo",)]
    assert people.collect("SELECT name FROM users WHERE name NOT IN (SELECT VALUE nothing FROM orders)") == []


def test_null_missing_and_truth(e):
    e.execute("DEFINE COLLECTION items; INSERT INTO items {id: 'a', name: 'A', tag: 'x', n: 0}, {id: 'b', name: 'B', tag: null}, {id: 'c', name: '', n: 5}")
    names = lambda w: sorted(r["id"][-1] for r in e.collect(f"SELECT id FROM items WHERE {w}"))
    assert names("tag IS NULL") == ["b", "c"] and names("tag IS NONE") == ["c"] and names("tag IS NOT NONE") == ["a", "b"]
    assert names("n") == ["c"] and names("name") == ["a", "b"] and names("nothing IS NONE") == ["a", "b", "c"]
    assert sorted(values(e, "SELECT id, n ?? 7 AS v, type::coalesce(n, 7) AS w FROM items", "id", "v", "w")) == [("items:a", 7, 0), ("items:b", 7, 7), ("items:c", 5, 5)]
    assert names("tag = 'x' OR n > 1") == ["a", "c"]
    with pytest.raises(LanguageError):
        e.query("SELECT * FROM items WHERE name AND n")


def test_arithmetic_and_kinds(e):
    (r,) = e.collect("SELECT 7 / 2 AS a, -7 / 2 AS b, 7.0 / 2 AS c, 1 + 0.5dec AS d, 'a' + 'b' AS e, [1] + [2] AS f, 5 < 'a' AS g, 1 = 1.0 AS h, null + 1 AS i, 3 != 'x' AS j")
    assert (r["a"], r["b"], r["c"], float(r["d"]), r["e"], r["f"], r["g"], r["h"], r["i"], r["j"]) == (3, -3, 3.5, 1.5, "ab", [1, 2], False, True, None, True)
    (r,) = e.collect("SELECT d'2024-01-02' - d'2024-01-05' AS a, d'2024-01-01' + 1d AS b, 1h - 2h AS c")
    assert r["a"] == dt.timedelta(days=3) and r["b"].day == 2 and r["c"] == dt.timedelta(0)
    with pytest.raises(LanguageError):
        e.query("SELECT 'a' + 1")
    with pytest.raises(Exception):
        e.collect("SELECT 1 / 0")


def test_arrays(e):
    (r,) = e.collect("SELECT [10, 20, 30][0] AS a, [10, 20, 30][-1] AS b, [1, 2][5] AS c, [1, 2, 3, 4][1..2] AS d, [1, 2, 3][..1] AS e, [1, 2, 3][-2..] AS f, [1][3..] AS g")
    assert list(r.values()) == [10, 30, None, [2, 3], [1, 2], [2, 3], []]


def test_sources(e):
    assert e.collect("SELECT VALUE $value FROM 2..4") == [2, 3, 4] and e.collect("SELECT VALUE $value FROM 4..2") == []
    assert e.collect("SELECT * FROM [1, 'x', true]") is not None
    assert e.collect("SELECT COUNT(*) AS n FROM null") == [{"n": 0}]
    assert e.collect("SELECT a, COUNT(*) AS n FROM [{a: 1}, {a: 2}, {a: 1}] GROUP a ORDER a") == [{"a": 1, "n": 2}, {"a": 2, "n": 1}]
    assert e.collect("SELECT * FROM nowhere") == []


def test_control_flow_and_variables(e):
    assert e.collect("LET x = 2; LET y = $x * 3; $y + 1") == [7]
    assert e.collect("FOR $i IN [1, 2, 3] DO IF $i = 2 THEN CONTINUE END; $i * 10 END") == [10, 30]
    assert e.collect("LET r = IF 1 > 2 THEN 'a' ELSE IF '' THEN 'b' ELSE 'c' END; $r") == ["c"]
    assert e.collect("$p + 1", {"p": 4}) == [5]
    with pytest.raises(LanguageError):
        e.query("$nope")
    with pytest.raises(LanguageError):
        e.query("IF true THEN BEGIN END")


def test_references(e):
    e.execute("""DEFINE COLLECTION company; DEFINE COLLECTION user; DEFINE COLLECTION post (title string, tags [ref<company>]);
        INSERT INTO company {id: 'c', name: 'Acme'}, {id: 'd', name: 'Dot'}; INSERT INTO user {id: 'u', name: 'U', company: company:c}, {id: 'v', name: 'V', company: company:zz};
        INSERT INTO post {id: '1', title: 'a', author: user:u, tags: [company:d, company:c]}, {id: '2', title: 'b', author: user:v, tags: []}, {id: '3', title: 'c'}""")
    assert values(e, "SELECT title, author.company.name AS c FROM post ORDER title", "title", "c") == [("a", "Acme"), ("b", None), ("c", None)]
    rows = e.collect("SELECT title, author, tags FROM post ORDER title FETCH author.company, tags")
    assert rows[0]["author"]["company"]["name"] == "Acme" and [t["name"] for t in rows[0]["tags"]] == ["Dot", "Acme"]
    assert rows[1]["author"]["company"] is None and rows[2]["author"] is None
    assert e.collect("SELECT title, author FROM post:1 FETCH author AS who")[0]["who"]["name"] == "U"


def test_distinct_ignores_the_id(people):
    assert sorted(r["status"] for r in people.collect("SELECT DISTINCT status FROM orders")) == ["active", "inactive"]


def test_writes(e):
    e.execute("DEFINE COLLECTION t; INSERT INTO t {id: 'a', n: 1}, {id: 'b', n: 2}")
    with pytest.raises(LanguageError):
        e.execute("INSERT INTO t {id: 'a'}")
    with pytest.raises(LanguageError):
        e.execute("INSERT INTO missing {id: 'a'}")
    with pytest.raises(LanguageError):
        e.execute("INSERT INTO t {id: 'x:y'}")
    assert values(e, "UPDATE t SET n = n + 10, o.p.q = 'z' WHERE n > 1", "id", "n") == [("t:b", 12)]
    assert e.collect("SELECT o.p.q AS q FROM t:b") == [{"id": "t:b", "q": "z"}]
    e.execute("UPSERT t:b REPLACE SET m = 1; UPSERT t:c SET n = 3")
    assert sorted(values(e, "SELECT id, n, m FROM t", "id", "n", "m")) == [("t:a", 1, None), ("t:b", None, 1), ("t:c", 3, None)]
    e.execute("UPDATE t SET n = 'text' WHERE id = 't:a'")
    assert sorted((str(r["k"])) for r in e.collect("SELECT type::of(n) AS k FROM t")) == ["int", "null", "string"]
    assert [r["id"] for r in e.collect("SELECT id FROM t WHERE n = 3")] == ["t:c"]
    assert len(e.collect("DELETE t WHERE m = 1")) == 1 and e.collect("SELECT COUNT(*) AS n FROM t") == [{"n": 2}]


def test_schema(e):
    e.execute("DEFINE COLLECTION p (SCHEMA STRICT, name string REQUIRED, age int|null, score float DEFAULT 1.5, INDEX ON (name) UNIQUE)")
    e.execute("INSERT INTO p {id: '1', name: 'a', age: 3}")
    assert e.collect("SELECT score FROM p") == [{"id": "p:1", "score": 1.5}]
    for bad in ("{id: '2', age: 3}", "{id: '2', name: 5}", "{id: '2', name: 'b', agee: 3}", "{id: '2', name: 'a'}"):
        with pytest.raises(LanguageError):
            e.execute(f"INSERT INTO p {bad}")
    assert e.collect("SELECT COUNT(*) AS n FROM p") == [{"n": 1}]
    with pytest.raises(LanguageError):
        e.execute("DROP COLLECTION p")
    e.execute("DROP COLLECTION p CASCADE")
    assert "p" not in e.catalog.collections


def test_transactions(e):
    e.execute("DEFINE COLLECTION t; INSERT INTO t {id: 'a', n: 1}")
    e.execute("BEGIN; UPDATE t SET n = 5; ROLLBACK")
    assert e.collect("SELECT VALUE n FROM t") == [1]
    with pytest.raises(LanguageError):
        e.execute("BEGIN; UPDATE t SET n = 5; INSERT INTO t {id: 'a'}")
    assert e.collect("SELECT VALUE n FROM t") == [1]
    with e.transaction() as s:
        s.execute("UPDATE t SET n = 7")
        assert e.collect("SELECT VALUE n FROM t") == [1]
    assert e.collect("SELECT VALUE n FROM t") == [7]
    with pytest.raises(LanguageError):
        with e.transaction() as s:
            s.execute("UPDATE t SET n = 8")
            e.execute("UPDATE t SET n = 9")
    assert e.collect("SELECT VALUE n FROM t") == [9]


def test_explain_describe_timeout(people):
    assert "Physical Plan" in people.collect("EXPLAIN SELECT * FROM users WHERE age > 3")[0]["plan"]
    assert people.collect("EXPLAIN ANALYZE SELECT * FROM users")[0]["plan"].startswith("rows: 3")
    assert people.collect("DESCRIBE COLLECTION users")[0]["name"] == "users"
    people.execute("SET QUERY_TIMEOUT = 1h")
    assert people.timeout == 3600


def test_policies(e):
    e.execute("""CREATE USER 'ann' PASSWORD 'pw'; ALTER USER 'ann' SET team = 'blue'; DEFINE COLLECTION docs; ALTER COLLECTION docs SET level = 'open';
        CREATE POLICY p WHEN user.team = 'blue' AND action IN ('read', 'write') ALLOW; CREATE POLICY q WHEN action = 'write' AND collection.level != 'open' DENY""")
    assert e.login("ann", "pw") and not e.login("ann", "no")
    assert e.allowed("ann", "read", "docs") and e.allowed("ann", "write", "docs") and not e.allowed("ann", "drop", "docs")
    e.execute("ALTER COLLECTION docs SET level = 'shut'")
    assert not e.allowed("ann", "write", "docs") and e.allowed("root", "drop", "docs")


def test_backup(e, tmp_path):
    from facet.sources.tables import backup, restore

    e.execute("DEFINE COLLECTION t; INSERT INTO t {id: 'a', n: 1}")
    backup(e, str(tmp_path))
    other = Engine(e.spark)
    restore(other, str(tmp_path), ["t"])
    assert other.collect("SELECT n FROM t") == [{"id": "t:a", "n": 1}]


def test_streaming(spark, tmp_path):
    from facet.streaming import watch

    spark.createDataFrame([("e:1", "a", 1), ("e:2", "b", 5), ("e:3", "a", 7)], "id string, k string, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, k string, v int").parquet(str(tmp_path / "in"))
    out = watch(Engine(spark), "events", stream, "SELECT k, COUNT(*) AS n, SUM(v) AS s FROM events WHERE v > 0 GROUP k")
    query = out.writeStream.format("memory").queryName("watched").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["k"], r["n"], int(r["s"])) for r in spark.table("watched").collect()) == [("a", 2, 8), ("b", 1, 5)]


def test_json(e):
    from facet.sources.encoding import plain, typed, untyped

    (row,) = e.collect("SELECT 9223372036854775807 AS big, 123.45dec AS price, d'2024-01-15T10:30:00Z' AS at, 1h30m AS ttl, b'SGVsbG8=' AS payload, user:x AS owner, [1, 2] AS list, {a: 1.5} AS o, null AS n")
    t = typed(row, frozenset(["owner"]))
    assert {k: (v["$type"], v["value"]) for k, v in t.items() if isinstance(v, dict) and "$type" in v} == {
        "big": ("int64", "9223372036854775807"), "price": ("decimal", "123.45"), "at": ("datetime", "2024-01-15T10:30:00+00:00"),
        "ttl": ("duration", "5400000000000"), "payload": ("bytes", "SGVsbG8="), "owner": ("reference", "user:x"),
    }
    back = untyped(t)
    assert back["big"] == row["big"] and back["payload"] == row["payload"] and back["list"] == [1, 2] and back["o"] == {"a": 1.5} and back["n"] is None
    assert plain(row)["ttl"] == {"_type": "duration", "nanos": 5_400_000_000_000} and plain(row)["price"] == 123.45


def test_sessions_and_transactions(spark, e):
    """A transaction's writes are its own until COMMIT, which fails where another session has changed the same."""
    e.execute("DEFINE COLLECTION t; INSERT INTO t {id: 'a', n: 1}; DEFINE COLLECTION u; INSERT INTO u {id: 'a', n: 1}")
    other = Engine(spark, e.catalog)
    e.execute("BEGIN; UPDATE t SET n = 5")
    assert e.collect("SELECT VALUE n FROM t") == [5] and other.collect("SELECT VALUE n FROM t") == [1]
    other.execute("UPDATE u SET n = 3")
    e.execute("COMMIT")
    assert other.collect("SELECT VALUE n FROM t") == [5] and e.collect("SELECT VALUE n FROM u") == [3]
    e.execute("BEGIN; UPDATE t SET n = 6")
    other.execute("UPDATE t SET n = 7")
    with pytest.raises(LanguageError, match="conflict"):
        e.execute("COMMIT")
    assert e.collect("SELECT VALUE n FROM t") == [7] and other.collect("SELECT VALUE n FROM t") == [7]
    e.execute("BEGIN; UPDATE t SET n = 8")
    other.execute("UPDATE u SET n = 4")
    e.execute("ROLLBACK")  # undoes nothing of others
    assert e.collect("SELECT VALUE n FROM u") == [4] and e.collect("SELECT VALUE n FROM t") == [7]


def test_analyzer_guards(e):
    e.execute("DEFINE COLLECTION d; DEFINE ANALYZER own TOKENIZER whitespace FILTERS [lowercase]; CREATE INDEX ON d(a) FULLTEXT ANALYZER own")
    for bad in ("CREATE INDEX ON d(b) FULLTEXT ANALYZER nonexistent", "DROP ANALYZER standard", "DROP ANALYZER own", "DEFINE ANALYZER english TOKENIZER standard FILTERS [lowercase]", "CREATE INDEX ON d(c) FULLTEXT ANALYZER russian", "CREATE INDEX ON d(c) ANALYZER english"):
        with pytest.raises((LanguageError, ValueError)):
            e.execute(bad)
    e.execute("CREATE INDEX ON d(c) FULLTEXT ANALYZER english")


def test_policies_hold_for_statements(e):
    e.execute("""DEFINE COLLECTION docs; DEFINE COLLECTION refs; INSERT INTO refs {id: 'r', v: 1}; INSERT INTO docs {id: 'a', n: 1, r: refs:r}; CREATE USER 'ann' PASSWORD 'pw';
        CREATE POLICY p WHEN user.name = 'ann' AND action IN ('select', 'insert') AND collection.name = 'docs' ALLOW""")
    ann = e.session("ann", "pw")
    assert ann.collect("SELECT VALUE n FROM docs") == [1]
    ann.execute("INSERT INTO docs {id: 'b', n: 2}")
    for bad in ("UPDATE docs SET n = 3", "DELETE docs", "SELECT * FROM refs", "SELECT r.v AS v FROM docs", "DROP COLLECTION docs", "CREATE USER 'x' PASSWORD 'y'", "SELECT * FROM [1] WHERE 1 IN (SELECT VALUE v FROM refs)"):
        with pytest.raises(LanguageError, match="may not"):
            ann.query(bad)
    with pytest.raises(LanguageError):
        e.session("ann", "no")
    assert e.collect("SELECT VALUE n FROM docs ORDER n") == [1, 2]


def test_first_of_a_subquery_is_limited(people):
    df = people.query("SELECT name, (SELECT VALUE name FROM users ORDER age)[0] AS least FROM users")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" in plan and len({r["least"] for r in df.collect()}) == 1


def test_explain_analyze_measures_each_operator(people):
    plan = people.collect("EXPLAIN ANALYZE SELECT age, COUNT(*) AS n FROM users WHERE age > 3 GROUP age")[0]["plan"]
    lines = plan.split("\n")
    assert lines[0].startswith("rows: ") and any("HashAggregate" in x and "rows" in x for x in lines) and any("Exchange" in x and "ms" in x for x in lines)
    assert "Filter" in people.collect("EXPLAIN ANALYZE DELETE users WHERE age > 3")[0]["plan"] and people.collect("SELECT COUNT(*) AS n FROM users")[0]["n"] == 3


def test_vectors_have_the_dimension_of_their_index(e):
    e.execute("DEFINE COLLECTION v; CREATE INDEX ON v(x) HNSW DIMENSION 2 DIST COSINE; INSERT INTO v {id: 'a', x: [1.0, 2.0]}, {id: 'b'}")
    with pytest.raises(LanguageError, match="2 entries"):
        e.execute("INSERT INTO v {id: 'c', x: [1.0, 2.0, 3.0]}")
    with pytest.raises(LanguageError, match="2 entries"):
        e.execute("UPDATE v SET x = [1.0] WHERE x IS NOT NULL")
    assert e.collect("SELECT COUNT(*) AS n FROM v")[0]["n"] == 2
