"""Every registered query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from facet.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_pushdown(spark):
    from facet.sources.tables import open_tables

    plan = open_tables(spark, DATA).collect("EXPLAIN SELECT VALUE l_quantity FROM lineitem WHERE l_discount > 0.05")[0]["plan"]
    assert "GreaterThan(l_discount,0.05)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double>" in plan or "ReadSchema: struct<l_discount:double,l_quantity:double>" in plan
    plan = open_tables(spark, DATA).collect("EXPLAIN SELECT VALUE o_totalprice FROM orders:7")[0]["plan"]
    assert "EqualTo(o_orderkey,7)" in plan
