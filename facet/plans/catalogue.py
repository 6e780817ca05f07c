"""The registered queries of the engine, each with DuckDB SQL that gives the same rows.

Most are statements of the query language over the tables of a folder.  ``tidy`` makes results comparable:
it drops the implied ids unless they are asked for, rounds doubles and turns exact sums into plain numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dml, graph, search
from ..operators.search import Analyzer
from ..engine import Engine
from ..sources.tables import open_tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 4, keep_id: bool = False) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "id" and not keep_id:
            continue
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint") if f.dataType.scale == 0 else F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def q(name: str, text: str, sql: str, digits: int = 4, keep_id: bool = False, metric: str = "COSINE", then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = open_tables(spark, sf_dir, metric).query(text)
        return tidy(then(df) if then else df, digits, keep_id)

    run.__name__ = name
    _QUERIES[name] = run
    _SQL[name] = sql


def direct(name: str, sql: str) -> Callable[[Query], Query]:
    """Register an operator used without the language."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        _SQL[name] = sql
        return f

    return put


def flat(df: DataFrame) -> DataFrame:
    """Rows of values that are objects as columns."""
    return df.select("value.*") if df.columns == ["value"] and isinstance(df.schema[0].dataType, T.StructType) else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scans and filters

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
q("scan_all", "SELECT r_regionkey, r_name FROM region", "SELECT r_regionkey, r_name FROM region")
q("scan_star", "SELECT * FROM nation", "SELECT n_nationkey, n_name, n_regionkey, 'region:' || n_regionkey AS region FROM nation")
q("key_lookup", f"SELECT {_O} FROM orders:7", f"SELECT {_O} FROM orders WHERE o_orderkey = 7")
q("filter_eq", f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F'", f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F'")
q("filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
q("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07")
q("filter_datetime", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= d'1995-01-01' AND o_orderdate < d'1995-03-01T00:00:00Z'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'")
q("filter_compound", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
q("filter_or_union", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_acctbal < 0 OR c_mktsegment = 'MACHINERY'", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")
q("filter_or_of_ands", "SELECT p_partkey FROM part WHERE (p_size < 5 AND p_retailprice > 900) OR (p_size > 45 AND NOT p_brand = 'Brand#11')", "SELECT p_partkey FROM part WHERE (p_size < 5 AND p_retailprice > 900) OR (p_size > 45 AND NOT p_brand = 'Brand#11')")
q("filter_in", "SELECT n_name FROM nation WHERE n_nationkey IN [1, 5, 7, 99]", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 5, 7, 99)")
q("filter_not_in", "SELECT n_name FROM nation WHERE n_nationkey NOT IN [1, 5, 7]", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 5, 7)")
q("filter_is_null", "SELECT doc_id FROM documents WHERE (SELECT VALUE quality FROM labels WHERE doc_id = $parent.doc_id)[0] IS NULL", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
q("filter_is_none", "SELECT doc_id FROM documents WHERE nothing IS NONE AND lang IS NOT NONE", "SELECT doc_id FROM documents")
q("filter_truthy", "SELECT doc_id, toxic FROM labels WHERE toxic", "SELECT doc_id, toxic FROM labels WHERE toxic <> 0")
q("filter_cross_kind", "SELECT n_name FROM nation WHERE n_name != 5", "SELECT n_name FROM nation")
q("field_vs_field", "SELECT s_suppkey FROM supplier WHERE s_suppkey < s_acctbal AND s_nationkey != s_suppkey", "SELECT s_suppkey FROM supplier WHERE s_suppkey < s_acctbal AND s_nationkey <> s_suppkey")

# ---- projections

q("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity + 1 AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge, round(-l_quantity + 1, 2) AS m FROM lineitem", digits=7)
q("project_int_division", "SELECT o_orderkey, o_orderkey / 7 AS d, (0 - o_orderkey) / 7 AS e FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, (0 - o_orderkey) // 7 AS e FROM orders")
q("project_implicit_id", "SELECT n_name FROM nation", "SELECT 'nation:' || n_nationkey AS id, n_name FROM nation", keep_id=True)
q("project_default_names", "SELECT string::lower(n_name), n_nationkey FROM nation", "SELECT lower(n_name) AS \"string::lower(n_name)\", n_nationkey FROM nation")
q("object_ctor", "SELECT {k: n_nationkey, up: string::upper(n_name)} AS o FROM nation", "SELECT n_nationkey AS k, upper(n_name) AS up FROM nation", then=lambda d: d.select("o.k", "o.up"))
q("array_ctor", "SELECT n_nationkey, [n_regionkey, n_nationkey * 2][1] AS v FROM nation", "SELECT n_nationkey, CAST(n_nationkey * 2 AS BIGINT) AS v FROM nation")
q("array_index", "SELECT vec_id, embedding[0] AS a, embedding[-1] AS z, embedding[999] IS NULL AS none FROM embeddings", "SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS a, round(embedding[64]::DOUBLE, 4) AS z, true AS none FROM embeddings")
q("array_slice", "SELECT vec_id, array::length(embedding[1..3]) AS n, embedding[1..3][2] AS v, array::length(embedding[-2..]) AS m FROM embeddings", "SELECT vec_id, 3::BIGINT AS n, round(embedding[4]::DOUBLE, 4) AS v, 2::BIGINT AS m FROM embeddings")
q("coalesce_truthy", "SELECT doc_id, toxic ?? quality ?? 7 AS v FROM labels", "SELECT doc_id, CASE WHEN toxic <> 0 THEN toxic WHEN quality <> 0 THEN quality ELSE 7 END::BIGINT AS v FROM labels")
q("constants", "SELECT math::pi AS pi, math::e AS e, math::tau AS tau", "SELECT round(pi(), 4) AS pi, round(exp(1), 4) AS e, round(2 * pi(), 4) AS tau")
q("field_expansion", "SELECT nation.{n_name, region: n_regionkey} FROM supplier", "SELECT n_name, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey")
q("string_plus", "SELECT n_nationkey, n_name + '/' + 'x' AS v FROM nation", "SELECT n_nationkey, n_name || '/x' AS v FROM nation")
q("datetime_minus", "SELECT o_orderkey, duration::secs(o_orderdate - d'1992-01-01') AS s FROM orders", "SELECT o_orderkey, abs(epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01'))::BIGINT AS s FROM orders")

# ---- order, limit, distinct, value

q("order_multi", "SELECT c_custkey, c_nationkey FROM customer ORDER c_nationkey DESC, c_custkey ASC LIMIT 50", "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 50")
q("order_expr", "SELECT o_orderkey FROM orders ORDER o_totalprice * -1, o_orderkey LIMIT 20", "SELECT o_orderkey FROM orders ORDER BY -o_totalprice, o_orderkey LIMIT 20")
q("order_alias", "SELECT p_partkey, p_size * 2 AS s FROM part ORDER s DESC, p_partkey LIMIT 15", "SELECT p_partkey, (p_size * 2)::BIGINT AS s FROM part ORDER BY s DESC, p_partkey LIMIT 15")
q("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
q("limit_offset", "SELECT c_custkey FROM customer ORDER c_custkey LIMIT 10 OFFSET 25", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
q("distinct_one", "SELECT DISTINCT c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer")
q("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
q("select_value", "SELECT VALUE n_name FROM nation", "SELECT n_name AS value FROM nation")
q("select_distinct_value", "SELECT DISTINCT VALUE n_regionkey FROM nation", "SELECT DISTINCT n_regionkey AS value FROM nation")

# ---- aggregates

q("agg_count", "SELECT COUNT(*) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem")
q("agg_count_field", "SELECT COUNT(lang) AS n, COUNT(nothing) AS z FROM documents", "SELECT count(lang) AS n, 0::BIGINT AS z FROM documents")
q("agg_count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS n, COUNT(o_custkey) AS m FROM orders", "SELECT count(DISTINCT o_custkey) AS n, count(o_custkey) AS m FROM orders")
q("agg_sum_int", "SELECT SUM(p_size) AS s FROM part", "SELECT sum(p_size)::BIGINT AS s FROM part")
q("agg_sum_float", "SELECT SUM(l_extendedprice) AS s FROM lineitem", "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem", digits=2)
q("agg_avg", "SELECT AVG(l_quantity) AS a, AVG(l_linenumber) AS b FROM lineitem", "SELECT round(avg(l_quantity), 4) AS a, round(avg(l_linenumber), 4) AS b FROM lineitem")
q("agg_min_max", "SELECT MIN(o_totalprice) AS a, MAX(o_totalprice) AS b, MIN(o_orderdate) AS c, MAX(o_orderpriority) AS d FROM orders", "SELECT round(min(o_totalprice), 4) AS a, round(max(o_totalprice), 4) AS b, min(o_orderdate) AS c, max(o_orderpriority) AS d FROM orders")
q("agg_sum_distinct", "SELECT SUM(DISTINCT p_size) AS s, AVG(DISTINCT p_size) AS a FROM part", "SELECT sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 4) AS a FROM part")
q("agg_expr", "SELECT SUM(l_extendedprice) / COUNT(*) AS a, COUNT(*) + 1 AS n FROM lineitem", "SELECT round(sum(l_extendedprice) / count(*), 2) AS a, count(*) + 1 AS n FROM lineitem", digits=2)
q("agg_of_expression", "SELECT SUM(l_extendedprice * (1 - l_discount)) AS r FROM lineitem", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS r FROM lineitem", digits=2)
q("agg_empty", "SELECT COUNT(*) AS n, SUM(p_size) AS s, MAX(p_size) AS m FROM part WHERE p_size > 1000", "SELECT count(*) AS n, sum(p_size)::BIGINT AS s, max(p_size) AS m FROM part WHERE p_size > 1000")
q("agg_default_names", "SELECT COUNT(*), SUM(p_size) FROM part", "SELECT count(*) AS \"count(*)\", sum(p_size)::BIGINT AS \"sum(p_size)\" FROM part")
q("agg_no_group_key", "SELECT COUNT(*) AS n FROM orders:7", "SELECT count(*) AS n FROM orders WHERE o_orderkey = 7")
q("group_one", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
q("group_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_extendedprice) AS p, MIN(l_discount) AS d, MAX(l_tax) AS t FROM lineitem GROUP l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p, round(min(l_discount), 2) AS d, round(max(l_tax), 2) AS t FROM lineitem GROUP BY 1, 2", digits=2)
q("group_where", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem WHERE l_discount >= 0.05 GROUP l_returnflag ORDER qty DESC", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1", digits=2)
q("group_order_agg", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP o_custkey ORDER COUNT(*) DESC, o_custkey LIMIT 10", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
q("group_post_expr", "SELECT string::lower(o_orderpriority) AS p, SUM(o_totalprice) / COUNT(*) AS a, {n: COUNT(*)}.n AS n FROM orders GROUP o_orderpriority", "SELECT lower(o_orderpriority) AS p, round(sum(o_totalprice) / count(*), 2) AS a, count(*) AS n FROM orders GROUP BY o_orderpriority", digits=2)
q("group_null_key", "SELECT document.lang AS lang, COUNT(*) AS n FROM labels GROUP document.lang", "SELECT lang, count(*) AS n FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1")

# ---- sources

q("range_source", "SELECT VALUE $value * $value FROM 1..20", "SELECT i * i AS value FROM range(1, 21) t(i)")
q("range_empty", "SELECT VALUE $value FROM 5..2", "SELECT 1::BIGINT AS value WHERE false")
q("array_source", "SELECT a, b ?? 'none' AS b FROM [{a: 1, b: 'x'}, {a: 2}, {a: 3, b: ''}]", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, 'none'), (3, 'none')) t(a, b)")
q("array_group", "SELECT k, COUNT(*) AS n FROM [{k: 1}, {k: 2}, {k: 1}] GROUP k", "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT), (2, 1)) t(k, n)")
q("subquery_source", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP c_mktsegment) WHERE n > 10 ORDER n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 10")
q("nested_subquery", "SELECT COUNT(*) AS n, MAX(p) AS m FROM (SELECT o_totalprice AS p FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') WHERE p_ IS NONE AND o_totalprice > 1000)", "SELECT count(*) AS n, round(max(o_totalprice), 4) AS m FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
q("variable_source", "LET big = (SELECT * FROM orders WHERE o_totalprice > 200000); SELECT o_orderkey FROM $big WHERE o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
q("variable_scalar", "LET n = 3 + 2; SELECT n_name FROM nation WHERE n_nationkey < $n", "SELECT n_name FROM nation WHERE n_nationkey < 5")
q("field_path_source", "SELECT VALUE $value FROM embeddings:3.embedding[0..4]", "SELECT round(unnest(embedding[1:5])::DOUBLE, 4) AS value FROM embeddings WHERE vec_id = 3")
q("no_from", "SELECT 1 + 2 AS a, 'x' AS b, 7 / 2 AS c, 7.0 / 2 AS d", "SELECT 3::BIGINT AS a, 'x' AS b, 3::BIGINT AS c, 3.5::DOUBLE AS d")
q("batch_last", "LET a = 2; ; SELECT VALUE $value + $a FROM [1, 2, 3]", "SELECT * FROM (VALUES (3::BIGINT), (4), (5)) t(value)")
q("control_flow", "FOR $i IN 1..10 DO IF $i = 3 THEN CONTINUE END; IF $i > 5 THEN BREAK END; $i * $i END", "SELECT * FROM (VALUES (1::BIGINT), (4), (16), (25)) t(value)")

# ---- join-like constructs

q("deref_one", "SELECT c_custkey, nation.n_name AS nation FROM customer", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
q("deref_chain", "SELECT o_orderkey, customer.nation.region.r_name AS region FROM orders WHERE customer.c_mktsegment = 'BUILDING'", "SELECT o_orderkey, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'")
q("deref_group", "SELECT supplier.nation.n_name AS nation, SUM(l_extendedprice) AS v FROM lineitem GROUP supplier.nation.n_name", "SELECT n_name AS nation, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", digits=2)
q("fetch_one", "SELECT o_orderkey, customer FROM orders FETCH customer", "SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey", then=lambda d: d.select("o_orderkey", "customer.c_name", "customer.c_nationkey"))
q("fetch_nested", "SELECT s_suppkey, nation FROM supplier FETCH nation, nation.region", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", then=lambda d: d.select("s_suppkey", "nation.n_name", "nation.region.r_name"))
q("fetch_alias", "SELECT c_custkey, nation FROM customer FETCH nation AS home", "SELECT c_custkey, 'nation:' || c_nationkey AS nation, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", then=lambda d: d.select("c_custkey", "nation", "home.n_name"))
q("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
q("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT VALUE o_custkey FROM orders WHERE o_totalprice > 250000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
q("in_subquery_or", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
q("in_variable", "LET big = (SELECT VALUE o_custkey FROM orders WHERE o_totalprice > 250000); SELECT c_custkey FROM customer WHERE c_custkey IN $big", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
q("correlated_count", "SELECT c_custkey, (SELECT COUNT(*) AS n FROM orders WHERE o_custkey = $parent.c_custkey)[0].n AS n FROM customer", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
q("correlated_sum", "SELECT c_custkey, (SELECT VALUE SUM(o_totalprice) FROM orders WHERE o_custkey = $parent.c_custkey)[0] AS s FROM customer", "SELECT c_custkey, round((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 2) AS s FROM customer", digits=2)
q("correlated_filtered", "SELECT c_custkey, (SELECT COUNT(*) AS n FROM orders WHERE o_custkey = $parent.c_custkey AND o_totalprice > $parent.c_acctbal * 10)[0].n AS n FROM customer", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 10) AS n FROM customer")
q("correlated_top", "SELECT c_custkey, (SELECT VALUE o_orderkey FROM orders WHERE o_custkey = $parent.c_custkey ORDER o_totalprice DESC, o_orderkey LIMIT 1)[0] AS top FROM customer", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS top FROM customer")
q("correlated_array_len", "SELECT n_name, array::length((SELECT c_custkey FROM customer WHERE c_nationkey = $parent.n_nationkey)) AS n FROM nation", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
q("correlated_where", "SELECT n_name FROM nation WHERE (SELECT COUNT(*) AS n FROM supplier WHERE s_nationkey = $parent.n_nationkey)[0].n > 3", "SELECT n_name FROM nation WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) > 3")
q("nested_parent", "SELECT r_name, (SELECT VALUE SUM(n) FROM (SELECT n_nationkey, (SELECT COUNT(*) AS c FROM customer WHERE c_nationkey = $parent.n_nationkey AND c_custkey > $parent.parent.r_regionkey)[0].c AS n FROM nation WHERE n_regionkey = $parent.r_regionkey))[0] AS n FROM region", "SELECT r_name, (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_custkey > r_regionkey) AS n FROM region")
q("scalar_subquery_index", "SELECT n_name, (SELECT VALUE MAX(c_acctbal) FROM customer)[0] AS m FROM nation", "SELECT n_name, (SELECT round(max(c_acctbal), 4) FROM customer) AS m FROM nation")
q("parent_source", "SELECT vec_id, array::length((SELECT VALUE $value FROM $parent.embedding WHERE $value > 0)) AS n FROM embeddings", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings")

# ---- graph

_WALK = """
    WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + d) % 25 AS b FROM nation, (VALUES (1), (7)) t(d)),
    w AS (SELECT n_nationkey AS s, n_nationkey AS p, 0 AS d FROM nation UNION SELECT s, b, d + 1 FROM w JOIN e ON p = a WHERE d < {most}),
    v AS (SELECT s, p, min(d) AS d FROM w GROUP BY 1, 2)
"""
_LIST = lambda c: lambda d: d.select("id", F.explode(c).alias("x")).select(F.col("id").alias("s"), F.col("x.id").alias("t"))
q("hop_out", "SELECT VALUE ->placed->orders.{o_orderkey, o_totalprice} FROM customer", "SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", then=flat)
q("hop_in_count", "SELECT n_nationkey, array::length(<-lives_in) AS n FROM nation", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
q("hop_filtered", "SELECT o_orderkey, array::length(->(contains WHERE quantity > 40 AND discount < 0.05)) AS n FROM orders", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40 AND l_discount < 0.05) AS n FROM orders")
q("hop_two_dedup", "SELECT ->borders->nation->borders->nation AS x FROM nation", _WALK.format(most=2) + "SELECT 'nation:' || s AS s, 'nation:' || p AS t FROM v WHERE d = 2", then=_LIST("x"))
q("hop_range", "SELECT ->borders{1..3}->nation AS x FROM nation", _WALK.format(most=3) + "SELECT 'nation:' || s AS s, 'nation:' || p AS t FROM v WHERE d BETWEEN 1 AND 3", then=_LIST("x"))
q("hop_exact_depth", "SELECT ->borders{3}->nation AS x FROM nation", _WALK.format(most=3) + "SELECT 'nation:' || s AS s, 'nation:' || p AS t FROM v WHERE d = 3", then=_LIST("x"))
q("hop_open", "SELECT ->borders{..}->nation AS x FROM nation", _WALK.format(most=10) + "SELECT 'nation:' || s AS s, 'nation:' || p AS t FROM v WHERE d BETWEEN 1 AND 10", then=_LIST("x"))
q("hop_all_paths", "SELECT ->borders{1..3 ALL}->nation AS x FROM nation", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + d) % 25 AS b FROM nation, (VALUES (1), (7)) t(d)), w AS (SELECT n_nationkey AS s, n_nationkey AS p, 0 AS d FROM nation UNION ALL SELECT s, b, d + 1 FROM w JOIN e ON p = a WHERE d < 3) SELECT 'nation:' || s AS s, 'nation:' || p AS t FROM w WHERE d > 0", then=_LIST("x"))
q("hop_chain", "SELECT ->placed->orders->contains->part AS x FROM customer", "SELECT DISTINCT 'customer:' || o_custkey AS s, 'part:' || l_partkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey", then=_LIST("x"))
q("hop_collection_filter", "SELECT ->lives_in->nation->within->region.r_name AS x FROM customer", "SELECT 'customer:' || c_custkey AS s, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", then=lambda d: d.select(F.col("id").alias("s"), F.explode("x").alias("x")).select("s", "x.r_name"))
q("edge_fields", "SELECT ->contains.{quantity, cost: price} AS x FROM orders", "SELECT 'orders:' || l_orderkey AS s, l_quantity AS quantity, l_extendedprice AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey", then=lambda d: d.select(F.col("id").alias("s"), F.explode("x").alias("x")).select("s", "x.quantity", "x.cost"))
q("edge_fields_deref", "SELECT ->lives_in.{home: to.n_name} AS x FROM customer", "SELECT 'customer:' || c_custkey AS s, n_name AS home FROM customer JOIN nation ON c_nationkey = n_nationkey", then=lambda d: d.select(F.col("id").alias("s"), F.explode("x").alias("x")).select("s", "x.home"))
q("node_fields_deref", "SELECT VALUE ->lives_in->nation.{n_name, area: region.r_name} FROM customer", "SELECT n_name, r_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", then=flat)
q("hop_both", "SELECT <->borders->nation AS x FROM nation", "WITH e AS (SELECT n_nationkey AS a, (n_nationkey + d) % 25 AS b FROM nation, (VALUES (1), (7)) t(d)), p AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT 'nation:' || a AS s, 'nation:' || b AS t FROM p", then=_LIST("x"))
q("hop_count", "SELECT c_custkey, array::length(->placed) AS n FROM customer", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
q("hop_wildcard", "SELECT array::length(->*) AS n, n_name FROM nation", "SELECT 3::BIGINT AS n, n_name FROM nation")


@direct("list_out_page", "SELECT 'orders:' || o_orderkey AS \"to\" FROM orders WHERE o_custkey = 5 ORDER BY 1 LIMIT 5")
def list_out_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    return graph.list_edges(e.catalog.edges["placed"].df, "customer:5", limit=5).select("to")


@direct("hop_undirected", "WITH e AS (SELECT n_nationkey AS a, (n_nationkey + 3) % 25 AS b FROM nation), p AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT 'nation:' || a AS s, 'nation:' || b AS t FROM p")
def hop_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation and the third after it, as an undirected kind of edge."""
    e = open_tables(spark, sf_dir)
    name = lambda k: F.concat(F.lit("nation:"), k.cast("string"))
    pairs = read(spark, sf_dir, "nation").select(F.concat(F.lit("pal:"), F.col("n_nationkey").cast("string")).alias("id"), name(F.col("n_nationkey")).alias("from"), name((F.col("n_nationkey") + 3) % 25).alias("to"))
    e.catalog.put_edges("pal", pairs, directed=False)
    return _LIST("x")(e.query("SELECT ->pal->nation AS x FROM nation"))


# ---- search

_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def bm25_sql(terms: list[str], select: str = "doc_id, round(s, 4) AS score", where: str = "s > 0", tail: str = "") -> str:
    tfs = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(terms)))
    s = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(terms)))
    return f"""
        WITH a AS (SELECT *, {_TERMS} AS t FROM documents), b AS (SELECT * EXCLUDE (t), len(t) AS len, {tfs} FROM a),
        c AS (SELECT count(*) AS n, avg(len) AS avg, {dfs} FROM b), r AS (SELECT b.*, {s} AS s FROM b, c)
        SELECT {select} FROM r WHERE {where} {tail}
    """


q("fts_term", "SELECT doc_id, fts::score() AS score FROM documents WHERE text @@ 'stupid'", bm25_sql(["stupid"]))
q("fts_multi_term", "SELECT doc_id, fts::score() AS score FROM documents WHERE text @@ 'idiot stupid trash'", bm25_sql(["idiot", "stupid", "trash"]))
q("fts_filter", "SELECT doc_id, fts::score() AS score FROM documents WHERE text @@ 'la les' AND lang = 'fr' AND n_chars < 3000", bm25_sql(["la", "les"], where="s > 0 AND lang = 'fr' AND n_chars < 3000"))
q("fts_required", "SELECT doc_id FROM documents WHERE text @@ '+the -and'", f"SELECT doc_id FROM documents WHERE list_contains({_TERMS}, 'the') AND NOT list_contains({_TERMS}, 'and')")
q("fts_boolean", "SELECT doc_id FROM documents WHERE text @@ 'idiot AND trash'", f"SELECT doc_id FROM documents WHERE list_contains({_TERMS}, 'idiot') AND list_contains({_TERMS}, 'trash')")
q("fts_phrase", "SELECT doc_id FROM documents WHERE text @@ '\"of the\"'", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TERMS}, ' ') || ' ', ' of the ')")
q("fts_top_k", "SELECT doc_id, fts::score() AS score FROM documents WHERE text @@ 'idiot stupid trash' ORDER fts::score() DESC, doc_id LIMIT 10", bm25_sql(["idiot", "stupid", "trash"], tail="ORDER BY s DESC, doc_id LIMIT 10"))
q("fts_match_boost", "SELECT p_partkey, fts::score() AS score FROM part WHERE MATCH(p_name^2, p_type) @@ 'small'", """
    WITH a AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS x, regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+') AS y FROM part),
    b AS (SELECT p_partkey, len(x) AS lx, len(y) AS ly, len(list_filter(x, lambda w: w = 'small')) AS fx, len(list_filter(y, lambda w: w = 'small')) AS fy FROM a),
    c AS (SELECT count(*) AS n, avg(lx) AS ax, avg(ly) AS ay, sum((fx > 0)::INT) AS dx, sum((fy > 0)::INT) AS dy FROM b)
    SELECT p_partkey, round(2 * ln(1 + (n - dx + 0.5) / (dx + 0.5)) * fx * 2.2 / (fx + 1.2 * (0.25 + 0.75 * lx / ax)) + ln(1 + (n - dy + 0.5) / (dy + 0.5)) * fy * 2.2 / (fy + 1.2 * (0.25 + 0.75 * ly / ay)), 4) AS score
    FROM b, c WHERE fx > 0 OR fy > 0
""")  # fmt: skip


def _tokens(name: str, analyzer: Analyzer, sql: str) -> None:
    @direct(name, f"WITH t AS (SELECT doc_id, unnest({sql}) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.term_counts(read(spark, sf_dir, "documents"), "doc_id", "text", analyzer)


_tokens("tokenizer_standard", Analyzer(), _TERMS)
_tokens("tokenizer_whitespace", Analyzer(("whitespace",), ()), "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')")
_tokens("tokenizer_pattern", Analyzer(("pattern", "[,.]"), (("lowercase",), ("length", 3, 40))), "list_filter(regexp_split_to_array(lower(text), '[,.]'), lambda x: length(x) BETWEEN 3 AND 40)")


_NGRAMS = "flatten([list_transform(range(1, length(text) - k + 2), lambda i: substr(text, i, k)) FOR k IN [2, 3]])"
_tokens("tokenizer_ngram", Analyzer(("ngram", 2, 3), ()), _NGRAMS)


_QV = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_DOT = f"list_inner_product(embedding::DOUBLE[], {_QV}::DOUBLE[])"
for _name, _metric, _d in (("knn_cosine", "COSINE", f"1 - list_cosine_similarity(embedding::DOUBLE[], {_QV}::DOUBLE[])"), ("knn_l2sq", "EUCLIDEAN", f"list_distance(embedding::DOUBLE[], {_QV}::DOUBLE[]) ^ 2"), ("knn_dot", "DOT", f"1 - {_DOT}")):
    q(_name, "SELECT vec_id, vector::distance() AS d FROM embeddings WHERE embedding <|10|> (SELECT VALUE embedding FROM embeddings:7)", f"SELECT vec_id, round({_d}, 4) + 0.0 AS d FROM embeddings ORDER BY {_d}, 'embeddings:' || vec_id LIMIT 10", metric=_metric, then=lambda d: d.withColumn("d", F.round("d", 4) + 0.0))
q("knn_postfilter", "SELECT vec_id FROM embeddings WHERE embedding <|25, 100|> (SELECT VALUE embedding FROM embeddings:7) AND label < 5", f"SELECT vec_id FROM (SELECT * FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_QV}::DOUBLE[]), 'embeddings:' || vec_id LIMIT 25) WHERE label < 5")


def _rrf_sql(k: int, limit: int) -> str:
    a = bm25_sql(["idiot", "stupid"], "doc_id, row_number() OVER (ORDER BY s DESC, 'documents:' || doc_id) AS r")
    b = bm25_sql(["trash", "idiot"], "doc_id, row_number() OVER (ORDER BY s DESC, 'documents:' || doc_id) AS r")
    return f"WITH u AS (SELECT * FROM ({a}) WHERE r <= 30 UNION ALL SELECT * FROM ({b}) WHERE r <= 30), f AS (SELECT doc_id, sum(1.0 / ({k} + r))::DOUBLE AS s FROM u GROUP BY 1) SELECT doc_id, round(s, 6) AS score FROM f ORDER BY s DESC, 'documents:' || doc_id LIMIT {limit}"


_LISTS = "LET a = (SELECT doc_id FROM documents WHERE text @@ 'idiot stupid' LIMIT 30); LET b = (SELECT doc_id FROM documents WHERE text @@ 'trash idiot' LIMIT 30);"
q("rrf_hybrid", f"{_LISTS} SELECT doc_id, _rrf_score AS score FROM search::rrf([$a, $b], 15)", _rrf_sql(60, 15), digits=6)
q("rrf_custom_k", f"{_LISTS} SELECT doc_id, _rrf_score AS score FROM search::rrf([$a, $b], 8, 10)", _rrf_sql(10, 8), digits=6)

# ---- functions

_FN = {
    "math_abs": ("customer", "c_custkey", "math::abs(c_acctbal)", "abs(c_acctbal)"),
    "math_round": ("customer", "c_custkey", "math::round(c_acctbal)", "round(c_acctbal)::BIGINT"),
    "math_floor": ("customer", "c_custkey", "math::floor(c_acctbal)", "floor(c_acctbal)::BIGINT"),
    "math_ceil": ("customer", "c_custkey", "math::ceil(c_acctbal)", "ceil(c_acctbal)::BIGINT"),
    "math_trunc": ("customer", "c_custkey", "math::trunc(c_acctbal)", "trunc(c_acctbal)::BIGINT"),
    "math_sign": ("customer", "c_custkey", "math::sign(c_acctbal)", "sign(c_acctbal)::BIGINT"),
    "math_sqrt": ("part", "p_partkey", "math::sqrt(p_size)", "sqrt(p_size)"),
    "math_pow": ("part", "p_partkey", "math::pow(p_size, 2)", "pow(p_size, 2)"),
    "math_exp": ("nation", "n_nationkey", "math::exp(n_nationkey / 10.0)", "exp(n_nationkey / 10.0)"),
    "math_log": ("part", "p_partkey", "math::log(p_size, 2)", "ln(p_size) / ln(2)"),
    "math_modulo": ("orders", "o_orderkey", "math::modulo(0 - o_orderkey, 7)", "((0 - o_orderkey) % 7)"),
    "math_min": ("customer", "c_custkey", "math::min(c_custkey, c_nationkey * 10)", "least(c_custkey, c_nationkey * 10)::BIGINT"),
    "math_max": ("customer", "c_custkey", "math::max(c_custkey, c_acctbal)", "greatest(c_custkey::DOUBLE, c_acctbal)"),
    "math_sin": ("nation", "n_nationkey", "math::sin(n_nationkey)", "sin(n_nationkey)"),
    "math_cos": ("nation", "n_nationkey", "math::cos(n_nationkey)", "cos(n_nationkey)"),
    "math_tan": ("nation", "n_nationkey", "math::tan(n_nationkey)", "tan(n_nationkey)"),
    "string_upper": ("customer", "c_custkey", "string::upper(c_name)", "upper(c_name)"),
    "string_lower": ("customer", "c_custkey", "string::lower(c_name)", "lower(c_name)"),
    "string_length": ("documents", "doc_id", "string::length(text)", "length(text)"),
    "string_trim": ("nation", "n_nationkey", "string::trim('  \\t' + n_name + '\\n ')", "n_name"),
    "string_replace": ("nation", "n_nationkey", "string::replace(n_name, 'A', '..')", "replace(n_name, 'A', '..')"),
    "string_split": ("customer", "c_custkey", "string::split(c_name, '#')[1]", "string_split(c_name, '#')[2]"),
    "string_starts_with": ("nation", "n_nationkey", "string::starts_with(n_name, 'A')", "starts_with(n_name, 'A')"),
    "string_ends_with": ("nation", "n_nationkey", "string::ends_with(n_name, 'A')", "ends_with(n_name, 'A')"),
    "string_matches": ("part", "p_partkey", "string::matches(p_type, '^[A-Z]+ .*L$')", "regexp_matches(p_type, '^[A-Z]+ .*L$')"),
    "string_concat": ("nation", "n_nationkey", "string::concat(n_name, null, '-', n_regionkey)", "n_name || '-' || n_regionkey"),
    "string_substring": ("customer", "c_custkey", "string::substring(c_name, 2, 5)", "substr(c_name, 3, 5)"),
    "array_length": ("embeddings", "vec_id", "array::length(embedding)", "len(embedding)"),
    "array_contains": ("nation", "n_nationkey", "array::contains([1, 4.0, 9], n_nationkey)", "n_nationkey IN (1, 4, 9)"),
    "array_append": ("nation", "n_nationkey", "array::append([1], n_nationkey)[1]", "n_nationkey::BIGINT"),
    "array_reverse": ("nation", "n_nationkey", "array::reverse([n_nationkey, 1, 2])[2]", "n_nationkey::BIGINT"),
    "array_flatten": ("nation", "n_nationkey", "array::length(array::flatten([[n_nationkey, 1], [2]]))", "3::BIGINT"),
    "array_distinct": ("nation", "n_nationkey", "array::length(array::distinct([n_nationkey, 3, 3]))", "CASE WHEN n_nationkey = 3 THEN 1 ELSE 2 END::BIGINT"),
    "type_to_int": ("nation", "n_nationkey", "type::to_int(string::concat(' ', n_nationkey, ' '))", "n_nationkey::BIGINT"),
    "type_to_float": ("nation", "n_nationkey", "type::to_float(string::concat(n_nationkey, '.5'))", "n_nationkey + 0.5::DOUBLE"),
    "type_to_decimal": ("nation", "n_nationkey", "type::to_decimal(n_nationkey) + 0.25dec", "(n_nationkey + 0.25)::DOUBLE"),
    "type_to_string": ("nation", "n_nationkey", "type::to_string(n_regionkey) + type::to_string(null)", "n_regionkey || 'null'"),
    "type_to_bool": ("labels", "doc_id", "type::to_bool(toxic)", "toxic <> 0"),
    "type_is_null": ("documents", "doc_id", "type::is_null(lang)", "lang IS NULL"),
    "type_is_int": ("nation", "n_nationkey", "type::is_int(n_nationkey)", "true"),
    "type_is_float": ("nation", "n_nationkey", "type::is_float(n_nationkey)", "false"),
    "type_is_number": ("customer", "c_custkey", "type::is_number(c_acctbal)", "true"),
    "type_is_string": ("nation", "n_nationkey", "type::is_string(n_name)", "true"),
    "type_is_bool": ("nation", "n_nationkey", "type::is_bool(n_nationkey > 3)", "true"),
    "type_is_array": ("embeddings", "vec_id", "type::is_array(embedding)", "true"),
    "type_is_object": ("nation", "n_nationkey", "type::is_object({a: n_name})", "true"),
    "type_is_reference": ("customer", "c_custkey", "type::is_reference(nation)", "true"),
    "type_ref": ("nation", "n_nationkey", "type::ref(n_name) ?? type::ref(string::concat('nation:', n_nationkey))", "'nation:' || n_nationkey"),
    "type_of": ("customer", "c_custkey", "type::of(c_acctbal) + type::of(c_name) + type::of(nation)", "'floatstringreference'"),
    "type_default": ("labels", "doc_id", "type::default(document.nothing, toxic)", "toxic::BIGINT"),
    "type_coalesce": ("labels", "doc_id", "type::coalesce(null, toxic, quality)", "toxic::BIGINT"),
    "time_year": ("orders", "o_orderkey", "time::year(o_orderdate)", "year(o_orderdate)"),
    "time_month": ("orders", "o_orderkey", "time::month(o_orderdate)", "month(o_orderdate)"),
    "time_day": ("orders", "o_orderkey", "time::day(o_orderdate)", "day(o_orderdate)"),
    "time_hour": ("events", "event_id", "time::hour(ts)", "hour(ts)"),
    "time_minute": ("events", "event_id", "time::minute(ts)", "minute(ts)"),
    "time_second": ("events", "event_id", "time::second(ts)", "second(ts)"),
    "time_now": ("nation", "n_nationkey", "time::now() > d'2020-01-01'", "true"),
    "duration_from_secs": ("nation", "n_nationkey", "duration::millis(duration::from_secs(n_nationkey))", "n_nationkey::BIGINT * 1000"),
    "duration_from_millis": ("nation", "n_nationkey", "duration::millis(duration::from_millis(n_nationkey) + 1h)", "n_nationkey::BIGINT + 3600000"),
    "duration_secs": ("nation", "n_nationkey", "duration::secs(1h30m) + n_nationkey", "n_nationkey::BIGINT + 5400"),
    "duration_millis": ("nation", "n_nationkey", "duration::millis(1500ms) + n_nationkey", "n_nationkey::BIGINT + 1500"),
    "bytes_len": ("nation", "n_nationkey", "bytes::len(0xCAFE) + n_nationkey", "n_nationkey::BIGINT + 2"),
    "bytes_base64_encode": ("nation", "n_nationkey", "bytes::base64_encode(b'SGVsbG8=') + n_name", "'SGVsbG8=' || n_name"),
    "bytes_base64_decode": ("nation", "n_nationkey", "bytes::len(bytes::base64_decode('SGVsbG8='))", "5::BIGINT"),
    "fts_highlight": ("nation", "n_nationkey", "fts::highlight(string::concat('see ', n_name), 'SEE')", "'<b>see</b> ' || n_name"),
    "fts_hybrid_score": ("nation", "n_nationkey", "fts::hybrid_score() IS NULL", "true"),
}
for _name, (_t, _k, _e, _s) in _FN.items():
    _real = _name in ("math_abs", "math_sqrt", "math_pow", "math_exp", "math_log", "math_max", "math_sin", "math_cos", "math_tan", "type_to_float", "type_to_decimal")
    q("fn_" + _name, f"SELECT {_k}, {_e} AS v FROM {_t}", f"SELECT {_k}, {f'round({_s}, 4)' if _real else _s} AS v FROM {_t}")

# ---- writing, as table transformations


@direct("relate_cartesian", "SELECT 'region:' || r_regionkey AS \"from\", 'nation:' || n_nationkey AS \"to\", 1.5::DOUBLE AS weight FROM region, nation WHERE n_nationkey < 5")
def relate_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.query("RELATE (SELECT * FROM region)->near->(SELECT * FROM nation WHERE n_nationkey < 5) SET weight = 1.5")
    return e.catalog.edges["near"].df.select("from", "to", "weight")


@direct("relate_cartesian_all", "SELECT 'region:' || r_regionkey AS \"from\", 'nation:' || n_nationkey AS \"to\", 1.5::DOUBLE AS weight FROM region, nation")
def relate_cartesian_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.query("RELATE (SELECT * FROM region)->near->(SELECT * FROM nation) SET weight = 1.5")
    return e.catalog.edges["near"].df.select("from", "to", "weight")


@direct("update_where", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey * 2 END::BIGINT AS twice FROM nation")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.execute("UPDATE nation SET n_name = n_name + '!', extra.twice = n_nationkey * 2 WHERE n_regionkey = 1")
    return e.query("SELECT n_nationkey, n_name, extra.twice AS twice FROM nation").drop("id")


@direct("upsert_merge", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'THREE' ELSE n_name END AS n_name FROM nation UNION ALL SELECT NULL, 'NEW'")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.execute("UPSERT nation:3 SET n_name = 'THREE'; UPSERT nation:77 SET n_name = 'NEW'")
    return e.query("SELECT n_nationkey, n_name FROM nation").drop("id")


@direct("upsert_table", "SELECT c_custkey, c_acctbal + CASE WHEN c_nationkey = 1 THEN 1 ELSE 0 END AS c_acctbal FROM customer")
def upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    new = c.where("c_nationkey = 1").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return dml.merged(c.drop("c_nationkey"), new, "c_custkey")


@direct("insert_rows", "SELECT n_name FROM nation UNION ALL SELECT * FROM (VALUES ('X'), ('Y')) t(n_name)")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.execute("INSERT INTO nation {id: 'x', n_name: 'X', n_nationkey: 90}, {n_name: 'Y', odd: [1, 2]}")
    return e.query("SELECT VALUE n_name FROM nation").toDF("n_name")


@direct("create_one", "SELECT count(*) + 1 AS n FROM region")
def create_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.execute("CREATE region:new SET r_name = string::upper('new'), size = (SELECT VALUE COUNT(*) FROM nation)[0]")
    return e.query("SELECT COUNT(*) AS n FROM region")


@direct("delete_where", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.execute("DELETE nation WHERE n_regionkey = 2")
    return e.query("SELECT n_nationkey FROM nation").drop("id")


@direct("delete_cascade", "SELECT count(*) AS n FROM customer WHERE c_nationkey <> 4")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    return graph.without_nodes(e.catalog.edges["lives_in"].df, e.query("SELECT * FROM nation:4")).agg(F.count(F.lit(1)).alias("n"))


@direct("delete_edge", "SELECT count(*) AS n FROM orders WHERE o_custkey <> 5")
def delete_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.execute("DELETE customer:5->placed")
    return e.catalog.edges["placed"].df.agg(F.count(F.lit(1)).alias("n"))


@direct("transaction_rollback", "SELECT count(*) AS n FROM region")
def transaction_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = open_tables(spark, sf_dir)
    e.execute("BEGIN; DELETE region WHERE r_regionkey > 1; ROLLBACK")
    return e.query("SELECT COUNT(*) AS n FROM region")


@direct("transaction_commit", "SELECT n_regionkey AS region, count(*) AS n, 0::BIGINT AS seen FROM nation WHERE n_regionkey > 1 GROUP BY 1")
def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes are seen by others from COMMIT on, not before."""
    e = open_tables(spark, sf_dir)
    e.execute("BEGIN; DELETE nation WHERE n_regionkey <= 1")
    seen = Engine(spark, e._before).query("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey > 4").select(F.col("n").alias("seen"))
    e.execute("COMMIT")
    return e.query("SELECT n_regionkey AS region, COUNT(*) AS n FROM nation GROUP n_regionkey").crossJoin(F.broadcast(seen)).select("region", "n", "seen")


# ---- the flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over documents, fused and joined with what their labels say."""
    return tidy(open_tables(spark, sf_dir).query(f"""{_LISTS}
        SELECT doc_id, _rrf_score AS score, (SELECT VALUE quality FROM labels WHERE doc_id = $parent.doc_id)[0] AS quality
        FROM search::rrf([$a, $b], 15)"""), 6)


_QUERIES["flagship"] = flagship
_SQL["flagship"] = f"SELECT f.*, quality FROM ({_rrf_sql(60, 15)}) f LEFT JOIN labels USING (doc_id)"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
