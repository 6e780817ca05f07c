"""What a traversal moves, and the edges that it gives, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from facet.operators import graph
from facet.plans import catalogue


@pytest.fixture
def plain_joins(spark):
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_edges_are_shuffled_once_and_without_unused_columns(spark, plain_joins):
    plan = catalogue.queries()["edge_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert sum("Exchange hashpartitioning" in x for x in lines) == 3  # orders as starts and as rows, lineitem
    assert sum("SortMergeJoin" in x for x in lines) == 2 and "LeftAnti" not in plan
    moved = next(lines[i + 1] for i, x in enumerate(lines) if "Exchange" in x and "__node" in x)
    assert "l_extendedprice" in moved.split("xxhash64")[-1] and "struct" not in moved and " AS __e5" not in moved


@pytest.mark.parametrize("direction", ["->", "<-", "<->"])
@pytest.mark.parametrize("fields", [None, ["w"], ["from", "to"], []])
def test_edges_come_out_once_for_each_start(spark, direction, fields):
    rng = random.Random(3)
    rows = [(f"e{i}", f"n:{rng.randrange(12)}", f"n:{rng.randrange(12)}", i % 5, None) for i in range(60)]
    rows += [rows[0], rows[7], ("n:3", "n:3", "n:4", 1, "x"), ("n:4", "n:3", "n:4", 2, "y"), ("e99", "n:5", "n:5", 3, "z"), ("e98", None, "n:5", 3, "z")]
    edges = spark.createDataFrame(rows, "id string, from string, to string, w int, note string")
    starts = spark.createDataFrame([(f"n:{i}",) for i in range(15)] + [("n:3",)], "start string")
    found = graph.traverse(starts, [graph.Step(edges, direction)], by_edge=True, fields=fields)
    kept = [c for c in edges.columns if fields is None or c in {"id", *fields}]
    assert found.schema["edge"].dataType.names == kept
    got = sorted([(r["start"], r["edge_id"], *r["edge"]) for r in found.collect()], key=repr)
    want = set()
    for e in rows:
        by = dict(zip(edges.columns, e))
        for s in {"->": {by["from"]}, "<-": {by["to"]}, "<->": {by["from"], by["to"]}}[direction] - {by["id"], None}:
            want.add((s, by["id"], *[by[c] for c in kept]))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("everything", [False, True])
def test_later_hops_keep_edges_and_fields(spark, everything):
    rows = [("e1", "n:a", "n:b", 1), ("e2", "n:b", "n:c", 2), ("e3", "n:b", "n:a", 3), ("e4", "n:a", "n:c", 4), ("e5", "n:c", "n:d", 5)]
    edges = spark.createDataFrame(rows, "id string, from string, to string, w int")
    starts = spark.createDataFrame([("n:a",)], "start string")
    step = graph.Step(edges, "->", 1, 2, everything)
    got = sorted((r["depth"], r["edge_id"], r["edge"]["w"]) for r in graph.traverse(starts, [step], by_edge=True, fields=["w"]).collect())
    assert got == [(1, "e1", 1), (1, "e4", 4), (2, "e2", 2), (2, "e3", 3), (2, "e5", 5)]
    (edge,) = graph.traverse(starts, [graph.Step(edges, "->", 2, 2)], by_edge=True).where(F.col("edge_id") == "e5").collect()
    assert tuple(edge["edge"]) == ("e5", "n:c", "n:d", 5) and edge["node"] == "n:d"
