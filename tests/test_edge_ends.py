"""Fields fetched over edges that also point at many collections the catalog doesn't know."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from facet.plans.planner import Planner


def test_known_collections_are_found_among_many_unlisted(spark):
    ends = [f"unknown{i}:1" for i in range(500)] + ["nation:3", "region:1", None]
    found = spark.createDataFrame([(e,) for e in ends], "end string").select(F.struct(F.col("end").alias("to")).alias("edge"))
    known = frozenset({"nation", "region", "part"})
    assert Planner._ends(SimpleNamespace(), found, "to", known) == {"nation", "region"}
    assert Planner._ends(SimpleNamespace(), found.limit(0), "to", known) == known
