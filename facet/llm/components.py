"""Connected components of a link table, on the cluster, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links: columns a, b of any orderable type.  Returns (node, root) for each linked node but the roots,
    ``root`` being the least node reachable.

    Both steps keep a table of links no larger than the given one; per node they need only a minimum,
    which is combined on the map side.  The table is checkpointed each round.
    """
    up = lambda d: d.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = durable(up(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    mark = None
    if not e.limit(1).count():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = durable(up(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u")
        e = durable(up(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))))
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row == mark:
            break
        mark = row
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
