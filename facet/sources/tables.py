"""Parquet tables as a catalog: collections with ids and references, and the edges between them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Index, keyed
from ..engine import Engine

_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
_REFS = {
    "nation": {"region": ("region", "n_regionkey")},
    "customer": {"nation": ("nation", "c_nationkey")},
    "supplier": {"nation": ("nation", "s_nationkey")},
    "orders": {"customer": ("customer", "o_custkey")},
    "lineitem": {"order": ("orders", "l_orderkey"), "part": ("part", "l_partkey"), "supplier": ("supplier", "l_suppkey")},
    "labels": {"document": ("documents", "doc_id")},
}
_INDEXES = {
    "documents": [Index("text_fts", ("text",), "fulltext"), Index("idx_documents_text_source", ("source", "text"), "fulltext")],
    "part": [Index("p_name_fts", ("p_name", "p_type"), "fulltext")],
    "embeddings": [Index("idx_embeddings_cosine", ("embedding",), "hnsw", (("dimension", 64), ("metric", "COSINE")))],
}


def ref(collection: str, key: str):
    return F.concat(F.lit(collection + ":"), F.col(key).cast("string"))


def collection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as documents: ``id`` and a column for each reference, computed in the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "lineitem":  # line numbers repeat within an order
        df = keyed(df.withColumn("__row", F.hex(F.xxhash64(*df.columns))), name, *_KEYS[name], "__row").drop("__row")
    else:
        df = keyed(df, name, *_KEYS[name])
    for column, (to, key) in _REFS.get(name, {}).items():
        df = df.withColumn(column, ref(to, key))
    return df


def _placed(read):
    return read("orders").select(ref("placed", "o_orderkey").alias("id"), ref("customer", "o_custkey").alias("from"), ref("orders", "o_orderkey").alias("to"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"))


def _contains(read):
    lines = read("lineitem")
    key = F.concat_ws("-", ref("contains", "l_orderkey"), F.col("l_linenumber").cast("string"), F.hex(F.xxhash64(*lines.columns)))  # line numbers repeat within an order
    props = [F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")]
    return lines.select(key.alias("id"), ref("orders", "l_orderkey").alias("from"), ref("part", "l_partkey").alias("to"), *props)


def _supplied_by(read):
    pairs = read("lineitem").select(ref("part", "l_partkey").alias("from"), ref("supplier", "l_suppkey").alias("to")).distinct()
    return pairs.select(F.concat(F.lit("supplied_by:"), F.col("from"), F.lit("/"), F.col("to")).alias("id"), "from", "to")


def _lives_in(read):
    return read("customer").select(ref("lives_in", "c_custkey").alias("id"), ref("customer", "c_custkey").alias("from"), ref("nation", "c_nationkey").alias("to"))


def _within(read):
    return read("nation").select(ref("within", "n_nationkey").alias("id"), ref("nation", "n_nationkey").alias("from"), ref("region", "n_regionkey").alias("to"))


def _borders(read):
    """A ring with chords over the nations: paths with cycles."""
    n = read("nation").select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(7))).alias("d"))
    return n.select(F.concat_ws("-", ref("borders", "n_nationkey"), F.col("d").cast("string")).alias("id"), ref("nation", "n_nationkey").alias("from"), F.concat(F.lit("nation:"), ((F.col("n_nationkey") + F.col("d")) % 25).cast("string")).alias("to"), F.col("d").alias("weight"))


#: The collections of both ends of each kind of edge.
_ENDS = {"placed": ("customer", "orders"), "contains": ("orders", "part"), "supplied_by": ("part", "supplier"), "lives_in": ("customer", "nation"), "within": ("nation", "region"), "borders": ("nation", "nation")}
_EDGES = {"placed": _placed, "contains": _contains, "supplied_by": _supplied_by, "lives_in": _lives_in, "within": _within, "borders": _borders}


def open_tables(spark: SparkSession, sf_dir: str, metric: str = "COSINE") -> Engine:
    """An engine over all tables of a folder; nothing is read before a query runs."""
    c = Catalog(spark)
    for name in _KEYS:
        indexes = _INDEXES.get(name)
        if name == "embeddings":
            indexes = [Index("idx_embeddings", ("embedding",), "hnsw", (("dimension", 64), ("metric", metric)))]
        c.put(name, partial(collection, spark, sf_dir, name), {k: to for k, (to, _) in _REFS.get(name, {}).items()}, indexes, key=_KEYS[name][0] if len(_KEYS[name]) == 1 else None)
    for label, make in _EDGES.items():
        c.put_edges(label, partial(make, lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")), single=label != "contains", ends=tuple(frozenset([x]) for x in _ENDS[label]))
    return Engine(spark, c)


def backup(engine: Engine, folder: str) -> None:
    """Write every collection and edge table as Parquet, side by side."""
    for name, c in engine.catalog.collections.items():
        c.df.write.mode("overwrite").parquet(f"{folder}/collections/{name}")
    for name, e in engine.catalog.edges.items():
        e.df.write.mode("overwrite").parquet(f"{folder}/edges/{name}")


def restore(engine: Engine, folder: str, collections: list[str], edges: list[str] | None = None) -> None:
    """Put what ``backup`` wrote in the place of the tables named."""
    for name in collections:
        df = engine.spark.read.parquet(f"{folder}/collections/{name}")
        if name in engine.catalog.collections:
            engine.catalog.change(name, df=df)
        else:
            engine.catalog.put(name, df)
    for name in edges or []:
        engine.catalog.put_edges(name, engine.spark.read.parquet(f"{folder}/edges/{name}"))
