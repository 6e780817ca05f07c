"""Exact dedup by deterministic block naming.

Each text (after each run of white space is replaced by one space) is cut into blocks of a fixed
number of bytes.  Equal blocks get one integer name, different blocks different names: distinct
blocks are sorted within buckets of their hash and numbered in that order.  Then, level by level,
adjacent names of a document are paired and the distinct pairs are sorted and named the same way,
until each document has a single name.  Documents with the same (level, name) have equal texts;
no two different texts can share one, because every name stands for exactly one sequence of bytes.

Blocks travel by their 64-bit hash.  That a hash stands for one block only is verified on the
blocks' bytes, and the blocks of a hash that does not are told apart by those bytes.

Defined results: a null text counts as empty and equals the empty text; rows may repeat a doc_id
(of equal texts one row stays: smallest doc_id, null last, then any one of the repeated rows); an
empty table gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, attach_group, durable, salted

BLOCK_BYTES = 8192
_BUCKETS = 1024  # sort buckets a level; a name is bucket * 2**40 + rank in the bucket


def _named(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """``occurrences`` with ``name``, one integer for each distinct ``keys``."""
    d = salted(occurrences, [F.col("rid"), F.col("pos")])
    p = d.select(*keys, "_salt").distinct()
    t = p.select(*keys).distinct().withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(*keys))
    t = t.select(*keys, (F.col("_b") * F.lit(1 << 40) + rank).alias("name"))
    return d.join(p.join(t, keys), [*keys, "_salt"]).drop("_salt", *keys)


def name_documents(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, hash_bits: int = 64) -> DataFrame:
    """Rows (rid, id, text_sha256, level, name).  hash_bits < 64 weakens the block hash, for tests."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE + "+", " ")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), norm.cast("binary").alias("b"))
    count = F.greatest(F.lit(1), F.ceil(F.length("b") / F.lit(block_bytes)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = rows.select("rid", "id", count.alias("n"), F.sha2("b", 256).alias("sha"), cut.alias("blocks"))
    h = F.xxhash64("block")
    if hash_bits < 64:
        h = F.pmod(h, F.lit(1 << hash_bits))
    blocks = rows.select("rid", "id", "n", "sha", F.posexplode("blocks").alias("pos", "block")).withColumn("h", h)
    first = F.col("pos") == 0
    occ = durable(blocks.select("rid", "pos", "h", "n", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha")))

    # One shuffle of the blocks' bytes, combined on the map side: does each hash stand for one block?
    mixed = durable(blocks.groupBy("h").agg(F.min("block").alias("a"), F.max("block").alias("z")).where("a <> z").select("h"))
    keyed = occ.withColumn("variant", F.lit(0))
    if mixed.limit(1).count():
        told = blocks.join(mixed, "h", "left_semi").select("rid", "pos", "h", "block")
        ranks = told.select("h", "block").distinct().withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        told = durable(told.join(ranks, ["h", "block"]).select("rid", "pos", "variant"))
        keyed = occ.join(told, ["rid", "pos"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))

    most = occ.agg(F.max("n")).first()[0] or 0
    heads = occ.where("pos = 0").select("rid", "id", "sha")
    names = durable(_named(keyed.select("rid", "pos", "n", "h", "variant"), ["h", "variant"]))
    done = [names.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    level = 0
    while most > 1:
        level += 1
        most = (most + 1) // 2
        even = F.pmod(F.col("pos"), F.lit(2)) == 0
        pairs = names.where("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.floor((F.first("n") + 1) / 2).cast("int").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = durable(_named(durable(pairs), ["left", "right"]))
        done.append(names.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return heads.join(found, "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row a document: id_col, keep_id, group_size, kept, text_sha256."""
    named = durable(name_documents(docs, id_col, text_col, block_bytes, hash_bits))
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))
    out = attach_group(
        named, ["level", "name"], ["rid"],
        [F.min(best).alias("best"), F.count(F.lit(1)).alias("n")],
        [F.min("best").alias("best"), F.sum("n").alias("group_size")],
    )
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
