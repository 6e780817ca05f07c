"""Pieces shared by the training-data operators: durable cuts, and skew-safe grouping and ranking.

Hot groups (one key may hold a third of all rows) are never gathered in one task: rows are salted
by a hash of their own id, each (key, salt) is pre-aggregated, and only the per-salt summaries, of
which a key has at most ``SALTS``, are combined per key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..catalog import settled

SALTS = 64
#: A regular-expression class of the white space that separates words (Java and RE2 agree on it).
SPACE = r"[\x20\x09-\x0D]"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the folder all executors share."""
    return settled(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted(df: DataFrame, by: Sequence[Column], salts: int = SALTS) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))


def attach_group(df: DataFrame, keys: list[str], by: list[str], partial: list[Column], final: list[Column]) -> DataFrame:
    """Rows of ``df`` with the aggregates ``final`` of their group, whatever the group's size.

    ``partial`` aggregates rows to one row a (key, salt); ``final`` aggregates those to one a key.
    Keys must not be null.  ``df`` is read twice and should be cheap to read again.
    """
    d = salted(df, [F.col(c) for c in by])
    p = d.groupBy(*keys, "_salt").agg(*partial)
    t = p.groupBy(*keys).agg(*final)
    return d.join(p.select(*keys, "_salt").join(t, keys), [*keys, "_salt"]).drop("_salt")


def salted_join(df: DataFrame, side: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``df`` joined with ``side``, which has one row for each key; a key may hold any share of ``df``.

    ``side`` is repeated for just those (key, salt) that occur.  ``df`` is read twice.
    """
    d = salted(df, [F.col(c) for c in by])
    return d.join(d.select(*keys, "_salt").distinct().join(side, keys), [*keys, "_salt"]).drop("_salt")


def salted_rank(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """Rows of ``df`` with ``name``: a gapless rank from 0 within their group, in the order (salt, by)."""
    d = salted(df, [F.col(c) for c in by])
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    p = d.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    p = p.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_salt").orderBy(*by)
    return d.join(p, [*keys, "_salt"]).withColumn(name, F.col("_before") + F.row_number().over(own) - 1).drop("_before", "_salt")


def bounded_sample(df: DataFrame, group: str, by: list[str], size: int) -> DataFrame:
    """At most ``size`` rows of each group (a string column with few values, not null): those with the least hash of ``by``.

    Rows that repeat ``by`` within a group count as one row (any of them).  A cut of the hashes lets about three times as many
    rows pass as are asked for; where it leaves a group fewer than it should have, the cut of that group is
    widened until it has enough or lets all pass.  Rows are first taken apart by part of their hash, so no task ranks a whole
    group: each part keeps its ``size`` least, and those are ranked together.
    """
    whole = 1 << 30
    turn = F.pmod(F.xxhash64(*by), F.lit(whole))
    rows = df.withColumn("_turn", turn)
    counts = {r[0]: r[1] for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = {g: whole if n <= 4 * size else int(3 * size / n * whole) + 1 for g, n in counts.items()}

    def under() -> DataFrame:
        cut = F.element_at(F.from_json(F.lit(json.dumps(cuts)), "map<string,bigint>"), F.col(group))
        return rows.where(F.col("_turn") < cut)

    while short := {g for g, c in cuts.items() if c < whole}:
        enough = {r[0]: r[1] for r in under().where(F.col(group).isin(sorted(short))).groupBy(group).agg(F.count_distinct("_turn").alias("n")).collect()}
        short = {g for g in short if enough.get(g, 0) < size}
        if not short:
            break
        cuts |= {g: min(whole, 8 * cuts[g]) for g in short}
    first = under().dropDuplicates([group, *by])
    part = F.pmod(F.xxhash64(*by, F.lit(1)), F.lit(SALTS))
    near = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_turn", *by))
    few = first.withColumn("_part", part).withColumn("_near", near).where(F.col("_near") <= size)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_turn", *by))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_turn", "_part", "_near")


def map_texts(df: DataFrame, keep: list[Column], text: Column | list[Column], fields: str, make: Callable[[], Callable], rows: int = 512, many: bool = False) -> DataFrame:
    """The columns ``keep`` as they are, whatever their types and nulls, and the columns ``fields`` (DDL) made of each text.

    ``make`` is called once a task and gives a function of a list of texts (None for null; a list for each of several
    columns) that returns an Arrow array, or a list, for each field; with ``many``, a pair of the places of the rows
    that its rows belong to and those lists.  The kept columns never leave Arrow, so no id is converted.
    """
    texts = text if isinstance(text, list) else [text]
    d = df.select(*keep, *[t.cast("string").alias(f"_text{i}") for i, t in enumerate(texts)])
    n = len(keep)
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([*d.schema.fields[:n], *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                got = work(*[c.to_pylist() for c in part.columns[n:]])
                own = part.columns[:n]
                if many:
                    at, got = got
                    own = [c.take(pa.array(at, pa.int64())) for c in own]
                yield pa.RecordBatch.from_arrays([*own, *[x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got, kinds)]], names=schema.names)

    return d.mapInArrow(run, schema)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table held in the plan itself as one JSON literal: no Python process, no RDD."""
    data = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(data))


def literal_doubles(values: Sequence[float]) -> Column:
    """A constant array<double>; folded once by the optimizer."""
    return F.from_json(F.lit("[" + ",".join(map(repr, map(float, values))) + "]"), "array<double>")


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-space in ``text`` (null: 0)."""
    s = F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1)
    edge = (F.element_at(s, 1) == "").cast("long") + ((F.size(s) > 1) & (F.element_at(s, -1) == "")).cast("long")
    return F.size(s).cast("long") - edge
