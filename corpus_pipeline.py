"""A training-corpus pipeline over ``documents``: each stage applies one operator to all that its predecessor kept.

Stages but the last return the columns of their input, whatever their names: a row travels as one struct beside
its key (id and SHA-256 of the text).  ``run`` cuts the plan after each stage, so that none is run twice.

Defined results: rows with a null, empty or letterless text go in the first stage; null ids are an id of their own, after all
others, and stay where their text does; of rows that repeat id and text one stays; texts of any length are read
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facet.llm import langid, sentencepiece
from facet.llm.common import durable
from facet.llm.exact_dedup import exact_dedup
from facet.llm.mixing import mix_sources
from facet.llm.simhash import near_dedup


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as (_key, _doc): what names a row (null ids last, then the id, then the text), and the row itself."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("sha"), F.col("text").isNull().alias("gone"))
    return docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_doc"))


def _one_each(rows: DataFrame, kept: DataFrame, how: str = "left_semi") -> DataFrame:
    """Of the rows (_key, _doc) those whose key is in ``kept``, one for each key."""
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return rows.join(kept, "_key", how).withColumn("_turn", turn).where("_turn = 1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text some language model accepts; models learn from rows with a language."""
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    rows = docs.select(F.col("text").alias("text"), F.struct(*docs.columns).alias("_doc"))
    return langid.identify(rows, model, keep=["_doc"]).where(~F.col("rejected")).select("_doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays, null ids last."""
    rows = _keyed(docs)
    kept = exact_dedup(rows.select("_key", F.col("_doc.text").alias("text")), id_col="_key").where("kept").select("_key")
    return _one_each(rows, kept).select("_doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a five-word similarity of 0.8 or more one row stays: that of the smallest id, null ids last."""
    rows = _keyed(docs)
    found = near_dedup(rows.select("_key", F.col("_doc.text").alias("text")), id_col="_key", width=5, least=0.8)
    return _one_each(rows, found.where(F.col("_key") == F.col("component_id")).select("_key").distinct()).select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (none, one, two) as the mixture takes it; those of rows that repeat id and text are given together."""
    rows = _keyed(docs)
    taken = mix_sources(rows.select("_key", F.col("_doc.text").alias("text"), F.col("_doc.source").alias("source")), id_col="_key")
    taken = taken.groupBy("_key").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    return _one_each(rows, taken, "inner").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    out = sentencepiece.encode(docs, keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language models, near-duplicate classes and tokens are beyond SQL: tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)  # later stages read their input several times
    return docs
