"""The queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, sentencepiece, toxicity, warc
from .common import table
from .exact_dedup import exact_dedup
from .langid import identify, train
from .mixing import mix_sources
from .quality import judge
from .sharding import shard_documents
from .simhash import near_dedup
from .suffix import repeated_spans

Query = Callable[[SparkSession, str], DataFrame]


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, distance=3)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(fold(3) != 1), table(spark, sf_dir, "labels").where(fold(3) != 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece.encode(table(spark, sf_dir, "documents"), keep=("doc_id", "text"))
    decoded = sentencepiece.decode(encoded, keep=("doc_id", "text", "ids"), text="decoded")
    return decoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs.where(fold(4) != 2)))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash_dedup, op2_suffix_dedup, op3_warc_derivatives, op4_toxicity, op5_minimax_sharding, op6_quality_rules, op7_sentencepiece, op8_exact_dedup, op9_entropy_mixing, op10_language_id,
)}
ORACLE_SQL: dict[str, str] = oracle.SQL
