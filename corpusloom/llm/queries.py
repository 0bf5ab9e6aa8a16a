"""The queries of this package; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, divergence, exact, language, mixing, packing, quality, reassembly, sharding, simhash, substrings, token_files
from .base import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus budget, spread over the sources with an entropy halfway between their own and that of equal shares, unless that takes
    the documents of a source over twice on average."""
    return mixing.schedule(table(spark, sf_dir, "documents"), mixing.Target(max_epochs=2.0, evenness=0.5))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_segments(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), window=35)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


def op12_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassembly.digest(table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_fingerprints, op3_quality, op4_packing, op5_chat, op6_sharding, op7_token_files, op8_simhash, op9_substrings, op10_language, op11_exact, op12_reassembly, op13_divergence)}
ORACLES: dict[str, str] = {"op3_quality": quality.verdicts_sql(), "op5_chat": chat.DIGEST_SQL, "op9_substrings": substrings.deduplicated_sql(35), "op11_exact": exact.COPIES_SQL, "op13_divergence": divergence.AUDIT_SQL}
