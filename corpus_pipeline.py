"""A training-data pipeline over documents: quality rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import likeness, mixing, packing, quality, substrings
from corpusloom.llm.base import scratch_root, scratch_until_here, table


# Each stage takes nulls in any column, empty and very long texts, repeated rows, extra columns of any name and an empty table, as its
# operator states; all but the last return the columns of their documents.


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; null texts and those of under ten words go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a five-word likeness of 0.8 or more: the one with the least doc_id, nulls last."""
    return likeness.like_free(docs, shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words in passages of 50 words that occur more than once; a document of such words only goes."""
    return substrings.without_repeats(docs, window=50)


#: Halfway between the sources' own shares and equal ones by entropy, with four epochs of a source at most.
MIXTURE = mixing.Target(max_epochs=4.0, evenness=0.5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, once at least; its columns leave no place for a number of copies."""
    return mixing.mixed_documents(docs, MIXTURE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, 2048)


STAGES = [
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: Shingle likeness, the FM-index and packing are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stored on the way is deleted when its documents are written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch_until_here(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
