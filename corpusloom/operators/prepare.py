"""Ingested pairs: normalization, validation with all reject reasons, first-wins deduplication and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def reject_reasons(source: Column, target: Column, min_arabic: int = 1, min_latin: int = 1) -> Column:
    """array<string> of all reasons against a normalized pair, in fixed order."""
    tests = [
        ((source == "") | (target == ""), "EmptyField"),
        (source == target, "SourceEqualsTarget"),
        (T.arabic_count(source) < min_arabic, "LowArabicScriptCount"),
        (T.latin_count(target) < min_latin, "LowLatinScriptCount"),
        (source.contains("�") | target.contains("�"), "EncodingErrorChar"),
    ]
    return F.array_compact(F.array(*(F.when(test, reason) for test, reason in tests)))


def prepare(pairs: DataFrame, min_arabic: int = 1, min_latin: int = 1) -> DataFrame:
    """pairs: record (order), source_text, target_text and others. Normalizes both texts and adds reasons array<string>.

    Of valid rows with equal texts the first record stays; the others get `Duplicate`. Invalid rows neither are nor make duplicates.
    Records are unique.
    """
    rows = pairs.withColumns({"source_text": T.normalize_text(F.col("source_text")), "target_text": T.normalize_text(F.col("target_text"), is_source=False)})
    rows = rows.withColumn("reasons", reject_reasons(F.col("source_text"), F.col("target_text"), min_arabic, min_latin))
    # 128 bits stand for a pair; the first record of each is found before the shuffle, and meets its own row only.
    pair = F.when(F.size("reasons") == 0, F.sha2(F.concat_ws("\n", "source_text", "target_text"), 256).substr(1, 32))
    rows = rows.withColumn("_pair", pair)
    first = rows.where("_pair IS NOT NULL").groupBy("_pair").agg(F.min("record").alias("record")).withColumn("_first", F.lit(True))
    found = rows.join(first, ["_pair", "record"], "left")
    reasons = F.when(F.col("_pair").isNotNull() & F.col("_first").isNull(), F.array(F.lit("Duplicate"))).otherwise(F.col("reasons"))
    return found.withColumn("reasons", reasons).select(*pairs.columns, "reasons")


def accepted(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.size("reasons") == 0).drop("reasons")


def rejected(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.size("reasons") > 0).withColumn("rejection_reasons", F.array_join("reasons", ";")).drop("reasons")
