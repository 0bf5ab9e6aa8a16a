"""Incremental ingest: files of pairs are normalized and validated as they arrive (an extension; batch preparation is in
operators/prepare.py).

Validation needs one row at a time. Duplicates are looked for among the pairs of the last `within` of arrival only, as a stream has no
end to wait for: the first one stays, later ones are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as T
from corpusloom.operators.prepare import reject_reasons
from corpusloom.sources.pairs import SENTENCES


def arriving(spark: SparkSession, folder: str, columns: list[str] = SENTENCES, header: bool = False) -> DataFrame:
    """The rows of TSV files as they come into a folder, with the time of the file."""
    rows = spark.readStream.schema(", ".join(f"{c} string" for c in columns)).option("sep", "\t").option("quote", '"').option("escape", '"').option("header", header).option("multiLine", True).csv(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def validated(rows: DataFrame, min_arabic: int = 1, min_latin: int = 1) -> DataFrame:
    """Normalized texts and reasons array<string>; a stream or a table."""
    rows = rows.withColumns({"source_text": T.normalize_text(F.col("source_text")), "target_text": T.normalize_text(F.col("target_text"), is_source=False)})
    return rows.withColumn("reasons", reject_reasons(F.col("source_text"), F.col("target_text"), min_arabic, min_latin))


def accepted(rows: DataFrame, within: str = "1 day") -> DataFrame:
    """Valid pairs, the first of each within a time of arrival."""
    good = rows.where(F.size("reasons") == 0).drop("reasons").withWatermark("arrived", within)
    return good.dropDuplicatesWithinWatermark(["source_text", "target_text"])


def written(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there by now as Parquet, each row once however often the query is started."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
