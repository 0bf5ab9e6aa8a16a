"""Reading and writing of pairs: tab-separated text with ragged rows, JSON lines, index tables, predictions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from . import scan

SENTENCES = ["source_text", "target_text", "source_name", "paragraph_id", "sentence_id"]
PARAGRAPHS = SENTENCES[:4]
TRAINING = "input string, output string, metadata struct<source:string,type:string>"
PREDICTIONS = "input string, output string, prediction string, condition string, model string, metadata struct<source:string,type:string>"


def read_tsv(spark: SparkSession, path: str, columns: list[str] = SENTENCES, header: bool = False) -> DataFrame:
    """All columns as strings, with the number of the record, in files of any size (see scan). Missing texts and names are empty,
    missing and empty ids null; further cells are ignored."""
    rows = scan.records(spark, path, header)
    cell = lambda k, c: F.nullif(F.get("cells", F.lit(k)), F.lit("")) if c.endswith("_id") else F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    return rows.select(*(cell(k, c).alias(c) for k, c in enumerate(columns)), "record")


def write_tsv(rows: DataFrame, path: str) -> None:
    """A header and a line a row in each part, ended by CR LF. Cells with a tab, a quote or an end of line are quoted, and line ends in
    cells stay as they are (Spark's own writer turns them into those of the file). Nulls are empty cells."""

    def cell(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(c.rlike('[\t\r\n"]'), quoted).otherwise(c)

    columns = [F.col(f"`{c}`") for c in rows.columns]
    head = rows.sparkSession.createDataFrame([rows.columns], [f"c{k}" for k in range(len(columns))])
    head = "\t".join(str(x) for x in head.select(*(cell(F.col(c)) for c in head.columns)).first())

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    lines = rows.select(F.concat_ws("\t", *map(cell, columns)).alias("value"))
    lines.mapInArrow(headed, "value string").write.text(path, lineSep="\r\n")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str = TRAINING) -> DataFrame:
    """Never infers types; blank lines are skipped."""
    return spark.read.schema(schema).json(paths)


def first(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first rows by an order; all of them for a limit of none or zero."""
    return rows.orderBy(order).limit(limit) if limit else rows


def non_blank(rows: DataFrame, field: str) -> DataFrame:
    return rows.select(field).where(~T.is_blank(F.col(field)))


def training_records(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.col("source_text").alias("input"), F.col("target_text").alias("output"), F.struct(F.col("source_name").alias("source"), F.lit(kind).alias("type")).alias("metadata"))


def write_jsonl(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """With `by`, a folder for each of its values; those of the rows are written anew, others stay."""
    writer = rows.write.option("ignoreNullFields", False)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.json(path)


#: Hex digits of a row's hash that name its leaf, and that each level above drops.
LEAF, STEP = 5, 2


def digest_tree(rows: DataFrame) -> DataFrame:
    """level (0 is the root), node, n, sha256 of a Merkle tree over the rows in any order.

    A row is hashed as JSON and goes to the leaf that the first digits of its hash name; equal rows are counted. A leaf's hash is that of its
    rows' hashes and counts, sorted, and a node's that of its children's names and hashes. So the tree is the same however the rows are
    dealt, its root stands for all of them, and where two trees differ is found from the root down. No node has over 16^STEP children, and
    a leaf holds its share of the different rows.
    """
    rows = rows.select(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    level = rows.select(F.substring("h", 1, LEAF).alias("node"), F.concat_ws(":", "h", "n").alias("x"), "n")
    levels, width = [], LEAF
    while True:
        level = level.groupBy("node").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("x")), ";"), 256).alias("sha256"))
        levels.append(level.select(F.lit(-(-width // STEP)).alias("level"), "node", "n", "sha256"))
        if not width:
            break
        width = max(0, width - STEP)
        level = level.select(F.substring("node", 1, width).alias("node"), F.concat_ws(":", "node", "sha256").alias("x"), "n")
    return reduce(DataFrame.unionByName, levels)


def digest(rows: DataFrame) -> DataFrame:
    """n and the root of the rows' tree; of no rows, 0 and an empty digest."""
    root = digest_tree(rows).where("level = 0")
    return root.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sha256"), F.lit("")).alias("digest"))


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """level, node of what differs in two trees, down to the leaves: those of the rows that one of them has and the other has not."""
    both = one.select("level", "node", F.col("sha256").alias("a")).join(other.select("level", "node", F.col("sha256").alias("b")), ["level", "node"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")
