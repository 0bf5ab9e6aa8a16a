"""Small documents beside the tables (JSON, prompts, configurations) and what is written with them: centroids, indexes, predictions.

All go through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from .pairs import PREDICTIONS, read_jsonl, write_jsonl


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def listed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """The paths in a folder with a suffix, sorted."""
    where, system = _at(spark, folder)
    return sorted(str(f.getPath().toString()) for f in system.listStatus(where) if f.getPath().getName().endswith(suffix))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, system = _at(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def read_json(spark: SparkSession, path: str, missing: object = None) -> object:
    """The document, or `missing` where there is none."""
    return json.loads(read_text(spark, path)) if exists(spark, path) else missing


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration in JSON, or in YAML where the yaml module is there."""
    text = read_text(spark, path)
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def read_field(spark: SparkSession, folder: str, split: str, field: str) -> DataFrame:
    """Stripped values of a field that are not blank, from <folder>/<split>.jsonl, or from all *.jsonl there for the split `all`."""
    paths = listed(spark, folder, ".jsonl") if split == "all" else [f"{folder}/{split}.jsonl"]
    if gone := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(gone))
    if not paths:
        raise FileNotFoundError(f"{folder}/*.jsonl")
    edge = f"^{T.WS}+|{T.WS}+$"
    return read_jsonl(spark, paths).where(~T.is_blank(F.col(field))).select(F.regexp_replace(field, edge, "").alias(field))


def write_centroid(center: DataFrame, path: str) -> None:
    """center: the one row of evaluate.centroid."""
    row = center.first()
    write_json(center.sparkSession, path, {"n_segments": row["n_segments"], "features": T.FEATURES, "mean": [row[f"{f}_mean"] for f in T.FEATURES], "std": [row[f"{f}_std"] for f in T.FEATURES]})


def read_centroid(spark: SparkSession, path: str) -> DataFrame | None:
    """One row as evaluate.centroid gives it, or None where nothing was written."""
    found = read_json(spark, path)
    if found is None:
        return None
    if found["features"] != T.FEATURES:
        raise ValueError(f"{path} has the features {found['features']}")
    columns = [("n_segments", found["n_segments"])]
    for f, mean, std in zip(T.FEATURES, found["mean"], found["std"], strict=True):
        columns += [(f"{f}_mean", float(mean)), (f"{f}_std", float(std))]
    return spark.createDataFrame([tuple(v for _, v in columns)], ", ".join(f"{c} {'long' if c == 'n_segments' else 'double'}" for c, _ in columns))


def write_index(embedded: DataFrame, path: str, model: str, source: str) -> None:
    """embedded: input, output, embedding (of the output) and others. A table of passages, numbered, and what is known about it."""
    spark = embedded.sparkSession
    embedded.withColumn("passage_id", F.monotonically_increasing_id()).withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{path}/passages")
    known = spark.read.parquet(f"{path}/passages").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    write_json(spark, f"{path}/meta.json", {"embed_model": model, "n_passages": known["n"], "dim": known["dim"] or 0, "source_file": source})


def read_index(spark: SparkSession, path: str, model: str | None = None) -> tuple[DataFrame, dict]:
    """The passages and what is known about them; a model given here goes before the one that made the index."""
    meta = read_json(spark, f"{path}/meta.json")
    if meta is None:
        raise FileNotFoundError(f"{path}/meta.json")
    return spark.read.parquet(f"{path}/passages"), meta | ({"embed_model": model} if model else {})


def write_predictions(rows: DataFrame, path: str, split: str) -> None:
    """rows: input, output, prediction, condition, model, metadata; a folder for each condition and split."""
    write_jsonl(rows.withColumn("split", F.lit(split)), path, by=["condition", "split"])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PREDICTIONS}, split string").json(path)


def shown(rows: DataFrame, limit: int = 50) -> str:
    """The first rows as a table of text, columns to the left."""
    cells = [rows.columns, *([str(x) for x in r] for r in rows.limit(limit).collect())]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in cells)
