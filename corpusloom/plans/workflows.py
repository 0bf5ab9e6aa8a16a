"""The workflows end to end: prepare files of pairs, split them, index the targets, answer under a condition, score and report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluate, generate, prepare, retrieve, split
from corpusloom.operators.lineage import checkpointed
from corpusloom.sources import artifacts, pairs

CONDITIONS = ("reference", "knn_fewshot")


def prepared_files(spark: SparkSession, path: str, folder: str, stem: str, kind: str = "sentence", header: bool = False, min_arabic: int = 1, min_latin: int = 1) -> DataFrame:
    """Reads a TSV of pairs and writes <stem>_cleaned.tsv, <stem>_dropped.tsv and <stem>_cleaned.jsonl; returns how many went where."""
    columns = pairs.SENTENCES if kind == "sentence" else pairs.PARAGRAPHS
    rows = pairs.read_tsv(spark, path, columns, header)
    if kind != "sentence":
        rows = rows.withColumn("sentence_id", F.lit(None).cast("string"))
    rows = rows.withColumn("source_name", prepare.T.normalize_text(F.col("source_name")))
    done = checkpointed(prepare.prepare(rows, min_arabic, min_latin))
    good, bad = prepare.accepted(done), prepare.rejected(done)
    pairs.write_tsv(good.select(*pairs.SENTENCES), f"{folder}/{stem}_cleaned.tsv")
    pairs.write_tsv(bad.select(F.lit(kind).alias("unit_type"), *pairs.SENTENCES, "rejection_reasons"), f"{folder}/{stem}_dropped.tsv")
    pairs.write_jsonl(pairs.training_records(good, kind), f"{folder}/{stem}_cleaned.jsonl")
    return done.groupBy((F.size("reasons") == 0).alias("accepted")).agg(F.count("*").alias("n"))


def split_files(spark: SparkSession, records: DataFrame, folder: str, group: str = "source", fractions: dict[str, float] | None = None, source: str = "") -> dict:
    """Splits training records by whole groups, drops what crosses the bounds, audits, and writes train, val and test with a manifest.

    The assignment of groups is a table of its own (work_to_split), as it grows with the input; the manifest has counts and digests.
    """
    rows = records.withColumn("record", F.monotonically_increasing_id()).withColumn("group", F.col(f"metadata.`{group}`"))
    rows = checkpointed(rows)
    assignment = checkpointed(split.assign_groups(rows, "group", fractions))
    before = checkpointed(split.keyed(split.with_split(rows, "group", assignment), "input", "output"))
    after = checkpointed(split.drop_seen(before, ["work_rank", "record"]))
    split.assert_no_leaks(after)
    counts = {r["split"]: r.asDict() for r in split.dedup_counts(before, after).collect()}  # a row a split
    hashes = {}
    for name in fractions or ("train", "val", "test"):
        own = after.where(F.col("split") == name).orderBy("work_rank", "record").select("input", "output", "metadata")
        pairs.write_jsonl(own, f"{folder}/{name}.jsonl")
        hashes[f"{name}.jsonl"] = pairs.digest(own).first()["digest"]
    pairs.write_jsonl(assignment, f"{folder}/work_to_split.jsonl")
    of = lambda c: {name: r[c] for name, r in sorted(counts.items())}
    manifest = {
        "config": {"input_file": source, "group_key": group, "fracs": fractions or {"train": 0.8, "val": 0.1, "test": 0.1}},
        "counts": {"loaded": sum(of("n_before").values()), "pre_dedup": of("n_before"), "final": of("n_final"), "dropped_dedup": of("n_dropped"), "final_ratios": of("ratio")},
        "work_to_split": "work_to_split.jsonl",
        "hashes": hashes,
    }
    artifacts.write_json(spark, f"{folder}/manifest.json", manifest)
    return manifest


def indexed(spark: SparkSession, train: DataFrame, path: str, embedder: Callable = generate.hashing_embedder, model: str = "hashing", source: str = "") -> None:
    """Embeds the targets of training records and writes the index."""
    artifacts.write_index(generate.embedded(train, "output", embedder, name=model), path, model, source)


def prompted(rows: DataFrame, condition: str, index: DataFrame | None = None, k: int = 4, embedder: Callable = generate.hashing_embedder, prefix: str = "") -> DataFrame:
    """Adds prompt to rows (query_id, input and others) as the condition has it: the text alone, or k neighbours of it before."""
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition {condition!r}, known are {', '.join(CONDITIONS)}")
    text = F.coalesce("input", F.lit(""))
    if condition == "reference":
        return rows.withColumn("prompt", retrieve.zero_shot_prompt(text))
    queries = generate.embedded(rows.select("query_id", "input"), "input", embedder, prefix)
    found = retrieve.cosine_topk(queries, index, k, "query_id", "passage_id")
    found = found.join(index.select(F.col("passage_id").alias("row_id"), F.struct(F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output")).alias("pair")), "row_id")
    found = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "pair"))), lambda x: x["pair"]).alias("exemplars"))  # k of them
    none = F.array().cast("array<struct<input:string,output:string>>")
    return rows.join(found, "query_id", "left").withColumn("prompt", retrieve.few_shot_prompt(text, F.coalesce("exemplars", none))).drop("exemplars")


def answered_files(spark: SparkSession, rows: DataFrame, folder: str, condition: str, provider: str, model: str, split_name: str, limit: int | None = None, system: str = "", concurrency: int | None = None, **prompting) -> DataFrame:
    """Answers the records (input, output, metadata) under a condition; writes predictions and the usage, and returns the usage."""
    options = prompting.pop("options", {})
    rows = pairs.first(rows.withColumn("query_id", F.monotonically_increasing_id()), "query_id", limit)
    asked = prompted(checkpointed(rows), condition, **prompting)
    done = checkpointed(generate.answered(asked, provider, system, concurrency=concurrency, model=model, **options))
    done = done.select("*", F.lit(condition).alias("condition"), F.lit(model).alias("model"))
    artifacts.write_predictions(done.select("input", "output", "prediction", "condition", "model", "metadata"), folder, split_name)
    used = evaluate.usage(done)
    artifacts.write_json(spark, f"{folder}/{condition}_{split_name}_usage.json", [r.asDict() for r in used.collect()])  # a row
    return used


def scored(predictions: DataFrame) -> DataFrame:
    """A row a condition: n, BLEU, chrF, marker rates of predictions and references."""
    return evaluate.scores(predictions, "condition", "prediction", "output")


def reported(predictions: DataFrame, center: DataFrame | None = None) -> DataFrame:
    """Register features of each condition's predictions and of the references; with a centroid, the distance to it as well."""
    texts = predictions.select("condition", F.col("prediction").alias("text")).unionByName(predictions.select(F.lit("reference_target").alias("condition"), F.col("output").alias("text")))
    rows = evaluate.report(evaluate.featured(texts), "condition")
    return evaluate.with_distance(rows, center) if center is not None else rows
