import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate, generate, split
from corpusloom.plans import workflows
from corpusloom.sources import artifacts, pairs


def test_cells_come_back_from_a_tsv_as_they_were(spark, tmp_path):
    cells = ["plain", "x\ny", "x\r\ny", "x\ry", 'say "hi"', '"', "a\tb", "", None, " edge ", "é日", '","']
    rows = spark.createDataFrame([(c, cells[-k - 1], f"n{k}", str(k), None) for k, c in enumerate(cells)], "source_text string, target_text string, source_name string, paragraph_id string, sentence_id string")
    pairs.write_tsv(rows.repartition(3), str(tmp_path / "out"))
    got = {r["paragraph_id"]: r for r in pairs.read_tsv(spark, str(tmp_path / "out"), header=True).collect()}
    assert {k: (r["source_text"], r["target_text"]) for k, r in got.items()} == {str(k): tuple(x or "" for x in (c, cells[-k - 1])) for k, c in enumerate(cells)}
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert raw.startswith(b"source_text\ttarget_text\tsource_name\tparagraph_id\tsentence_id\r\n") and b'"x\ny"' in raw and b'"x\r\ny"' in raw
    pairs.write_tsv(rows.limit(0), str(tmp_path / "none"))
    assert pairs.read_tsv(spark, str(tmp_path / "none"), header=True).count() == 0


def test_blank_segments_count_in_the_marker_rate(spark):
    rows = spark.createDataFrame([("a", "thou"), ("a", ""), ("a", " "), ("b", None)], "c string, text string")
    assert {r["c"]: (r["n"], r["marker_rate"]) for r in evaluate.marker_rate(rows, "c").collect()} == {"a": (3, pytest.approx(1 / 3)), "b": (1, 0)}


def test_every_row_gets_the_split_of_its_group(spark, monkeypatch):
    rows = spark.createDataFrame([(k, ("a", "b", "", None)[k % 4]) for k in range(40)], "k int, g string")
    for limit in (100_000, 0):
        monkeypatch.setattr(split, "BROADCAST_ROWS", limit)
        got = split.with_split(rows, "g", split.assign_groups(rows, "g")).collect()
        assert len(got) == 40 and {(r["work"], r["split"], r["work_rank"]) for r in got} == {("<unknown>", "train", 0), ("a", "train", 1), ("b", "test", 2)}


def test_dropped_rows_are_counted(spark):
    rows = spark.createDataFrame([(1, "train", "a", "b"), (2, "val", "a", "c"), (3, "val", "d", "e"), (4, "test", "d", "f")], "id int, split string, input_key string, output_key string")
    got = {r["split"]: tuple(r)[1:] for r in split.dedup_counts(rows, split.drop_seen(rows, ["id"])).collect()}
    assert got == {"train": (1, 1, 0, 0.5), "val": (2, 1, 1, 0.5), "test": (1, 0, 1, 0.0)}


def test_best_of_breaks_ties_by_place():
    import numpy as np

    from corpusloom.operators.retrieve import best_of

    r = np.random.default_rng(1)
    scores = r.integers(0, 5, (40, 30)).astype(float)
    for k in (1, 4, 29, 30, 50):
        assert (best_of(scores, k) == np.argsort(-scores, axis=1, kind="stable")[:, :k]).all()


def test_shared_ngrams_are_counted_by_loops(spark):
    from collections import Counter

    import numpy as np

    r = random.Random(2)
    texts = [["".join(r.choice("ab ") for _ in range(r.randrange(12))) for _ in range(9)] for _ in range(2)]
    sides = [(np.array([ord(c) for t in side for c in t], np.int64), np.cumsum([0, *map(len, side)])) for side in texts]
    got = evaluate.shared_ngrams(*sides, 4)
    for i, (a, b) in enumerate(zip(*texts)):
        for n in range(1, 5):
            one, two = (Counter(t[k : k + n] for k in range(len(t) - n + 1)) for t in (a, b))
            assert got[i, n - 1].tolist() == [sum((one & two).values()), sum(one.values()), sum(two.values())]


def test_files_are_prepared_split_indexed_answered_and_scored(spark, tmp_path):
    r = random.Random(3)
    lines = [f"{r.choice(['سلام', 'كتاب'])} {k}\tthe answer thou number {k} here\twork {k % 7}\t{k}\t1" for k in range(60)]
    lines += [lines[0], "\tonly\tw\t1\t1", "سلام\tسلام\tw\t1\t1"]
    (tmp_path / "in.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    at = str(tmp_path)
    counts = {x["accepted"]: x["n"] for x in workflows.prepared_files(spark, f"{at}/in.tsv", at, "s").collect()}
    assert counts == {True: 60, False: 3}
    dropped = pairs.read_tsv(spark, f"{at}/s_dropped.tsv", ["unit_type", *pairs.SENTENCES, "rejection_reasons"], header=True).collect()
    assert sorted(x["rejection_reasons"] for x in dropped) == ["Duplicate", "EmptyField;LowArabicScriptCount", "SourceEqualsTarget;LowLatinScriptCount"]

    records = pairs.read_jsonl(spark, f"{at}/s_cleaned.jsonl")
    manifest = workflows.split_files(spark, records, f"{at}/splits", fractions={"train": 0.6, "val": 0.2, "test": 0.2}, source="s")
    assert manifest["counts"]["loaded"] == 60 and sum(manifest["counts"]["final"].values()) + sum(manifest["counts"]["dropped_dedup"].values()) == 60
    assert json.loads((tmp_path / "splits/manifest.json").read_text()) == manifest
    fields = artifacts.read_field(spark, f"{at}/splits", "train", "input")
    assert fields.count() == manifest["counts"]["final"]["train"]
    with pytest.raises(FileNotFoundError):
        artifacts.read_field(spark, f"{at}/splits", "other", "input")

    workflows.indexed(spark, pairs.read_jsonl(spark, f"{at}/splits/train.jsonl"), f"{at}/index", source="train")
    passages, meta = artifacts.read_index(spark, f"{at}/index")
    assert meta == {"embed_model": "hashing", "n_passages": passages.count(), "dim": 64, "source_file": "train"}
    assert artifacts.read_index(spark, f"{at}/index", "other")[1]["embed_model"] == "other"

    val = pairs.read_jsonl(spark, f"{at}/splits/val.jsonl")
    for condition, more in (("reference", {}), ("knn_fewshot", {"index": passages, "k": 2})):
        used = workflows.answered_files(spark, val, f"{at}/answers", condition, "echo", "gpt-4o", "val", limit=5, concurrency=2, **more).first()
        assert used["calls"] == min(5, val.count())
        assert json.loads((tmp_path / f"answers/{condition}_val_usage.json").read_text())[0]["prompt_tokens"] == used["prompt_tokens"]
    with pytest.raises(ValueError):
        workflows.prompted(val, "unknown")
    found = artifacts.read_predictions(spark, f"{at}/answers")
    scores = {x["condition"]: x for x in workflows.scored(found).collect()}
    assert set(scores) == {"reference", "knn_fewshot"} and scores["reference"]["ref_marker_rate"] == 1.0
    center = evaluate.centroid(evaluate.featured(val.select(F.col("output").alias("text"))))
    artifacts.write_centroid(center, f"{at}/centroid.json")
    again = artifacts.read_centroid(spark, f"{at}/centroid.json")
    assert again.first() == center.select(again.columns).first() and artifacts.read_centroid(spark, f"{at}/none.json") is None
    report = {x["condition"]: x for x in workflows.reported(found, again).collect()}
    assert set(report) == {"reference", "knn_fewshot", "reference_target"} and report["reference_target"]["stylo_dist"] < report["reference"]["stylo_dist"]
    assert artifacts.shown(workflows.scored(found)).splitlines()[0].split() == ["condition", "n", "bleu", "chrf", "hyp_marker_rate", "ref_marker_rate"]


def test_configurations_are_read(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"k": [1, 2]}')
    assert artifacts.read_config(spark, str(tmp_path / "c.json")) == {"k": [1, 2]}
    assert artifacts.read_json(spark, str(tmp_path / "none.json"), 5) == 5


def test_tokens_of_a_plugged_in_tokenizer_and_calls_with_keys(spark):
    rows = spark.createDataFrame([("g", "one two"), ("g", "three"), ("g", None)], "g string, text string")
    got = evaluate.fertility(rows, "g", tokens=generate.token_counts(F.col("text"), lambda: lambda texts: [3 * len(t.split()) for t in texts])).first()
    assert (got["n"], got["tokens"], got["fertility_corpus"]) == (2, 9, 3.0)
    assert generate.call_key("a", "b", "c") != generate.call_key("ab", "", "c")
    prompts = spark.createDataFrame([(1, None), (2, "x\ny")], "id int, prompt string")
    assert {r["id"]: r["prediction"] for r in generate.answered(prompts, "echo").collect()} == {1: "", 2: "y"}


def test_invisible_characters_and_arabic_letters(spark):
    row = spark.createDataFrame([("﻿ك​تا‌بـ ي",)], "t string").select(T.normalize_text(F.col("t")).alias("t"), T.arabic_count(F.col("t")).alias("n")).first()
    assert row["t"] == "کتا‌ب ی"


def test_resampled_bounds_hold_the_difference(spark):
    r = random.Random(5)
    rows = [(k, r.gauss(0, 1), r.gauss(0.5, 1)) for k in range(400)]
    got = evaluate.paired_bootstrap(spark.createDataFrame(rows, "s long, a double, b double"), "s", "a", "b", 300).first()
    own = [b - a for _, a, b in rows]
    mean = sum(own) / 400
    error = (sum((x - mean) ** 2 for x in own) / 400 / 400) ** 0.5
    assert got["n"] == 400 and got["difference"] == pytest.approx(mean)
    assert got["low"] == pytest.approx(mean - 1.96 * error, abs=0.4 * error) and got["high"] == pytest.approx(mean + 1.96 * error, abs=0.4 * error)


def test_resampling_is_that_of_loops(spark):
    import hashlib

    r = random.Random(6)
    rows = [(f"s{k}", r.random(), r.random() if k % 9 else None) for k in range(150)]

    def weight(segment, k):
        x = (int(hashlib.md5(segment.encode()).hexdigest()[:15], 16) + k * evaluate.STEP) % 2**64
        for m in evaluate.MIX:
            x = (x ^ x >> 33) * m % 2**64
        u = ((x ^ x >> 33) >> 11) / 2**53
        return sum(u >= p for p in evaluate.POISSON)

    own = [(s, b - a) for s, a, b in rows if b is not None]
    means = []
    for k in range(1, 41):
        w = [weight(s, k) for s, _ in own]
        means.append(sum(x * d for x, (_, d) in zip(w, own)) / sum(w))
    got = evaluate.paired_bootstrap(spark.createDataFrame(rows, "s string, a double, b double").repartition(3), "s", "a", "b", 40, 0.9).first()
    means.sort()
    at = lambda q: means[int(q * 39)] + (q * 39 - int(q * 39)) * (means[min(39, int(q * 39) + 1)] - means[int(q * 39)])
    assert (got["n"], got["difference"]) == (len(own), pytest.approx(sum(d for _, d in own) / len(own)))
    assert got["low"] == pytest.approx(at(0.05)) and got["high"] == pytest.approx(at(0.95))
    none = evaluate.paired_bootstrap(spark.createDataFrame([], "s string, a double, b double"), "s", "a", "b", 5).first()
    assert none["n"] == 0 and none["low"] is None
