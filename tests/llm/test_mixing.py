import math
from collections import defaultdict

from corpusloom.llm import mixing


def table(spark, sizes, words=20):
    rows = [(1000 * k + i, " ".join(f"w{i}" for _ in range(words)), f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def taken(rows):
    out = defaultdict(int)
    for r in rows:
        out[r["source"]] += r["copies"] * r["n_tokens"]
    return out


def test_shares_meet_the_weights_and_no_source_repeats_too_often(spark):
    sizes = [400, 100, 20, 5]
    rows = mixing.schedule(table(spark, sizes), mixing.Target(2.0), block_tokens=200).collect()
    got, total = taken(rows), 20 * sum(sizes)
    for k, n in enumerate(sizes):
        weight = next(r["weight"] for r in rows if r["source"] == f"s{k}")
        assert abs(got[f"s{k}"] - weight * total) <= 21 and got[f"s{k}"] <= 2.001 * 20 * n
        assert len({r["copies"] for r in rows if r["source"] == f"s{k}"}) <= 2
    flat = [got[f"s{k}"] / (20 * n) for k, n in enumerate(sizes)]
    assert flat == sorted(flat) and flat[-1] > 1.9  # the limit is met by the smallest source


def test_a_target_entropy_is_met(spark):
    for target in (0.6, 1.0, 1.3):
        rows = mixing.schedule(table(spark, [400, 100, 20, 5]), mixing.Target(1e9, target)).collect()
        weights = {r["source"]: r["weight"] for r in rows}.values()
        own = -sum(p * math.log(p) for p in (400 / 525, 100 / 525, 20 / 525, 5 / 525))
        assert abs(-sum(w * math.log(w) for w in weights) - max(target, own)) < 1e-3


def test_keeping_all_takes_every_row(spark):
    docs = table(spark, [300, 40, 7])
    rows = mixing.schedule(docs, keep_all=True).collect()
    assert min(r["copies"] for r in rows) >= 1 and max(r["copies"] for r in rows) <= 5
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in rows)


def test_odd_rows(odd_docs):
    got = mixing.schedule(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["copies"] >= 0 for r in got)
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.select("doc_id", "text").distinct().count() == odd_docs.select("doc_id", "text").distinct().count()
    assert mixing.schedule(odd_docs.limit(0)).count() == 0 and mixing.mixed_documents(odd_docs.limit(0)).count() == 0
    assert mixing.mixed_documents(odd_docs.where("text IS NULL OR text = ''")).count() == 3


def test_an_exponent_between_0_and_1_is_solved_on_the_supplied_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for target, keep_all in ((mixing.Target(2.0, evenness=0.5), False), (mixing.Target(4.0, evenness=0.5), True)):
        got = mixing.solution(docs, target, keep_all=keep_all)
        assert 0.05 < got.exponent < 0.95 and abs(got.entropy - got.target) < 1e-5 and got.epochs <= target.max_epochs
    tight = mixing.solution(docs, mixing.Target(1.2, evenness=0.99))
    assert 0.05 < tight.exponent < 0.95 and tight.entropy < tight.target and abs(tight.epochs - 1.2) < 1e-3
    assert len({round(r["weight"], 9) for r in mixing.schedule(docs, mixing.Target(2.0, evenness=0.5)).collect()}) > 10
