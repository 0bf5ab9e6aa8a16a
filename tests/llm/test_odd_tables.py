"""Odd rows for the operators whose own tests have none: nulls, very long texts, repeated rows, clashing columns, empty tables."""

from pyspark.sql import functions as F

from corpusloom.llm import chat, likeness, simhash, substrings
from test_simhash import classes, slow
from test_substrings import brute


def rows_of(df):
    return df.select("doc_id", "text").collect()


def test_simhash(odd_docs):
    rows = rows_of(odd_docs)
    got = simhash.near_duplicates(odd_docs).collect()
    fps = [slow(r["text"] or "") for r in rows]
    group = classes(fps, 4)
    least = {g: min((r["doc_id"] for r, k in zip(rows, group) if k == g and r["doc_id"] is not None), default=None) for g in group}
    want = [(r["doc_id"], f"{fp:016x}", least[g]) for r, fp, g in zip(rows, fps, group)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    assert simhash.near_free(odd_docs).columns == odd_docs.columns


def test_likeness(odd_docs):
    got = likeness.like_free(odd_docs)
    assert got.columns == odd_docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    assert len(kept) == len(set(kept)) and {0, 6, 7, 8, 9} <= set(kept) and not {1, 2} & set(kept)
    assert likeness.like_free(odd_docs.limit(0)).count() == 0


def test_substrings(odd_docs):
    rows = rows_of(odd_docs)
    got = substrings.deduplicated(odd_docs).collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows], 35))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = substrings.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id IN (0, 1, 2, 3)").count() == 4


def test_chat(spark):
    rows = [(1, 0, "user", "hi", 1, "x", "y"), (1, 1, "assistant", "long words " * 100_000, 1, "x", "y"), (1, 1, "assistant", "long words " * 100_000, 1, "x", "y"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns long, parts string, told string")
    got = {r["conv_id"]: r for r in chat.digest(docs).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 * 11 * 100_000 and got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0


def test_crowded_hubs_and_chains_make_one_component(spark):
    from corpusloom.llm import components

    links = spark.range(3000).select(F.col("id").alias("u"), F.lit(5000).cast("long").alias("v")).union(spark.range(6000, 6040).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    got = {r["u"]: r["v"] for r in components.labels(links).collect()}
    assert got == {**{k: 0 for k in [*range(1, 3000), 5000]}, **{k: 6000 for k in range(6001, 6041)}}
