import duckdb
import pytest

from corpusloom.plans import catalog

HEAD = "one header that many of the documents share word for word, and of over sixty characters"


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(k, f"{HEAD} body{k} kyq {'quick ' * (k % 3)}end{k % 7}", "s") for k in range(40)] + [(40, None, "s"), (41, "", "s"), (42, f"Own{9} {HEAD} x", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    said = [(c, t, "user" if t % 2 == 0 else "assistant", x) for c in range(6) for t, x in enumerate(["a key of yaks" * (c % 3), "an answer of letters " * (c % 4 + 3)])]
    spark.createDataFrame(said + [(9, 0, "user", None), (9, 1, "assistant", "short")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["normalized_sources", "leakage_audit", "cross_boundary_dedup", "dedup_counts", "validated_pairs"])
def test_whole_text_queries_are_their_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, tables)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.fetchall())) and got.count()


def test_rows_that_share_only_a_header_are_told_apart_by_their_last_word(spark, tables):
    rows = sorted(catalog.word_keyed_documents(spark, tables).collect(), key=lambda r: (["train", "val", "test"].index(r["split"]), r["doc_id"]))
    seen, want = (set(), set()), set()
    for r in rows:
        if r["split"] == "train" or (r["input_key"] not in seen[0] and r["output_key"] not in seen[1]):
            want.add(r["doc_id"])
            seen[0].add(r["input_key"])
            seen[1].add(r["output_key"])
    assert {r["doc_id"] for r in catalog.cross_boundary_dedup(spark, tables).collect()} == want
    assert {r["output_key"] for r in rows} >= {f"end{k}" for k in range(7)}
