import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries


def compare(spark, name, folder):
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        if files := glob.glob(f"{folder}/{table}.parquet/*.parquet") or glob.glob(f"{folder}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet({files})")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op3_quality", "op9_substrings", "op11_exact"])
def test_odd_rows_equal_the_sql(spark, odd_docs, table_dir, name):
    docs = odd_docs.where("length(text) < 10000 OR text IS NULL")
    compare(spark, name, table_dir(documents=docs.unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(77).cast("long")))))


def test_odd_conversations_equal_the_sql(spark, table_dir):
    rows = [(1, 0, "user", "a<b\\l\\n"), (1, 1, "user", None), (1, 2, "assistant", "</turn>\n<next/>"), (1, None, None, "x"), (2, 0, "r\n<\\", ""), (2, 0, "r\n<\\", ""), (None, 3, "assistant", "é日")]
    compare(spark, "op5_chat", table_dir(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
