import os

import duckdb
import pytest

import __spark_entry__
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    got = sorted(str(tuple(r[c] for c in sorted(rows.columns))) for r in rows.collect())
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for file in os.listdir(SF):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
        other = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in other.description]
        assert sorted(names) == sorted(rows.columns)
        order = [names.index(c) for c in sorted(names)]
        assert got == sorted(str(tuple(r[k] for k in order)) for r in other.fetchall())


def test_entry_lists_every_query():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
