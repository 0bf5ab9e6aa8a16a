import csv
import random

import pyarrow as pa
import pytest

from corpusloom.sources import pairs, scan


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(r):
    kinds = ["plain", "", '"quoted"', '"two\nlines"', '"a ""doubled"" one"', 'mid"field', '"closed"after', '"cr\r\nlf in cell"', '"tab\tin cell"', '""', '"\n\n\n"', "é日", '"""', 'x""y', '"lone\rcr"', '" "" \n "" "']
    return [r.choice(kinds) * r.randrange(1, 3) for _ in range(r.randrange(1, 8))]


def read(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return [(k, row) for k, row in enumerate(csv.reader(f, delimiter="\t"), start=1) if row]


def test_states_are_those_of_the_csv_module():
    r = random.Random(1)
    for _ in range(3000):
        line = "\t".join(cells(r)).replace("\n", "").replace("\r", "") + "\n"
        for inside in (False, True):
            rows = list(csv.reader(iter([*(['"\n'] if inside else []), line, "next\n"]), delimiter="\t"))
            assert scan.inside_after(line, inside) == (not rows or rows[-1] != ["next"]), (line, inside)


def test_records_of_many_splits_are_those_of_the_csv_module(spark, tmp_path, small_splits):
    r = random.Random(2)
    for k in range(6):
        path = tmp_path / f"f{k}.tsv"
        body = "".join("\t".join(cells(r)) + r.choice(["\n", "\r\n", "\n", "\n\n", "\r"]) for _ in range(200))
        path.write_bytes((("\ufeff" if k % 2 else "") + body + ("" if k % 3 else '"never closed\n\nrest')).encode())
        got = sorted((x["record"], x["cells"]) for x in scan.records(spark, str(path)).collect())
        assert got == read(path)
    tasks = scan.lines(spark, str(tmp_path / "f0.tsv")).rdd.getNumPartitions()
    assert tasks > 20


def test_a_cell_over_many_splits_and_no_known_splits(spark, tmp_path, small_splits, monkeypatch):
    path = tmp_path / "long.tsv"
    path.write_text('head\tb\n1\t"' + "line of a long cell\n" * 300 + '"\tend\n2\tx\n')
    for limit in (scan.BROADCAST_SPLITS, 0):
        monkeypatch.setattr(scan, "BROADCAST_SPLITS", limit)
        assert sorted((x["record"], x["cells"]) for x in scan.records(spark, str(path)).collect()) == read(path)


def test_numbers_go_on_over_files_and_headers_do_not_count(spark, tmp_path, small_splits):
    want, n = [], 0
    for name in "abc":
        rows = [(f"{name}{k}", "x" * 40) for k in range(12)]
        (tmp_path / f"{name}.tsv").write_text("source_text\ttarget_text\n" + "".join(f"{a}\t{b}\n" for a, b in rows))
        want += [(n + k + 1, a) for k, (a, _) in enumerate(rows)]
        n += len(rows)
    (tmp_path / "d.tsv").write_text("")
    got = pairs.read_tsv(spark, str(tmp_path), header=True)
    assert sorted((x["record"], x["source_text"]) for x in got.collect()) == want
    assert pairs.read_tsv(spark, str(tmp_path / "d.tsv")).count() == 0


def test_a_plan_that_cuts_otherwise_is_an_error(spark, tmp_path, small_splits):
    (tmp_path / "a.tsv").write_text("some line\n" * 100)
    rows = scan.records(spark, str(tmp_path / "a.tsv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    with pytest.raises(Exception, match="cut otherwise"):
        rows.count()


def test_the_tree_finds_what_differs_and_does_not_ask_how_rows_are_dealt(spark):
    import hashlib
    import json

    rows = [(k, f"text {k}", None if k % 3 else "x") for k in range(400)] + [(5, "text 5", None)] * 30
    df = spark.createDataFrame(rows, "a int, b string, c string")
    root = pairs.digest(df.repartition(1)).first()
    assert root["n"] == 430 and pairs.digest(df.repartition(7, "b").orderBy("b")).first() == root
    changed = spark.createDataFrame([*rows[:77], (77, "text 7?", None), *rows[78:]], df.schema)
    other = pairs.digest_tree(changed)
    assert pairs.digest(changed).first()["digest"] != root["digest"] and pairs.digest(df.limit(429)).first()["digest"] != root["digest"]
    found = {(r["level"], r["node"]) for r in pairs.differing(pairs.digest_tree(df), other).collect()}
    own = [hashlib.sha256(json.dumps(dict(zip("abc", r)), separators=(",", ":")).encode()).hexdigest() for r in (rows[77], (77, "text 7?", None))]
    assert found == {(0, "")} | {(level, h[:width]) for h in own for level, width in ((1, 1), (2, 3), (3, 5))}
    assert pairs.digest(df.limit(0)).first() == (0, "")


def test_few_records_are_held_at_once():
    n = 10_000
    lines = pa.RecordBatch.from_pydict({"value": [f"a{k}\tb" for k in range(n)], "file": ["f"] * n, "start": [0] * n, "inside": [False] * n, "before": [0] * n})
    found = list(scan.recorded(iter([lines])))
    assert max(b.num_rows for b in found) <= scan.ROWS < n
    assert [c for b in found for c in b.column("cells").to_pylist()] == [[f"a{k}", "b"] for k in range(n)]
