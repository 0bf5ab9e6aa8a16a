import numpy as np
import pytest

from corpusloom.operators import cells


def frame(spark, vectors, start=0):
    rows = [(start + k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def brute(queries, rows, k):
    def units(vs):
        out = {}
        for n, v in vs:
            if v is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0:
                out[n] = np.asarray(v, float) / np.linalg.norm(v)
        return out

    a, b = units(queries), units(rows)
    got = {}
    for q, x in a.items():
        best = sorted(((-round(float(x @ y), 9), i) for i, y in b.items()))[:k]
        got[q] = [(i, -s) for s, i in best]
    return got


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["row_id"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)


def clustered(r, n, groups=12, spread=0.15):
    centers = r.normal(size=(groups, 16))
    return [centers[k % groups] / 4 + spread * r.normal(size=16) / 4 for k in range(n)]


def test_clusters_are_pruned_and_the_result_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 40)
    monkeypatch.setattr(cells, "FIRST_ROWS", 20)
    r = np.random.default_rng(3)
    vectors = clustered(r, 900)
    vectors += [vectors[5], vectors[5], vectors[17] * 3, np.zeros(16), np.full(16, np.nan), None, -vectors[4]]
    rows = frame(spark, vectors)
    asked = rows.where("id % 10 = 5")
    index = cells.indexed(rows, "id", "v")
    assert index.size == 904
    got, share = cells.search(asked, index, 5, "id", "v")
    same(found(got), brute([(k, v) for k, v in enumerate(vectors) if k % 10 == 5], list(enumerate(vectors)), 5))
    assert 0 < share < 1 / 3
    # Queries that lie between the clusters, and more neighbours than any ring has.
    other = [r.normal(size=16) for _ in range(20)]
    for k in (1, 60):
        got, _ = cells.search(frame(spark, other, 5000), index, k, "id", "v")
        same(found(got), brute([(5000 + j, v) for j, v in enumerate(other)], list(enumerate(vectors)), k))


def test_even_spread_and_small_tables(spark, tmp_path):
    r = np.random.default_rng(4)
    vectors = list(r.normal(size=(300, 64)))
    rows = frame(spark, vectors)
    index = cells.indexed(rows, "id", "v")
    cells.write(index, str(tmp_path / "index"))
    got, share = cells.search(rows.where("id < 30"), cells.read(spark, str(tmp_path / "index")), 4, "id", "v")
    same(found(got), brute(list(enumerate(vectors))[:30], list(enumerate(vectors)), 4))
    assert share <= 1
    few = frame(spark, [vectors[0], vectors[1]])
    got, _ = cells.search(rows.where("id < 3"), cells.indexed(few, "id", "v"), 5, "id", "v")
    same(found(got), brute(list(enumerate(vectors))[:3], [(0, vectors[0]), (1, vectors[1])], 5))
    nothing = frame(spark, [None, np.zeros(3)])
    assert cells.search(rows, cells.indexed(nothing, "id", "v"), 5, "id", "v")[0].count() == 0
    assert cells.search(nothing, index, 5, "id", "v")[0].count() == 0


def test_a_query_is_shipped_once_a_block_and_not_once_a_cell(spark):
    r = np.random.default_rng(6)
    rows = frame(spark, list(r.normal(size=(3000, 24))))
    index = cells.indexed(rows, "id", "v")
    assert len(index.blocks) > 100 and index.blocks["block"].max() == 0
    asked = rows.where("id < 40").selectExpr("id AS q", "v", "-2D AS least", "4D AS limit")
    assert cells._visits(asked, index, again=False).count() == 40
    assert cells._visits(asked, index, again=True).count() == 0


def test_a_cell_of_many_equal_rows_takes_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 50)
    r = np.random.default_rng(8)
    vectors = [np.ones(8)] * 300 + list(r.normal(size=(100, 8)))
    rows = frame(spark, vectors)
    index = cells.indexed(rows, "id", "v", cells=10)
    assert index.blocks["parts"].max() > 5
    got, _ = cells.search(rows.where("id % 7 = 0"), index, 4, "id", "v")
    same(found(got), brute([(k, v) for k, v in enumerate(vectors) if k % 7 == 0], list(enumerate(vectors)), 4))
