"""The queries that build on neighbours, for every row of a table with copies, multiples and vectors that match nothing."""

import numpy as np
import pytest

from corpusloom.functions import text as T
from corpusloom.operators import evaluate, retrieve
from corpusloom.plans import catalog

ROWS = 70


@pytest.fixture(scope="module")
def vectors():
    v = np.random.default_rng(5).normal(size=(ROWS, 6)).astype(np.float32)
    v[31] = v[30]
    v[32] = 2 * v[30]
    v[40:52] = v[40]  # more copies than neighbours
    return v


@pytest.fixture(scope="module")
def folder(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)] + [(90, None, 0), (91, [0.0] * 6, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def nearest(vectors, k):
    """By loops: row to its k nearest ones with their cosines."""
    u = [v / np.sqrt((v * v).sum()) for v in vectors.astype(float)]
    scores = [[round(float((a * b).sum()), 12) for b in u] for a in u]
    return {q: [(i, row[i]) for i in sorted(range(ROWS), key=lambda i: (-row[i], i))[:k]] for q, row in enumerate(scores)}


def test_every_row_gets_a_prompt(spark, folder, vectors, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 30)
    got = {r["query_id"]: r["prompt"] for r in catalog.few_shot_prompts(spark, folder).collect()}
    expected = nearest(vectors, 4)
    assert set(got) == set(range(ROWS))
    for q, prompt in got.items():
        shown = [int(line.removeprefix("Source: row ")) for line in prompt.split("\n") if line.startswith("Source: row ")]
        assert shown == [i for i, _ in reversed(expected[q])] + [q]


def test_every_row_gets_margins(spark, folder, vectors, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 30)
    near = nearest(vectors, 8)
    mean = {q: sum(s for _, s in own) / 8 for q, own in near.items()}
    expected = {}
    for q, own in near.items():
        margins = [(round(s / ((mean[q] + mean[i]) / 2), 12), i) for i, s in own]
        expected[q] = [i for _, i in sorted(margins, key=lambda m: (-m[0], m[1]))]
    got = {}
    for r in sorted(catalog.margin_topk(spark, folder).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["row_id"])
        assert r["margin"] == pytest.approx(dict(near[r["query_id"]])[r["row_id"]] * 2 / (mean[r["query_id"]] + mean[r["row_id"]]), abs=1e-4)
    assert got == expected


def test_every_row_gets_reranked_neighbours(spark, folder, vectors, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 30)
    texts = [f"the {'quick ' * (i % 4)}fox number {'a' * (1 + i % 5)} ran. it {'did ' * (i % 3)}stop now!" for i in range(ROWS)]
    texts[33] = None  # without a distance: no neighbour, but still asks
    rows = [(i, "en" if i % 2 else "de", "s", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{folder}/documents.parquet")
    f = evaluate.featured(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "lang", *T.FEATURES).toPandas().set_index("doc_id")
    center = f[f["lang"] == "en"][list(T.FEATURES)]
    style = np.sqrt((((f[list(T.FEATURES)] - center.mean()) / center.std().clip(lower=1e-9)) ** 2).sum(axis=1)).to_dict()
    near = {q: [(s - 0.01 * style[i], i) for i, s in own if i in style] for q, own in nearest(vectors, 8).items()}
    got = {}
    for r in sorted(catalog.style_rerank(spark, folder).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["row_id"], r["value"]))
    assert set(got) == set(range(ROWS))
    for q, own in got.items():
        value = dict((i, v) for v, i in near[q])
        assert sorted(i for i, _ in own) == sorted(value)
        assert [v for _, v in own] == pytest.approx([value[i] for i, _ in own], abs=1e-4)
        assert [round(value[i], 9) for i, _ in own] == sorted((round(v, 9) for v in value.values()), reverse=True)


def test_vectors_of_unlike_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, [3.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="not of one length"):
        retrieve.cosine_topk(rows, rows, 2, "id", "id").collect()


def test_rows_of_a_block_are_compared_in_parts(vectors, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS", 7)
    monkeypatch.setattr(retrieve, "SCORES", 40)
    u = vectors.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    for k in (1, 4, 13, ROWS, ROWS + 5):
        one, other, score = retrieve.nearest_rows(u, u, k)
        assert list(zip(one.tolist(), zip(other.tolist(), score.tolist()))) == [(q, x) for q, own in nearest(vectors, k).items() for x in own]
