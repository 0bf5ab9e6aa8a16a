import random

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import likeness

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(r, n):
    return ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def changed(r, words, n, k):
    """A copy of the words with k of them changed, at least five apart."""
    out = list(words)
    for i in r.sample(range(1, n // 6 - 1), k):
        out[6 * i] = f"new{r.randrange(10**9)}"
    return out


def kept_by_loops(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(rows)) if find(i) == i}


def test_pairs_at_a_similarity_of_0_8_to_0_95_are_linked_and_lesser_ones_are_not(spark):
    r = random.Random(4)
    texts, near, far = [], 0, 0
    for n, k in [(300, k) for k in (2, 3, 4, 5, 5, 6, 6, 6, 7, 8, 9)] * 3 + [(120, 2), (120, 3), (60, 1), (60, 2), (3, 0), (4, 0)]:
        words = prose(r, n)
        copy = changed(r, words, n, k) if k else words
        texts += [" ".join(words), " ".join(copy)]
        j = jaccard(*texts[-2:])
        near, far = near + (0.8 <= j < 0.9), far + (0.7 < j < 0.8)
    assert near >= 10 and far >= 6
    words = prose(r, 200)
    texts += [" ".join(changed(r, words, 200, k)) for k in (1, 2) * 15]  # a group in which not all pairs are alike
    texts += ["", None, " \n", "word", "WORD", texts[0].upper()]
    rows = list(enumerate(texts))
    got = likeness.like_free(spark.createDataFrame(rows, SCHEMA))
    assert {x["doc_id"] for x in got.collect()} == kept_by_loops(rows)


def test_sets_apart_from_the_least_one_of_their_keys_are_compared_too(spark, monkeypatch):
    r = random.Random(8)
    words = prose(r, 200)
    texts = [" ".join(words)] + [" ".join([*words[:60], *tail, *c]) for tail in (prose(r, 140), prose(r, 140)) for c in ([], prose(r, 5))]
    rows = list(enumerate(texts))
    monkeypatch.setattr(likeness, "sketches", lambda docs, n, own=likeness.sketches: own(docs, n).withColumn("keys", F.array(F.lit(1).cast("long"))))
    got = likeness.like_free(spark.createDataFrame(rows, SCHEMA))
    assert {x["doc_id"] for x in got.collect()} == kept_by_loops(rows) == {0, 1, 3}


def test_near_dedup_stage_drops_copies_at_a_similarity_of_0_8(spark):
    r = random.Random(1)
    words = prose(r, 269)
    rows = [(7, " ".join(words)), (302, " ".join([*words[:60], "changed", *words[61:]])), (303, " ".join(changed(r, words, 269, 5))), (304, " ".join(prose(r, 269)))]
    assert 0.8 <= jaccard(rows[0][1], rows[2][1]) < 0.85
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {x["doc_id"] for x in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == {7, 304}


def test_common_shingles_are_those_counted(monkeypatch):
    r = np.random.default_rng(6)
    for entries, frequent in ((1 << 22, 48), (40, 3), (40, 1000)):
        monkeypatch.setattr(likeness, "ENTRIES", entries)
        monkeypatch.setattr(likeness, "FREQUENT", frequent)
        a, b = ([r.choice(60, r.integers(0, 30), replace=False).astype(np.int64) for _ in range(n)] for n in (17, 23))
        sizes = [np.array([len(s) for s in x]) for x in (a, b)]
        got = np.concatenate([common for _, common in likeness.common_shingles(np.concatenate(a), sizes[0], np.concatenate(b), sizes[1])])
        assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_loose_sets_are_compared_in_parts(spark, monkeypatch):
    r = random.Random(12)
    words = prose(r, 150)
    texts = [" ".join(words)]
    for _ in range(30):  # most are below 0.8 to the first, some are near each other
        texts.append(" ".join(changed(r, words, 150, r.choice((2, 4, 5, 6, 7)))))
        texts.append(" ".join(changed(r, texts[-1].split(), 150, 1)))
    rows = list(enumerate(texts))
    for shingles in (1 << 20, 900):
        monkeypatch.setattr(likeness, "PART_SHINGLES", shingles)
        got = {x["doc_id"] for x in likeness.like_free(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == kept_by_loops(rows) and len(got) > 3
