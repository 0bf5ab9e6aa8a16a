import random

import numpy as np
import xxhash

from corpusloom.llm import simhash

SCHEMA = "doc_id long, text string"


def slow(text, n=4):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_trie_join_is_brute_force():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 60, 40, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (40, 12, 3), dtype=np.uint64)
    values = np.unique(np.concatenate([base, (base[:, None] ^ np.bitwise_xor.reduce(flips, 2)).ravel()]))
    got = {(i, j) for a, b in simhash.trie_join(values, values, 1, 4) for i, j in zip(a.tolist(), b.tolist())}
    n = len(values)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if values[i] >> np.uint64(63) == values[j] >> np.uint64(63) and int(values[i] ^ values[j]).bit_count() <= 4}


def test_near_duplicates_are_brute_force(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(9)) for _ in range(r.randrange(80, 200))) for _ in range(25)]
    for t in texts[:25]:
        words = t.split()
        for _ in range(3):
            copy = list(words)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    texts += ["", None, " \n", "one", "one two", "ONE TWO", texts[0]]
    for rows in (1 << 17, 8):
        monkeypatch.setattr(simhash, "NODE_ROWS", rows)
        docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
        got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(docs).collect()}
        fps = [slow(t or "") for t in texts]
        assert got == {i: (f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(fps, classes(fps, 4)))}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "A B C D E F G"), (None, "a b c d e f g"), (5, "other words are here and they differ"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_row", spark.sql("SELECT 1").first()[0] * __import__("pyspark.sql.functions", fromlist=["lit"]).lit(4))
    got = simhash.near_free(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {1, 5, 6}
    assert simhash.near_free(docs.limit(0)).count() == 0
