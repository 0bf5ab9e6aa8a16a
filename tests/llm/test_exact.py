import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import exact


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, least, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(map(str, out))


def found(df):
    return sorted(map(str, map(tuple, exact.copies(df).collect())))


def test_copies_are_those_of_loops(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "é"]) for _ in range(r.randrange(4))) for _ in range(150)]
    long = "shared beginning of all these texts, which is longer than a prefix is, and then "
    texts += [long + x for x in ("one end", "an end!", "one  end", "one\t\nend", "one end")] + [long * 3000, long * 3000 + "!", long * 3000]
    rows = [(k * 7 % 1000, t) for k, t in enumerate(texts)] + [(None, "a"), (None, "only without an id"), (None, "only without an id")]
    rows += [(900 + k, "hot text") for k in range(200)] + [(5, "hot text"), (5, "hot text")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd_docs):
    rows = [tuple(x) for x in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == brute(rows)
    kept = exact.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, (x[0] for x in kept.select("doc_id").collect()))) == sorted(str(x[0]) for x in map(lambda s: eval(s), brute(rows)) if x[3])
    assert exact.copies(odd_docs.limit(0)).count() == 0 and exact.without_copies(odd_docs.limit(0)).count() == 0


def test_only_surviving_groups_are_hashed_in_full(spark):
    rows = [(k, "x" * (k + 1)) for k in range(50)] + [(100, "twice"), (101, "twice"), (102, "same length and another prefix"), (103, "another prefix and same length")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lengths, prefixes = exact.surviving(docs)
    marked = exact.brief(exact.measured(docs, [F.col("doc_id")]))
    marked = exact.marked(exact.marked(marked, exact.length_place(), lengths, "a"), exact.prefix_place(), prefixes, "b")
    assert {r["doc_id"] for r in marked.where("a").collect()} == {4, 29, 100, 101, 102, 103}
    assert {r["doc_id"] for r in marked.where("a AND b").collect()} == {100, 101}
