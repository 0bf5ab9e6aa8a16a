import random
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import base, divergence

PLAIN = str.maketrans(divergence.UPPER, divergence.UPPER.lower())


def brute(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(PLAIN))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= divergence.LEAST_DOCS]
        sources = sorted(s for g, s in groups if g == lang)

        def share(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * len(kept))

        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: [share(counts[lang, s][t], total[s]) for t in kept] for s in sources}
        q = [share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pairs = [(sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [((x - y) ** 2 // (x + y), t) for x, y, t in zip(p[s], q, kept) if counts[lang, s][t] and x > y]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(map(str, out))


def found(df):
    return sorted(map(str, map(tuple, divergence.audited(df).select("lang", "source", "part", "item", "value", "rank").collect())))


def texts():
    r = random.Random(5)
    words = [f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}é" * (k % 4 + 1) for k in range(60)] + ["Été", "ÉTÉ", "日本", "ONE-TWO", "a1b", "I"]
    rows = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else f"s{k % 5}"
        rows.append((("en", "fr", None)[k % 7 % 3], source, " ".join(words[min(len(words) - 1, int(r.expovariate(1 / (8 + k % 5))))] for _ in range(r.randrange(30)))))
    return rows + rows[:30] + [("en", "silent", None), ("en", "blank", " 12 \n"), ("de", "one", "few words"), ("de", "two", ""), ("xx", None, "alone"), (None, None, None)]


@pytest.mark.parametrize("limit", [base.BROADCAST_ROWS, 0])
def test_values_and_ranks_are_those_of_loops(spark, monkeypatch, limit):
    monkeypatch.setattr(base, "BROADCAST_ROWS", limit)
    rows = texts()
    got = found(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert got == brute(rows) and sum("'term'" in g for g in got) > 50


def test_tasks_that_hold_little_give_the_same(spark):
    rows = texts()
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])
    given = pa.Table.from_pylist([dict(zip(schema.names, (x or "" for x in row))) for row in rows], schema)

    def sums(compact, text):
        old = divergence.COMPACT, divergence.TEXT
        divergence.COMPACT, divergence.TEXT = compact, text
        try:
            parts = list(divergence.kept(iter(list(divergence.counted(iter(given.to_batches()))))))
        finally:
            divergence.COMPACT, divergence.TEXT = old
        return sorted(str(tuple(x.values())) for b in parts for x in b.to_pylist())

    assert sums(100, 500) == sums(10**9, 1 << 30)


def test_odd_rows(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    assert found(odd_docs) == brute(rows)
    assert divergence.audited(odd_docs.limit(0)).count() == 0
