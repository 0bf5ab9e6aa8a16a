import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexicon, retrieve


def brute(rows, rounds):
    texts = [((a or "").lower().split(), (b or "").lower().split()) for _, a, b in rows]
    p = defaultdict(lambda: 1.0)
    for _ in range(rounds):
        counts = defaultdict(float)
        for s, t in texts:
            ns, nt = Counter(s), Counter(t)
            for y, m in nt.items():
                total = sum(n * p[x, y] for x, n in ns.items())
                for x, n in ns.items():
                    counts[x, y] += m * n * p[x, y] / total
        total = defaultdict(float)
        for (x, _), c in counts.items():
            total[x] += c
        p = {k: c / total[k[0]] for k, c in counts.items()}
    return p


def corpus():
    r = random.Random(7)
    book = {f"w{k}": f"v{k}" for k in range(25)}
    rows = []
    for k in range(300):
        own = r.sample(sorted(book), r.randrange(1, 7)) + ["The"] * r.randrange(3)
        rows.append((k, " ".join(own), " ".join(r.sample([book.get(w, "le") for w in own], len(own)))))
    return rows + rows[:5] + [(900, None, "v1 v2"), (901, "w1", None), (902, " \n", ""), (903, "w1 w1", "v1\tv1")], book


def test_translations_are_those_of_loops_and_find_the_words(spark):
    rows, book = corpus()
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {(r["s"], r["t"]): r["p"] for r in lexicon.translations(df, "a", "b", 5).collect()}
    assert got == pytest.approx(brute(rows, 5), abs=1e-9)
    best = {r["s"]: r["t"] for r in lexicon.word_pairs(lexicon.translations(df, "a", "b", 5), 1).collect()}
    assert best == book | {"the": "le"}
    assert lexicon.translations(df.limit(0), "a", "b", 2).count() == 0


def test_lines_of_word_pairs_go_into_prompts(spark):
    best = spark.createDataFrame([("w1", "v1"), ("w2", "v2"), ("the", "le")], "s string, t string")
    rows = spark.createDataFrame([(1, "The w2 unknown w1 w2"), (2, "nothing"), (3, None)], "id long, a string")
    got = {r["id"]: r["word_pairs"] for r in lexicon.pair_lines(rows, "id", "a", best).collect()}
    assert got == {1: "the → le | w2 → v2 | w1 → v1"}
    row = rows.where("id = 1").select(retrieve.word_pair_prompt(F.lit("x → y"), F.col("a")).alias("a"), retrieve.word_pair_prompt(F.lit(None), F.col("a")).alias("b"), retrieve.instruction_prompt(F.lit("Do so."), F.col("a")).alias("c")).first()
    assert row["a"] == "[Word pairs]: x → y\nSource: The w2 unknown w1 w2\nEnglish:"
    assert row["b"] == "Source: The w2 unknown w1 w2\nEnglish:" and row["c"] == "Do so.\n\nSource: The w2 unknown w1 w2\nEnglish:"


@pytest.mark.parametrize("held", [7, 1_000_000])
def test_words_that_meet_are_not_shuffled_and_the_likeliest_are_those_of_all(spark, monkeypatch, held):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "id long, a string, b string")
    monkeypatch.setattr(lexicon, "MEETINGS", held)
    p = {k: round(x, 9) for k, x in brute(rows, 3).items()}
    want = {}
    for (s, t), x in p.items():
        want.setdefault(s, []).append((-x, t))
    want = {(s, t, k + 1): pytest.approx(-x, abs=2e-9) for s, own in want.items() for k, (x, t) in enumerate(sorted(own)[:3])}
    assert {(r["s"], r["t"], r["rank"]): r["p"] for r in lexicon.likeliest(df, "a", "b", 3, 3).collect()} == want
    table = lexicon.dealt(df, "a", "b")
    given = lexicon.summed(table, 3, 1)
    assert given.count() == given.select("shard", "s").distinct().count()
    assert lexicon._ranked(table, given, 3, 1, 9).count() < lexicon.translations(df, "a", "b", 3).count() / 2
