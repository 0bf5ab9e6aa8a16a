import hashlib
import random
from collections import Counter

import numpy as np

from corpusloom.llm import base, substrings
from corpusloom.llm.fm_index import FMIndex, repeated_windows

SCHEMA = "doc_id long, text string, source string, n_chars long"


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passages = [[r.choice(vocabulary) for _ in range(r.randrange(30, 90))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(r.randrange(1, 5)):
            words += r.choice(passages)[r.randrange(10) :] if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randrange(60))]
        texts.append(r.choice(["", " ", "\n"]) + r.choice([" ", "\t", " \n"]).join(words))
    return [*texts, texts[0], None, "", "  ", "a " * 120, "a b " * 50, "é ü x " * 40]


def test_windows_of_an_index_are_those_counted():
    r = np.random.default_rng(1)
    text = r.integers(1, 4, 400)
    text[[100, 250, 399]] = 0
    index = FMIndex(text, 4, 6)
    starts, ends = np.array([0, 101, 251]), np.array([100, 250, 399])
    seen = Counter(tuple(text[i : i + 6]) for a, b in zip(starts, ends) for i in range(a, b - 5))
    row, at = repeated_windows(index, starts, ends - starts, 6)
    assert set(zip(row.tolist(), at.tolist())) == {(k, i) for k, (a, b) in enumerate(zip(starts, ends)) for i in range(b - a - 5) if seen[tuple(text[a + i : a + i + 6])] > 1}


def test_removed_words_are_those_of_brute_force(spark, monkeypatch):
    for seed, crowd, few in ((1, 1 << 14, 20_000), (2, 1, 20_000), (3, 1, 0)):
        monkeypatch.setattr(substrings, "CROWD", crowd)
        monkeypatch.setattr(base, "BROADCAST_ROWS", few)
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], SCHEMA)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicated(docs).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 35)
        assert sum(x[1] for x in got.values()) > 100


def test_passages_leave_texts_and_clean_rows_stay(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, f"one\n{passage}\ntail  end", "s", 1), (2, f"{passage} two", "s", 2), (3, " clean   text\n", "s", 3), (4, None, "s", 4), (5, passage, "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "_new.row")
    got = {r["doc_id"]: r for r in substrings.without_repeats(docs).collect()}
    assert {k: r["text"] for k, r in got.items()} == {1: "one\ntail  end", 2: "two", 3: " clean   text\n", 4: None}
    assert got[1]["n_chars"] == 13 and got[3]["n_chars"] == 3 and list(got[1].asDict()) == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substrings.deduplicated(docs).count() == 0 and substrings.without_repeats(docs).count() == 0
