from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import substrings
from corpusloom.llm.fm_index import FMIndex, repeated_windows


def long_runs(seed):
    """Parts of two symbols, one of them rare, so that suffixes agree in far more than 64 symbols; a zero behind each."""
    r = np.random.default_rng(seed)
    return [np.append(np.where(r.random(n) < 0.01, 2, 1), 0) for n in (400, 300, 350, 200)]


def test_suffixes_are_sorted_by_as_many_symbols_as_the_window_has():
    parts = long_runs(3)
    text, sizes = np.concatenate(parts), np.array([len(p) - 1 for p in parts])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    for window in (64, 65, 80, 120, 150):
        seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window))
        want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - window) if seen[tuple(p[i : i + window])] > 1}
        row, at = repeated_windows(FMIndex(text, 3, window), starts, sizes, window)
        assert set(zip(row.tolist(), at.tolist(), strict=True)) == want
    with pytest.raises(ValueError):
        repeated_windows(FMIndex(text, 3, 64), starts, sizes, 65)


def test_words_in_windows_of_over_64_words(spark):
    parts = [p[:-1].tolist() for p in long_runs(5)]
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in p)) for k, p in enumerate(parts)], "doc_id long, text string")
    for window in (65, 150):
        seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
        gone = [{j for i in range(len(p) - window + 1) if seen[tuple(p[i : i + window])] > 1 for j in range(i, i + window)} for p in parts]
        got = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicated(docs, window=window).collect()}
        assert got == {k: len(g) for k, g in enumerate(gone)}
