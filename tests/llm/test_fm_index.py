from collections import Counter

import numpy as np

from corpusloom.llm.fm_index import FMIndex, WaveletTree, next_smaller, suffix_order


def joined(parts):
    sizes = np.array([len(p) for p in parts])
    return np.concatenate([np.append(p, 0) for p in parts]), np.cumsum(sizes + 1) - (sizes + 1), sizes


def counted(parts, weights, longest):
    """Matching statistics by a table of all n-grams."""
    seen = Counter()
    for p, k in zip(parts, weights):
        for n in range(1, longest + 1):
            for i in range(len(p) - n + 1):
                seen[tuple(p[i : i + n])] += k
    out = []
    for p in parts:
        for i in range(len(p)):
            n = 0
            while n < longest and i + n < len(p) and seen[tuple(p[i : i + n + 1])] >= 2:
                n += 1
            out.append(n)
    return out


def test_matching_statistics_are_those_counted():
    r = np.random.default_rng(0)
    for t in range(120):
        sigma, longest = r.choice([2, 3, 6, 50, 300]), int(r.integers(1, 20))
        parts = [r.integers(1, sigma, r.integers(0, 60)) for _ in range(r.integers(1, 8))]
        parts += [p[r.integers(0, 5) :] for p in parts[:2]]
        weights = r.integers(1, 3, len(parts)) if t % 2 else np.ones(len(parts), int)
        text, starts, sizes = joined(parts)
        index = FMIndex(text, int(text.max()) + 1, longest, np.repeat(weights, sizes + 1))
        assert index.matching_statistics(starts, sizes).tolist() == counted(parts, weights, longest)


def test_suffixes_are_in_order_and_know_what_they_share():
    r = np.random.default_rng(2)
    text = np.concatenate([r.integers(0, 3, 200), np.ones(70, int), r.integers(0, 3, 50)])
    for depth in (1, 5, 64, 100):
        order, common = suffix_order(text, depth)
        heads = [tuple(text[i : i + depth]) for i in order]
        assert heads == sorted(heads) and sorted(order) == list(range(len(text)))
        for k in range(1, len(text)):
            n = next((i for i, (a, b) in enumerate(zip(heads[k - 1], heads[k])) if a != b), min(len(heads[k - 1]), len(heads[k])))
            assert common[k] == n


def test_ranks_and_smaller_neighbours_are_those_of_loops():
    r = np.random.default_rng(3)
    values = np.minimum(r.geometric(0.3, 500), 40) - 1
    tree = WaveletTree(values, 41)
    used, at = np.unique(values), r.integers(0, 501, 300)
    symbols = r.choice(used, 300)
    assert tree.rank(symbols, at).tolist() == [int((values[:a] == s).sum()) for s, a in zip(symbols, at)]
    entropy = -sum(p * np.log2(p) for p in np.bincount(values)[used] / 500)
    assert sum(tree.lengths[v] for v in values) <= 500 * (entropy + 1)
    left, right = next_smaller(values)
    for k, v in enumerate(values):
        assert left[k] == max((i for i in range(k) if values[i] < v), default=-1)
        assert right[k] == min((i for i in range(k + 1, 500) if values[i] < v), default=500)
