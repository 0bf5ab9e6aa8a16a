"""A compressed FM-index over whole numbers, with matching statistics.

The Burrows-Wheeler transform lies in a wavelet tree of the shape of a prefix code: a symbol that makes up a share p of the text has
a code of ceil(-log2 p) bits (canonical, so that the inner nodes of a level are neighbours), so the tree takes less than a bit a symbol
more than the entropy, and frequent symbols are found in few levels. Beside it stand the longest common prefixes of neighbouring
suffixes, up to the depth to which suffixes are sorted, and for each of them the next smaller ones, by which a search gives up
symbols at the end of its match.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by at least their first `depth` symbols, and what neighbours have in common: the symbols, `depth` at most, in which
    each one agrees with the one before it (the first with none). By prefix doubling; only groups of equal prefixes are sorted on."""
    n = len(text)
    bits = int(text.max(initial=0) + 1).bit_length()
    pack = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for k in range(pack):
        key = (key << bits) | np.concatenate([text[k:] + 1, np.zeros(min(k, n), np.int64)])[:n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    slots, new = np.arange(n), np.concatenate([[True], key[1:] != key[:-1]])[:n]
    rank = np.zeros(n + 1, np.int32)  # 1 + the first place of the group; 0 behind the end
    ranks, h = [], pack
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank = rank.copy()
        rank[order[slots]] = slots[first] + 1
        ranks.append((h, rank))
        if h >= depth:
            break
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]  # in the order of their groups
        if not len(slots):
            break
        own = order[slots]
        key = rank[own].astype(np.int64) * (n + 2) + rank[np.minimum(own + h, n)]
        by = np.argsort(key, kind="stable")
        order[slots], key = own[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        h *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    for h, rank in reversed(ranks):
        on = (a < n) & (b < n)
        same = on & (rank[np.minimum(a, n)] == rank[np.minimum(b, n)])
        common += np.where(same, h, 0)
        a, b = np.where(same, a + h, a), np.where(same, b + h, b)
    live = np.flatnonzero(common < depth)
    a, b = a[live], b[live]  # they differ within the next `pack` symbols
    padded = np.append(text, -1)
    for _ in range(pack):
        same = (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        if not same.any():
            break
        live, a, b = live[same], a[same] + 1, b[same] + 1
        common[live] += 1
    return order, np.minimum(np.concatenate([[0], common])[:n], depth)


def next_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before and behind it with a smaller value; the ends are smaller than all."""

    def before(v: np.ndarray) -> np.ndarray:
        at = np.arange(len(v)) - 1
        live = np.flatnonzero((at >= 0) & (v[at] >= v))
        while len(live):
            at[live] = at[at[live]]  # what lies between is not smaller either
            live = live[(at[live] >= 0) & (v[at[live]] >= v[live])]
        return at

    return before(values), len(values) - 1 - before(values[::-1])[::-1]


class WaveletTree:
    """Counts of a symbol before a place of a sequence, for many symbols and places at once."""

    def __init__(self, values: np.ndarray, sigma: int):
        counts = np.bincount(values, minlength=sigma)
        n = max(1, len(values))
        used = np.flatnonzero(counts)
        lengths = np.zeros(sigma, np.int64)
        lengths[used] = np.maximum(1, np.ceil(np.log2(n / counts[used]) - 1e-9)).astype(np.int64)
        self.lengths, self.levels = lengths, int(lengths.max(initial=1))
        by = used[np.argsort(lengths[used], kind="stable")]
        step = np.int64(1) << (self.levels - lengths[by])
        self.codes = np.zeros(sigma, np.int64)  # aligned to the deepest level
        self.codes[by] = np.cumsum(step) - step
        self.words, self.ones, self.first, self.begin, self.begun = [], [], [], [], []
        code, alive = self.codes[values], lengths[values]
        for level in range(self.levels):
            stay = alive > level
            if not stay.all():
                code, alive = code[stay], alive[stay]
            node = code >> (self.levels - level)
            if level:  # within a node of the level above, zeros go before ones; nodes stay in order
                near = node - node.min() if len(node) else node
                by = np.argsort(near.astype(np.uint16) if near.max(initial=0) < 1 << 16 else near, kind="stable")
                code, alive, node = code[by], alive[by], node[by]
            bit = ((code >> (self.levels - 1 - level)) & 1).astype(bool)
            raw = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            raw[: len(packed)] = packed
            words = raw.view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])
            low = int(node[0]) if len(node) else 0
            begin = np.searchsorted(node, np.arange(low, (int(node[-1]) if len(node) else 0) + 2))
            self.words.append(words)
            self.ones.append(ones.astype(np.uint32))
            self.first.append(low)
            self.begin.append(begin)
            self.begun.append(self._ones(level, begin))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        inside = self.words[level][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[level][block].astype(np.int64) + np.bitwise_count(inside)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.copy()
        code, length = self.codes[symbols], self.lengths[symbols]
        live = np.arange(len(at))
        for level in range(self.levels):
            if level and not (on := length > level).all():
                live, code, length = live[on], code[on], length[on]
                if not len(live):
                    break
            node = (code >> (self.levels - level)) - self.first[level]
            begin, own = self.begin[level][node], at[live]
            ones = self._ones(level, begin + own) - self.begun[level][node]
            at[live] = np.where((code >> (self.levels - 1 - level)) & 1, ones, own - ones)
        return at


class FMIndex:
    """text: symbols below sigma; 0 separates its parts. weights: how often each place of the text counts (once without). No match is
    longer than `longest`; longer ones are cut there."""

    def __init__(self, text: np.ndarray, sigma: int, longest: int, weights: np.ndarray | None = None):
        order, common = suffix_order(text, longest)
        self.text, self.n, self.longest = text, len(text), longest
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.wavelet = WaveletTree(text[order - 1], sigma)
        self.weight = np.concatenate([[0], np.cumsum(np.ones(self.n, np.int64) if weights is None else weights[order])])
        self.common = np.append(common, 0)  # of the suffixes k - 1 and k; none at both ends
        if self.n:
            self.common[0] = 0
        self.left, self.right = next_smaller(self.common)
        near = np.arange(self.n + 1)
        bound = self.common < longest - 1
        if self.n:
            bound[0] = bound[-1] = True
        self.short_low = np.maximum.accumulate(np.where(bound, near, 0))
        self.short_high = np.minimum.accumulate(np.where(bound, near, self.n)[::-1])[::-1]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals after one backward step each."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        n, base = len(symbols), self.less[symbols]
        return base + both[:n], base + both[n:]

    def matching_statistics(self, starts: np.ndarray, sizes: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place of the parts of the text (starts, sizes), in a row: the length of the longest match that begins there, ends
        inside of the part and counts `least` times or more in the text.

        All parts are streamed at once, backwards. A match that can't be extended to the left gives up symbols at its end, in steps
        of the suffix tree, so that the interval is kept and the steps add up to the length of a part.
        """
        out = np.zeros(int(sizes.sum()), np.int32)
        base = np.cumsum(sizes) - sizes
        part = np.flatnonzero(sizes > 0)
        at = sizes[part] - 1
        low, high, length = np.zeros(len(part), np.int64), np.full(len(part), self.n, np.int64), np.zeros(len(part), np.int64)
        while len(part):
            full = np.flatnonzero(length == self.longest)
            if len(full):  # the last symbol goes
                high[full] = self.short_high[low[full] + 1]
                low[full] = self.short_low[low[full]]
                length[full] -= 1
            lower, higher = self.extend(self.text[starts[part] + at], low, high)
            good = self.weight[higher] - self.weight[lower] >= least
            low, high, length = np.where(good, lower, low), np.where(good, higher, high), length + good
            done = good | (length == 0)
            out[base[part[done]] + at[done]] = length[done]
            back = np.flatnonzero(~done)
            if len(back):  # to the parent node
                a, b = low[back], high[back]
                one, two = self.common[a], self.common[b]
                length[back] = np.maximum(one, two)
                root = length[back] == 0
                low[back] = np.where(root, 0, np.where(one >= two, self.left[a], a))
                high[back] = np.where(root, self.n, np.where(two >= one, self.right[b], b))
            at = at - done
            on = at >= 0
            if not on.all():
                part, at, low, high, length = part[on], at[on], low[on], high[on], length[on]
        return out


def repeated_windows(index: FMIndex, starts: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of the windows, inside of the parts, that the indexed text holds twice or more."""
    if window > index.longest:
        raise ValueError(f"matches of the index end at {index.longest} symbols, windows have {window}")
    found = np.flatnonzero(index.matching_statistics(starts, sizes) >= window)
    base = np.cumsum(sizes) - sizes
    part = np.searchsorted(base, found, side="right") - 1
    return part, found - base[part]
