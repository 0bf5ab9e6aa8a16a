"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie self-join under a Hamming budget.

Equal fingerprints are put together first. Of two fingerprints that differ in at most `distance` bits, one of distance + 1 blocks
of bits is equal; so for each block the fingerprints are rotated to have it in front, and pairs of nodes below a common node of
that depth are traversed together: they start with no differing bit, each step down adds the bit in which two children differ, and
a pair is dropped when its sum exceeds the budget. Nodes of one block value meet in one task; larger ones than NODE_ROWS
fingerprints are dealt to parts by hash, and every pair of parts is a task of its own. A task returns its links as stars, one
for each fingerprint that is linked, as components need no more; they are then joined to components (see components).

Fingerprint: text with A-Z lowered, words between ASCII white space, shingles of consecutive words joined by a space, repeats
included (fewer words than a shingle: all of them; none: fingerprint zero). A bit is set if it is so in over half the XXH64 hashes.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows share a fingerprint; the id
of a component is the least doc_id in it, null if it has none; a very long text has one fingerprint of all its shingles; near_free keeps the row
with the least doc_id (nulls last, then a hash of the text) of each group and all columns, whatever their names; an empty table
gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .base import discard, joined_small, joined_texts, partitions, row_keys, slices, stored, text_of, whole_row
from .components import labels

SHINGLE, DISTANCE, SEED, NODE_ROWS = 4, 4, 42, 1 << 17
#: Node pairs or pairs of fingerprints that a task holds at a time, and the pairs below a node pair that are compared at once.
FRONTIER, LEAF_PAIRS = 1 << 18, 64

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 of each shingle of the text, repeats included; none if it has no word."""
    words = text.encode().translate(_LOWERED).split()
    if not words:
        return []
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return [digest(b" ".join(words), SEED)]
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    return [digest(whole[a:b], SEED) for a, b in zip(starts[:n], (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return fingerprint_of(np.array(shingle_hashes(text, shingle), np.uint64))


def fingerprint_of(data: np.ndarray) -> int:
    if not len(data):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(data), 1 << 14):
        ones += np.unpackbits(data[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(data), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id (as it is), fp (long, the 64 bits) of each row of docs (doc_id, text)."""

    def run(batches):
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("fp", LongType())]))


def cut(n: int, distance: int) -> list[tuple[int, int]]:
    """First bit (from the top) and width of each of the distance + 1 blocks of n bits."""
    edges = [n * k // (distance + 1) for k in range(distance + 2)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def trie_join(left: np.ndarray, right: np.ndarray, depth: int, distance: int):
    """Yields index pairs (i, j) of sorted uint64 arrays whose values share their first `depth` bits and differ in at most
    `distance` bits. With left is right, each pair of different places comes once."""
    same = left is right

    def children(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Where the second child of each node begins: the first value with bit d set."""
        bit = np.uint64(1) << (np.uint64(63) - d)
        base = a[lo] & ~((bit << np.uint64(1)) - np.uint64(1))
        return np.clip(np.searchsorted(a, base | bit), lo, hi)

    def nodes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = a >> np.uint64(64 - depth)
        first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        return top[first], first, np.append(first[1:], len(a))

    if not len(left) or not len(right):
        return
    lt, l0, l1 = nodes(left)
    rt, r0, r1 = nodes(right)
    _, x, y = np.intersect1d(lt, rt, assume_unique=True, return_indices=True)
    stack = [(l0[x], l1[x], r0[y], r1[y], np.full(len(x), depth, np.uint64), np.zeros(len(x), np.int64))]
    while stack:
        a0, a1, b0, b1, d, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            for part in (slice(0, half), slice(half, None)):
                stack.append(tuple(v[part] for v in (a0, a1, b0, b1, d, err)))
            continue
        size = (a1 - a0) * (b1 - b0)
        leaf = (size <= LEAF_PAIRS) | (d >= 64)
        at = np.flatnonzero(leaf)
        ends = np.cumsum(size[at])
        for group in np.split(at, np.searchsorted(ends, np.arange(FRONTIER, ends[-1], FRONTIER))) if len(at) else []:
            if not len(group):
                continue
            n = size[group]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat((b1 - b0)[group], n)
            i, j = np.repeat(a0[group], n) + k // width, np.repeat(b0[group], n) + k % width
            near = np.bitwise_count(left[i] ^ right[j]) <= distance
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        on = np.flatnonzero(~leaf)
        if not len(on):
            continue
        a0, a1, b0, b1, d, err = (v[on] for v in (a0, a1, b0, b1, d, err))
        am, bm = children(left, a0, a1, d), children(right, b0, b1, d)
        own = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        for u0, u1, v0, v1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (u1 > u0) & (v1 > v0) & (err + more <= distance)
            if same and more and u0 is am:  # a node with itself: its children meet once
                ok &= ~own
            if ok.any():
                stack.append((u0[ok], u1[ok], v0[ok], v1[ok], d[ok] + np.uint64(1), err[ok] + more))


class Sets:
    """Disjoint sets of 0 to n - 1; links come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): stars that connect the stored distinct fingerprints of column fp as their near pairs do."""
    spark = fps.sparkSession
    blocks = cut(64, distance)

    def rotated(first: int) -> F.Column:
        if not first:
            return F.col("fp")
        return F.call_function("shiftleft", F.col("fp"), F.lit(first)).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64 - first)))

    turned = F.array(*(F.struct(F.lit(k).cast("int").alias("block"), rotated(first).alias("turned"), F.shiftrightunsigned(rotated(first), 64 - width).cast("long").alias("node")) for k, (first, width) in enumerate(blocks)))
    rows = fps.select(F.explode(turned).alias("t")).select("t.*")
    counts = rows.groupBy("block", "node").agg(F.count("*").alias("n")).where(F.col("n") > NODE_ROWS)
    heavy = stored(counts.select("block", "node", F.ceil(F.col("n") / NODE_ROWS).cast("int").alias("parts")), "heavy-nodes")
    some = heavy.count()
    if some:  # each large node's rows go to all pairs of parts that have their own part
        rows = joined_small(rows, heavy, ["block", "node"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("turned"), F.col("parts")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("block", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "turned")
    else:
        rows = rows.select("block", "node", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("own"), "turned")

    def join(batches):
        batches = list(batches)  # some nodes of at most NODE_ROWS rows each, or some pairs of parts
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        block, p, q, own = (np.asarray(table[c]) for c in ("block", "p", "q", "own"))
        value = np.asarray(table["turned"]).view(np.uint64)
        task = (block.astype(np.int64) << 40) | (p.astype(np.int64) << 20) | q
        order = np.lexsort((value, task))
        task, own, value, p, q, block = task[order], own[order], value[order], p[order], q[order], block[order]
        edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
        for a, b in zip(edges, edges[1:], strict=False):
            first, width = blocks[block[a]]
            part = value[a:b]
            sets = Sets(len(part))
            if p[a] == q[a]:
                for i, j in trie_join(part, part, width, distance):
                    sets.link(i, j)
            else:
                one, two = np.flatnonzero(own[a:b] == p[a]), np.flatnonzero(own[a:b] == q[a])
                for i, j in trie_join(part[one], part[two], width, distance):
                    sets.link(one[i], two[j])
            at = np.flatnonzero(sets.root != np.arange(len(part)))
            if len(at):
                back = lambda x: ((x >> np.uint64(first)) | (x << np.uint64(64 - first)) if first else x).view(np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(back(part[at])), pa.array(back(part[sets.root[at]]))], ["u", "v"])

    dealt = rows.repartition(partitions(spark), "block", "node", "p", "q")
    return dealt.mapInArrow(join, "u long, v long")


def groups(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Adds group (a fingerprint of the component's, the same for all its rows) and component_id to stored rows (doc_id, fp)."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = labels(links(distinct, distance))
    named = distinct.join(found.select(F.col("u").alias("fp"), F.col("v").alias("group")), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = stored(named.select("fp", "group").join(least, "group"), "groups")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""
    rows = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "simhash")
    out = groups(rows, distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def place_of(docs: DataFrame) -> Column:
    """A struct by which rows are ordered, and found again by their keys: doc_id with nulls last, then the text's hash."""
    own = F.col("doc_id").cast("long")
    k1, k2 = row_keys(docs)
    return F.struct(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), k1, k2)


def found_again(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of docs with the keys of best (k1, k2), one of each, with their own columns."""
    rows = joined_texts(docs.select(whole_row(docs), *row_keys(docs)), best, "left_semi")
    return rows.dropDuplicates(["k1", "k2"]).select("_doc.*")  # dealt and sorted by the join


def near_free(docs: DataFrame, shingle: int = 5, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, with its own columns."""
    found = stored(fingerprints(docs.select(place_of(docs).alias("doc_id"), "text"), shingle), "simhash")
    best = stored(groups(found, distance).select("component_id.k1", "component_id.k2").distinct(), "first-of-groups")
    discard(found)
    return found_again(docs, best)
