"""Near-duplicates by likeness: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, and what they connect.

Pairs are proposed in two ways. The first is the trie self-join of SimHash fingerprints (see simhash) at DISTANCE bits, whose stars are
taken as pairs; it finds near copies, but only a small part of the pairs at 0.8 to 0.9, whose fingerprints differ in about ten bits.
So each set of shingles is summed up by BANDS keys of WIDTH minima each as well; two sets at similarity J share a key with
probability 1 - (1 - J**WIDTH)**BANDS, which is 1 - 4e-6 at 0.8 and more above. All are compared exactly, in two rounds. First come the
pairs of the trie and each set with the least one of its keys, a pair a set and key. Sets that stay outside of that one's component are loose:
they and all others of their keys make clusters (what keys with loose sets connect), and within a cluster every loose set is
compared with all sets, as near copies somewhat below 0.8 need it. No pair is written for that: a cluster is dealt to parts of about
PART_SHINGLES, each pair of parts is a task, which counts common shingles by a matrix product (frequent ones) and by lists of
the sets that hold one (rare ones), and returns its links as stars. The work of that round still grows with the square of a
cluster's size, at a few operations a pair; no set is dropped from it.

Shingles are those of the fingerprints, told apart by their 64-bit XXH64; a set leaves repeats out.

Defined cases: null and empty texts have an empty set, and equal sets are always together; a text with fewer words than a shingle has
one of all its words, and a very long one a set of all its shingles; which document of a group stays is as in simhash.near_free; an
empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .base import discard, joined_hot, joined_small, joined_texts, partitions, row_keys, slices, stored, text_of
from .components import labels
from .simhash import DISTANCE, Sets, fingerprint_of, found_again, links, place_of, shingle_hashes
from .substrings import mixed

BANDS, WIDTH, SEED = 24, 4, 11
#: The least similarity, as a fraction.
LEAST, OF = 4, 5
#: Shingles that are multiplied at once.
PIECE = 1 << 12
#: Shingles of a part of a cluster, entries of the matrices a task holds at a time, and the sets that hold a frequent shingle.
PART_SHINGLES, ENTRIES, FREQUENT = 1 << 17, 1 << 22, 48

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set; none for the empty one."""
    if not len(own):
        return own
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for a in range(0, len(own), PIECE):
        least = np.minimum(least, (own[a : a + PIECE, None] * _FACTORS).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """place (as it is), fp (the fingerprint), d1 and d2 (128 bits of a digest) and size of the set, keys array<long> of each of rows
    (place, text)."""

    def run(batches):
        for batch in slices(batches, "text"):
            hashes = [np.array(shingle_hashes(x, shingle), np.uint64) for x in batch.column("text").to_pylist()]
            prints = pa.array(np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64))
            sets = [np.unique(h) for h in hashes]
            columns = [pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), k) for s in sets], np.uint64).view(np.int64)) for k in (0, 1)]
            keys = [band_keys(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("place"), prints, *columns, pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["place", "fp", "d1", "d2", "size", "keys"])

    fields = [StructField("fp", LongType()), StructField("d1", LongType()), StructField("d2", LongType()), StructField("size", IntegerType()), StructField("keys", ArrayType(LongType()))]
    return rows.select("place", "text").mapInArrow(run, StructType([rows.schema["place"], *fields]))


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """id, shingles array<long> of rows (id, text)."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = [shingle_set(x, shingle).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return rows.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are at the least similarity or above."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("sizes"))
    return both.where(OF * F.col("common") >= LEAST * (F.col("sizes") - F.col("common"))).select("u", "v")


def common_shingles(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray):
    """Yields, for some rows of a at a time, the first of them and the numbers of shingles each has in common with every set of b;
    a and b: the shingles of all sets in a row."""
    n = len(b_sizes)
    by = np.argsort(b, kind="stable")
    known, first, count = np.unique(b[by], return_index=True, return_counts=True)
    holder = np.repeat(np.arange(n), b_sizes)[by]
    at = np.minimum(np.searchsorted(known, a), len(known) - 1)
    held = known[at] == a
    row = np.repeat(np.arange(len(a_sizes)), a_sizes)
    often = np.flatnonzero(count >= FREQUENT)
    column = np.full(len(known), -1)
    column[often] = np.arange(len(often))
    edges = np.concatenate([[0], np.cumsum(a_sizes)])
    step = max(1, ENTRIES // max(1, n))
    for k in range(0, len(a_sizes), step):
        own = slice(edges[k], edges[min(k + step, len(a_sizes))])
        rows, code = row[own][held[own]] - k, at[own][held[own]]
        height = min(step, len(a_sizes) - k)
        rare = column[code] < 0
        size = count[code[rare]]
        out = np.zeros(height * n, np.float32)
        ends = np.cumsum(size)
        for part in np.split(np.arange(len(size)), np.searchsorted(ends, np.arange(ENTRIES, ends[-1], ENTRIES))) if len(size) else []:
            held_by = holder[np.repeat(first[code[rare][part]] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(size[part].sum())]
            out += np.bincount(np.repeat(rows[rare][part], size[part]) * n + held_by, minlength=len(out))
        out = out.reshape(height, n)
        wide = max(1, ENTRIES // max(n, height))
        for c in range(0, len(often), wide):
            left, right = np.zeros((height, min(wide, len(often) - c)), np.float32), np.zeros((min(wide, len(often) - c), n), np.float32)
            mine = (column[code] >= c) & (column[code] < c + wide)
            left[rows[mine], column[code[mine]] - c] = 1
            some = often[c : c + wide]
            place = np.repeat(first[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(count[some].sum())
            right[np.repeat(np.arange(len(some)), count[some]), holder[place]] = 1
            out += left @ right
        yield k, out


def links_within(members: DataFrame) -> DataFrame:
    """(u, v): stars that connect the sets of each cluster as its similar pairs with a loose set do; members: cluster, parts, id,
    loose, shingles."""
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "loose", "shingles")

    def compare(batches):
        batches = list(batches)  # some pairs of parts of about PART_SHINGLES each
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        cluster, p, q, own, ids, loose = (np.asarray(table[c]) for c in ("cluster", "p", "q", "own", "id", "loose"))
        order = np.lexsort((ids, own, q, p, cluster))
        task = np.stack([cluster, p, q])[:, order]
        edges = np.flatnonzero(np.concatenate([[True], (task[:, 1:] != task[:, :-1]).any(0), [True]]))
        for x, y in zip(edges, edges[1:], strict=False):
            at = order[x:y]
            sets = table["shingles"].take(pa.array(at)).combine_chunks()
            sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
            sizes, values = np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            here = np.arange(len(at))
            one, two = (here[own[at] == part[at[0]]] for part in (p, q))
            free = loose[at]
            jobs = [(one[free[one]], two)] + ([(one[~free[one]], two[free[two]])] if p[at[0]] != q[at[0]] else [])
            joined = Sets(len(at))
            pick = lambda w: values[np.repeat(bounds[w] - (np.cumsum(sizes[w]) - sizes[w]), sizes[w]) + np.arange(sizes[w].sum())]  # noqa: B023, E731
            for a, b in jobs:
                if not len(a) or not len(b):
                    continue
                for k, common in common_shingles(pick(a), sizes[a], pick(b), sizes[b]):
                    total = sizes[a][k : k + len(common), None] + sizes[b][None]
                    i, j = np.nonzero(OF * common >= LEAST * (total - common))
                    joined.link(a[k + i], b[j])
            linked = np.flatnonzero(joined.root != here)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[linked]]), pa.array(ids[at[joined.root[linked]]])], ["u", "v"])

    dealt = rows.repartition(partitions(members.sparkSession), "cluster", "p", "q")
    return dealt.mapInArrow(compare, "u long, v long")


def fitting(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) of pairs with columns m and n, the sizes of the sets: those that can be at the least similarity at all."""
    return pairs.where(OF * F.least("m", "n") >= LEAST * F.greatest("m", "n")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def trie_pairs(distinct: DataFrame) -> DataFrame:
    """u, v, m, n: pairs of sets (id, size, fp) that the trie join connects, each with the first set of its own fingerprint and these
    as their stars do."""
    prints = distinct.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("one"), F.count("*").alias("m"))
    prints = stored(prints.select("fp", F.col("one.id").alias("v"), F.col("one.size").alias("n"), "m"), "fingerprints")
    same = joined_hot(distinct.select(F.col("id").alias("u"), F.col("size").alias("k"), "fp"), prints, ["fp"]).where("u != v").select("u", "v", F.col("k").alias("m"), "n")
    stars = stored(links(prints.select("fp"), DISTANCE), "fingerprint-links").distinct()
    one = prints.select(F.col("fp").alias("u"), F.col("v").alias("a"), F.col("n").alias("m"))
    two = prints.select(F.col("fp").alias("v"), F.col("v").alias("b"), "n")
    near = stars.join(one, "u").join(two, "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "m", "n")
    return same.unionByName(near)


def first_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """k1, k2 of the first row of each group of docs (doc_id, text), stored."""
    marks = sketches(docs.select(place_of(docs).alias("place"), text_of().alias("text")), shingle)
    distinct = marks.groupBy("d1", "d2").agg(F.min("place").alias("place"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "place", "size", "fp", "keys"), "shingle-sets")
    entries = distinct.select("id", "size", F.explode("keys").alias("key"))
    keys = entries.groupBy("key").agg(F.min(F.struct("id", "size")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    keys = stored(keys.select("key", F.col("hub.id").alias("hub"), F.col("hub.size").alias("hub_size"), "m"), "shared-keys")
    members = stored(joined_hot(entries, keys, ["key"]), "key-members")

    hubs = members.where("id != hub").select(F.col("id").alias("u"), F.col("hub").alias("v"), F.col("size").alias("m"), F.col("hub_size").alias("n"))
    first = stored(fitting(hubs.unionByName(trie_pairs(distinct))), "first-pairs")
    texts = docs.select(text_of().alias("text"), *row_keys(docs))

    def sets_of(ids: DataFrame) -> DataFrame:
        places = joined_small(distinct.select("id", "place.k1", "place.k2"), ids, ["id"], "left_semi")
        return shingle_sets(joined_texts(texts, places).dropDuplicates(["k1", "k2"]), shingle)

    sets = stored(sets_of(stored(first.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "paired")), "compared-sets")
    near = stored(alike(first, sets), "alike")
    discard(sets, first)
    found = labels(near)

    # What is left to compare: sets outside the component of their key's least one, with the others of the key.
    named = found.select(F.col("u").alias("id"), F.col("v").alias("group"))
    placed = members.where("m > 2").join(named, "id", "left").withColumn("group", F.coalesce("group", "id"))
    placed = placed.join(named.select(F.col("id").alias("hub"), F.col("group").alias("hub_group")), "hub", "left").withColumn("loose", F.col("group") != F.coalesce("hub_group", "hub"))
    placed = stored(placed.select("key", "id", "size", "hub", "m", "loose"), "placed-members")
    discard(members, keys)
    open_keys = stored(placed.where("loose").groupBy("key").agg(F.max("m").alias("m")), "open-keys")
    some = joined_hot(placed.drop("m"), open_keys, ["key"], "left_semi").groupBy("id").agg(F.max("loose").alias("loose"), F.max("size").cast("long").alias("size"), F.collect_set("hub").alias("hubs"))
    some = stored(some, "loose-members")
    if some.limit(1).count():
        ties = some.select(F.col("id").alias("u"), F.explode("hubs").alias("v")).where("u != v").distinct()
        clusters = labels(ties)
        own = some.join(clusters.select(F.col("u").alias("id"), F.col("v").alias("cluster")), "id", "left").select("id", "loose", "size", F.coalesce("cluster", "id").alias("cluster"))
        parts = stored(own.groupBy("cluster").agg(F.ceil(F.sum("size") / PART_SHINGLES).cast("int").alias("parts"), F.count("*").alias("m")), "clusters")
        dealt = joined_small(own, parts.select("cluster", "parts"), ["cluster"])
        stars = links_within(dealt.join(sets_of(some.select("id")), "id"))
        found = labels(found.unionByName(stored(stars, "cluster-links")))
    named = distinct.select("place", "id").join(found.select(F.col("u").alias("id"), F.col("v").alias("group")), "id", "left")
    best = named.groupBy(F.coalesce("group", "id").alias("group")).agg(F.min("place").alias("place"))
    best = stored(best.select("place.k1", "place.k2"), "first-of-groups")
    discard(distinct, placed, some)
    return best


def like_free(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document of each group, with its own columns."""
    return found_again(docs, first_rows(docs, shingle))
