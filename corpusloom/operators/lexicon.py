"""Word pairs of parallel texts by expectation maximisation, for prompts that show the words' own translations.

The model gives each target word of a pair of texts to one of the source words, by p(target | source). A round works out for each target
word how likely each source word of its pair is (p, over the sum of p in the pair), adds this up by pair of words, and divides by the
source word's sum; p is even at first.

The words that meet are as many as the product of a pair's words, so they are never stored or shuffled. Target words are dealt to shards
by hash, with the source text of their pair. All that a round adds up for a target word is in its shard but the source words' sums: a
shard gives those, one a word, and gets them back over all shards. From them it works out the rounds before once more, so nothing is
kept between two rounds but these sums. In the last round it gives its greatest counts for each source word, too, so that of what is
ranked in the end only words above the least of them are shuffled. There are twice as many shards as cores, or more, so that a shard has
MEETINGS_OF_SHARD words that meet (a single target word's may be more: it is one shard's, as numbers of four bytes). At once, MEETINGS of
them are held.

Words are maximal runs without white space, lower-cased. Texts that are null or without words add nothing; repeated pairs of texts count
each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from .lineage import checkpointed

SALTS, MEETINGS_OF_SHARD, MEETINGS = 64, 32_000_000, 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{T.WS}+"), lambda w: w != "")


def dealt(rows: DataFrame, source: str, target: str) -> DataFrame:
    """shard, s, t: the source words of a pair of texts, and those of its target words that belong to the shard, joined by blanks."""
    rows = rows.select(words(F.col(source)).alias("s"), words(F.col(target)).alias("t")).where((F.size("s") > 0) & (F.size("t") > 0))
    rows = checkpointed(rows.select(F.array_join("s", " ").alias("s"), F.array_join("t", " ").alias("t"), (F.size("s").cast("long") * F.size("t")).alias("n")), "pairs")
    shards = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-(rows.agg(F.sum("n")).first()[0] or 0) // MEETINGS_OF_SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                out = []
                for s, t in zip(*(whole.column(c).slice(k, 256).to_pylist() for c in ("s", "t")), strict=True):
                    own: dict[int, list[str]] = {}
                    for w in t.split(" "):
                        own.setdefault(zlib.crc32(w.encode()) % shards, []).append(w)
                    out += [(shard, s, " ".join(x)) for shard, x in own.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)], ["shard", "s", "t"])

    return rows.select("s", "t").mapInArrow(deal, "shard int, s string, t string")


def coded(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts as numbers in a row, how many each text has, and the words by number."""
    lists = [pc.split_pattern(part, " ") for part in texts.chunks]
    found = pa.chunked_array([x.flatten().dictionary_encode() for x in lists]).unify_dictionaries()
    return np.concatenate([c.indices.to_numpy() for c in found.chunks]), np.concatenate([pc.list_value_length(x).to_numpy() for x in lists]).astype(np.int64), found.chunk(0).dictionary


def counts(table: pa.Table, totals: pa.Table, rounds: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Source words, target words (both by number), and s, t, c of words that meet in a shard: how often each source word is expected to
    make each target word in the last round. totals: s and the list of its sums in the rounds before. All of a target word comes at once."""
    (s, n_s, sources), (t, n_t, targets) = coded(table["s"]), coded(table["t"])
    sums = np.zeros((rounds - 1, len(sources)))
    if rounds > 1:
        at = pc.index_in(totals["s"].combine_chunks(), sources).to_numpy()
        sums[:, at] = totals["totals"].combine_chunks().flatten().to_numpy().reshape(-1, rounds - 1).T
    begin = np.cumsum(n_s) - n_s
    # A target word in a pair, by word; how often it is there.
    key, often = np.unique(t.astype(np.int64) * len(n_t) + np.repeat(np.arange(len(n_t)), n_t), return_counts=True)
    word, pair = key // len(n_t), key % len(n_t)
    upto = np.cumsum(n_s[pair])
    ends = np.append(np.flatnonzero(np.diff(word)) + 1, len(word))  # behind the last place of each target word
    low = 0
    while low < len(word):
        done = upto[low - 1] if low else 0
        high = int(ends[max(np.searchsorted(upto[ends - 1], done + MEETINGS, side="right") - 1, np.searchsorted(ends, low, side="right"))])
        alone = word[high - 1] == word[low]  # a word of which any number meets is added up by source word, in steps
        edges = [low]
        while edges[-1] < high:
            edges.append(max(edges[-1] + 1, int(np.searchsorted(upto, (upto[edges[-1] - 1] if edges[-1] else 0) + MEETINGS, side="right"))) if alone else high)
            edges[-1] = min(edges[-1], high)
        slots = None

        def met(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = n_s[pair[a:b]]
            starts = np.cumsum(n) - n
            return s[np.repeat(begin[pair[a:b]] - starts, n) + np.arange(n.sum())], n, starts

        if alone:
            own_s, own_t = np.arange(len(sources)), np.full(len(sources), word[low])
        else:
            of_s, n, _ = met(low, high)
            keys, slots = np.unique(np.repeat(word[low:high], n) * len(sources) + of_s, return_inverse=True)
            own_s, own_t = keys % len(sources), keys // len(sources)
        p = np.ones(len(own_s))
        for k in range(rounds):
            c = np.zeros(len(own_s))
            for a, b in zip(edges, edges[1:], strict=False):
                of_s, n, starts = met(a, b)
                at = of_s if alone else slots
                c += np.bincount(at, p[at] * np.repeat(often[a:b] / np.add.reduceat(p[at], starts), n), len(own_s))
            if k < rounds - 1:
                p = np.divide(c, sums[k][own_s], out=np.zeros_like(c), where=c > 0)
        good = c > 0
        yield sources, targets, own_s[good], own_t[good], c[good]
        low = high


def greatest(best: np.ndarray, s: np.ndarray, c: np.ndarray) -> None:
    """Puts counts of source words into the greatest ones so far, a row a word."""
    k = best.shape[1]
    order = np.lexsort((-c, s))
    s, c = s[order], c[order]
    first = np.flatnonzero(np.diff(s, prepend=-1))
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    new = np.zeros((len(first), k))
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
    new[own[rank < k], rank[rank < k]] = c[rank < k]
    best[s[first]] = -np.sort(-np.concatenate([best[s[first]], new], 1), 1)[:, :k]


def _run(table: DataFrame, totals: DataFrame, f, schema: str) -> DataFrame:
    empty = _empty(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return f(a, b) if a.num_rows else empty

    return table.groupBy("shard").cogroup(totals.groupBy("shard")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.table({c: pa.array([], kinds[kind]) for c, kind in (x.split(" ") for x in schema.split(", "))})


def summed(table: DataFrame, rounds: int, k: int) -> DataFrame:
    """shard, s, totals (of all rounds), least: the k-th greatest count of a source word in the last round, 0 where less words meet it."""
    spark = table.sparkSession
    totals, where = spark.createDataFrame([], "shard int, s string, totals array<double>"), None

    def sums(r: int):
        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            got = None
            for sources, _, s, _, c in counts(a, b, r):
                if got is None:
                    got, best = np.zeros(len(sources)), np.zeros((len(sources), k))
                got += np.bincount(s, c, len(sources))
                if r == rounds:
                    greatest(best, s, c)
            shard = pa.array(np.full(len(sources), a["shard"][0].as_py(), np.int32))
            most = pa.ListArray.from_arrays(pa.array(np.arange(len(sources) + 1, dtype=np.int32) * k), pa.array(best.ravel()))
            return pa.table({"shard": shard, "s": sources, "c": pa.array(got), "most": most})

        return run

    so_far = None
    for r in range(1, rounds + 1):
        found = checkpointed(_run(table, totals, sums(r), "shard int, s string, c double, most array<double>"), "sums")
        where = found.select("shard", "s") if where is None else where
        # As many rows a word as there are shards.
        least = F.element_at(F.reverse(F.array_sort(F.flatten(F.collect_list("most")))), k) if r == rounds else F.lit(0.0)
        total = found.groupBy("s").agg(F.sum("c").alias("c"), least.alias("least"))
        so_far = total.select("s", F.array("c").alias("totals"), "least") if so_far is None else so_far.drop("least").join(total, "s").select("s", F.concat("totals", F.array("c")).alias("totals"), "least")
        so_far = checkpointed(so_far, "totals")
        totals = where.join(so_far, "s").select("shard", "s", "totals", "least")
    return totals


def _ranked(table: DataFrame, totals: DataFrame, rounds: int, k: int | None, digits: int | None) -> DataFrame:
    """s, t, p of words that meet; with a k, all that may be of the k likeliest of a source word, by p to some digits."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        last = np.zeros(0)
        out, before = [], pa.table({"s": b["s"], "totals": pa.chunked_array([pa.array([x[:-1] for x in part.to_pylist()], pa.list_(pa.float64())) for part in b["totals"].chunks], pa.list_(pa.float64()))})
        for sources, targets, s, t, c in counts(a, before, rounds):
            if not len(last):
                at = pc.index_in(sources, b["s"].combine_chunks()).to_numpy()
                last = b["totals"].combine_chunks().flatten().to_numpy().reshape(-1, rounds)[at, -1]
                least = b["least"].combine_chunks().to_numpy()[at]
                if k:
                    least = np.round(least / last, digits)
            p = c / last[s]
            if k:
                p = np.round(p, digits)
                good = p >= least[s]
                s, t, p = s[good], t[good], p[good]
            out.append(pa.table({"s": sources.take(pa.array(s)), "t": targets.take(pa.array(t)), "p": pa.array(p)}))
        return pa.concat_tables(out)

    return _run(table, totals, run, "s string, t string, p double")


def translations(rows: DataFrame, source: str, target: str, rounds: int = 5) -> DataFrame:
    """s, t, p of all words that meet, after some rounds: as many rows as that."""
    table = dealt(rows, source, target)
    return _ranked(table, summed(table, rounds, 1), rounds, None, None)


def likeliest(rows: DataFrame, source: str, target: str, rounds: int, k: int, digits: int = 9) -> DataFrame:
    """word_pairs of the translations, of which no others are shuffled than those that may be among them."""
    table = dealt(rows, source, target)
    return word_pairs(_ranked(table, summed(table, rounds, k), rounds, k, digits), k, digits)


def word_pairs(p: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """s, t, p, rank: the k most likely words for each source word, by p to some digits, ties by the word."""
    rows = p.withColumn("p", F.round("p", digits))
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.col("p").desc(), "t"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def pair_lines(rows: DataFrame, row_id: str, source: str, best: DataFrame) -> DataFrame:
    """row_id, word_pairs: `word → translation` of the words of a text in order, each once, joined by bars. best: s, t of one
    translation a word."""
    at = rows.select(row_id, F.posexplode(F.array_distinct(words(F.col(source)))).alias("at", "s"))
    # A frequent word meets its translation once for each salt.
    at = at.withColumn("salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)))
    near = at.select("s", "salt").distinct().join(best.select("s", "t"), "s")
    found = at.join(near, ["s", "salt"]).groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("at", F.concat("s", F.lit(" → "), "t").alias("x")))).alias("x"))
    return found.select(row_id, F.array_join(F.transform("x", lambda x: x["x"]), " | ").alias("word_pairs"))
