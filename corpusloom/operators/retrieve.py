"""Exact cosine neighbours in blocks, margin scores, and prompts from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block (of larger tables up to three times as many), scores that a task holds at once, rows of a block that it compares at
#: once, and digits of scores.
BLOCK_ROWS, SCORES, ROWS, DIGITS = 20_000, 1_000_000, 2_000, 12


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest scores of each row, greatest first, the first column at a tie."""
    n = scores.shape[1]
    if k < n:  # all above the k-th greatest, and of those equal to it the first ones
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above, equal = scores > least, scores == least
        taken = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
        at = np.nonzero(taken)[1].reshape(len(scores), k)
    else:
        at = np.tile(np.arange(n), (len(scores), 1))
    order = np.argsort(-np.take_along_axis(scores, at, 1), axis=1, kind="stable")
    return np.take_along_axis(at, order, 1)


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of y that are nearest to each row of x, as (row of x, row of y, cosine); the first row of y at a tie. All have unit length.

    A matrix product in single precision leaves out the rows that can't be among them, by twice what it may be off by. The cosines of the
    others are added up in doubles, in one order whatever the shape of a block, so that equal vectors tie.
    """
    a, b, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least, size, step = np.full(len(x), -np.inf), max(ROWS, k), max(1, SCORES // y.shape[1])
    single, slack = x.astype(np.float32), 2 * (y.shape[1] + 4) * 2.0**-24 + 10.0**-DIGITS
    for s in range(0, len(y), size):
        rough = single @ y[s : s + size].T.astype(np.float32)
        if not s and k < rough.shape[1]:
            least = np.partition(rough, -k, axis=1)[:, -k].astype(np.float64)
        at = np.flatnonzero(rough >= np.nextafter((least - slack).astype(np.float32), np.float32(-np.inf))[:, None])
        if not len(at):
            continue
        one, other = at // rough.shape[1], at % rough.shape[1] + s
        found = [(x[one[c : c + step]] * y[other[c : c + step]]).sum(1) for c in range(0, len(at), step)]
        a, b, score = np.concatenate([a, one]), np.concatenate([b, other]), np.concatenate([score, np.round(np.concatenate(found), DIGITS)])
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        least[a[rank == k - 1]] = score[rank == k - 1]
        a, b, score = a[rank < k], b[rank < k], score[rank < k]
    return a, b, score


def cosine_topk(queries: DataFrame, index: DataFrame, k: int, query_id: str, row_id: str, vector: str = "embedding") -> DataFrame:
    """query_id, row_id, rank (1 is the most similar; ties by row_id), score. Vectors that are null or zero or hold NaN match nothing.

    Blocks of queries meet blocks of the index, BLOCK_ROWS to three times as many rows each, and k neighbours a query leave a pair of blocks.
    """
    n_queries, n_rows = (-(-max(1, n) // min(max(BLOCK_ROWS, n // 8), 3 * BLOCK_ROWS)) for n in (queries.count(), index.count()))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v"), block(query_id, n_queries).alias("qb"), every(n_rows).alias("ib"))
    right = index.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("i"), F.col(vector).alias("v"), block(row_id, n_rows).alias("ib"), every(n_queries).alias("qb"))

    def units(side: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        vectors = side["v"].combine_chunks()
        if not len(vectors):
            return np.zeros(0, np.int64), np.zeros((0, 1))
        sizes = vectors.value_lengths().unique()
        if len(sizes) > 1:
            raise ValueError(f"vectors are not of one length: {sorted(sizes.to_pylist())[:5]}")
        v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), sizes[0].as_py())
        length = np.sqrt((v * v).sum(1))
        good = np.isfinite(length) & (length > 0)
        return side[name].to_numpy()[good], v[good] / length[good, None]

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        (q, x), (i, y) = units(a, "q"), units(b, "i")
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(i):
            order = np.argsort(i, kind="stable")
            same = pd.Series([v.tobytes() for v in y[order]])
            order = order[same.groupby(same).cumcount() < k]  # behind k equal vectors none is among the k nearest
            i, y = i[order], y[order]
            step = max(1, SCORES // max(ROWS, k))
            for s in range(0, len(q), step):
                one, other, score = nearest_rows(x[s : s + step], y, k)
                parts.append((q[s + one], i[other], score))
        kinds = {"q": pa.int64(), "i": pa.int64(), "score": pa.float64()}
        return pa.table({name: pa.array(np.concatenate(c), kind, from_pandas=True) for (name, kind), c in zip(kinds.items(), zip(*parts))})

    # A part for each pair of blocks, which are few and long, so that small tables aren't put together in fewer parts than there are cores.
    left, right = (side.repartition(n_queries * n_rows, "qb", "ib") for side in (left, right))
    found = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInArrow(nearest, "q long, i long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "i"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("i").alias("row_id"), "rank", "score")


def margin_scores(neighbours: DataFrame, backward: DataFrame) -> DataFrame:
    """Adds margin: the cosine over the mean of both sides' mean neighbour cosines. backward: neighbours of the rows, as (query_id =
    row, ...)."""
    own = neighbours.groupBy("query_id").agg(F.avg("score").alias("own"))
    other = backward.groupBy(F.col("query_id").alias("row_id")).agg(F.avg("score").alias("other"))
    out = neighbours.join(own, "query_id").join(other, "row_id")
    return out.withColumn("margin", F.col("score") / ((F.col("own") + F.col("other")) / 2)).drop("own", "other")


def zero_shot_prompt(source: Column) -> Column:
    return F.concat(F.lit("Translate the following text into English:\n\n"), source)


def few_shot_prompt(source: Column, exemplars: Column) -> Column:
    """exemplars: array<struct<input, output>>, most similar first; the prompt has the most similar one last."""
    blocks = F.transform(F.reverse(exemplars), lambda e: F.concat(F.lit("Source: "), e["input"], F.lit("\nEnglish: "), e["output"], F.lit("\n")))
    head = F.array(F.lit("Here are example translations in the required style:\n"))
    tail = F.array(F.lit("Now translate the following text into English in the same style:\n"), F.concat(F.lit("Source: "), source, F.lit("\nEnglish:")))
    return F.array_join(F.concat(head, blocks, tail), "\n")


def word_pair_prompt(word_pairs: Column, source: Column) -> Column:
    """A source behind the line of its words' translations (lexicon.pair_lines); without one where there is none."""
    asked = F.concat(F.lit("Source: "), source, F.lit("\nEnglish:"))
    return F.concat(F.coalesce(F.concat(F.lit("[Word pairs]: "), word_pairs.cast("string"), F.lit("\n")), F.lit("")), asked)


def instruction_prompt(instruction: Column, source: Column) -> Column:
    """The ablation of few_shot_prompt: an instruction and no example."""
    return F.concat(instruction, F.lit("\n\nSource: "), source, F.lit("\nEnglish:"))


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine of two arrays of numbers; null where one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda n, p: n + p)

    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def shot_sweep(neighbours: DataFrame, shots: list[int]) -> DataFrame:
    """The neighbours of each query for every number of shots, from one search for the largest of them."""
    return neighbours.withColumn("shots", F.explode(F.array(*map(F.lit, shots)))).where(F.col("rank") <= F.col("shots"))


def style_rerank(neighbours: DataFrame, distances: DataFrame, weight: float) -> DataFrame:
    """neighbours (query_id, row_id, score, ...) ranked by score less weight times style distance (row_id, style); neighbours without
    a distance go."""
    out = neighbours.join(distances, "row_id").withColumn("value", F.col("score") - F.lit(weight) * F.col("style"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("value").desc(), "row_id"))  # k rows a query
    return out.withColumn("rank", rank.cast("long"))
