"""Exact cosine neighbours without comparing all pairs: an index of cells around spherical centroids, pruned by the triangle inequality.

Angles between unit vectors are a metric, so with c the centroid of a row's cell, angle(q, row) is at least |angle(q, c) - angle(row, c)|.
Cells that are near each other share a block of about BLOCK_ROWS rows; a cell of more rows is dealt to several blocks by hash. A query
first meets the block of its nearest cell, and the k-th best angle found there is a limit; it then meets only the other blocks in which a
cell's bound is below that. Within a block, rows lie by cell and angle in slabs of FIRST_ROWS at most, nearest ones first, and a query
leaves out each slab whose bound is above its k-th best angle so far. Nothing depends on how good the centroids are but the work: the
result is that of all pairs. Vectors that are spread evenly over a sphere of many dimensions, where no two are near, leave no slab out;
vectors with any structure do.

What is shuffled is a vector for each query and block it meets, and for each row and BLOCK_ROWS queries its block attracts; slabs and
pairs exist within a task only, which holds BLOCK_ROWS rows of both sides and PAIRS scores at most.

Centroids are fitted on SAMPLE_ROWS rows at most, chosen by hash; every row is indexed. There are CELLS of them at most, shipped to tasks.

Vectors that are null or zero or hold NaN match nothing. Scores are rounded to DIGITS digits, so that equal vectors tie; ties go by row_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources import artifacts
from corpusloom.sources.tables import spread

from .lineage import checkpointed
from .retrieve import best_of

SAMPLE_ROWS, CELLS, BLOCK_ROWS, FIRST_ROWS, PAIRS, DIGITS = 50_000, 1024, 50_000, 500, 250_000, 9
#: What angles may be off by, as the angle of nearly equal vectors is known to the root of a double's precision only.
SLACK = 1e-6


def unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of a column, and where they come from; those without a direction are left out."""
    rows = np.flatnonzero(vectors.notna().to_numpy())
    if not len(rows):
        return np.zeros((0, 1)), rows
    v = np.stack(vectors.to_numpy()[rows]).astype(np.float64)
    length = np.sqrt((v * v).sum(1))
    good = np.isfinite(length) & (length > 0)
    return v[good] / length[good, None], rows[good]


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def centroids(rows: DataFrame, vector: str, cells: int | None = None) -> np.ndarray:
    """Unit centroids fitted on a sample of bounded size; four times the root of the rows, CELLS at most, unless given."""
    good = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    good = good.where(F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x).between(1e-300, 1e300))  # NaN is greater than all
    n = good.count()
    if not n:
        return np.zeros((0, 1))
    # Sorted rows come out as one part, so they are dealt to the cores again.
    sample = spread(checkpointed(good.orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS), "sample")).select(array_to_vector("v").alias("features"))
    k = min(cells or int(np.ceil(4 * np.sqrt(n))), CELLS, n)
    if k == 1:
        found = [sample.first()["features"].toArray()]
    else:
        found = KMeans(k=k, maxIter=4, seed=1, initMode="random", distanceMeasure="cosine").fit(sample).clusterCenters()
    return unit(pd.Series(list(found)))[0]


def placed(rows: DataFrame, row_id: str, vector: str, centers: np.ndarray) -> DataFrame:
    """i, v (unit vectors), cell, angle of each row with a direction."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for s in range(0, len(whole), FIRST_ROWS):
                frame = whole.iloc[s : s + FIRST_ROWS]
                v, at = unit(frame["v"])
                if len(at):
                    cell, own = nearest_cell(v, centers)
                    yield pd.DataFrame({"i": frame["i"].to_numpy()[at], "v": list(v), "cell": cell.astype(np.int32), "angle": own})

    return rows.select(F.col(row_id).cast("long").alias("i"), F.col(vector).alias("v")).mapInPandas(place, "i long, v array<double>, cell int, angle double")


def nearest_cell(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and its angle to the centroid."""
    cosine = v @ centers.T
    cell = cosine.argmax(1)
    return cell, np.arccos(np.clip(cosine[np.arange(len(v)), cell], -1, 1))


def in_order(centers: np.ndarray) -> np.ndarray:
    """The centroids' numbers, halved again and again along the direction in which they are spread most, so that near ones are close."""

    def halves(at: np.ndarray) -> list[int]:
        if len(at) <= 2:
            return at.tolist()
        x = centers[at] - centers[at].mean(0)
        order = at[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        return halves(order[: len(at) // 2]) + halves(order[len(at) // 2 :])

    return np.array(halves(np.arange(len(centers))), np.int64)


class Index:
    """Placed rows, stored, with the bounds of their cells. blocks: cell, n, low, high, block (the first one) and parts (how many)."""

    def __init__(self, rows: DataFrame, centers: np.ndarray):
        self.rows, self.centers = rows, centers
        # A row a cell: bounded whatever the index.
        found = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toPandas()
        place = np.zeros(len(centers), np.int64)
        if len(centers):
            place[in_order(centers)] = np.arange(len(centers))
        self.blocks = found.iloc[np.argsort(place[found["cell"].to_numpy(np.int64)])].reset_index(drop=True)
        first, parts, block, held = [], [], 0, 0
        for n in self.blocks["n"]:
            if held and held + n > BLOCK_ROWS:
                block, held = block + 1, 0
            first.append(block)
            parts.append(max(1, -(-int(n) // BLOCK_ROWS)))
            block, held = (block + parts[-1], 0) if parts[-1] > 1 else (block, held + n)
        self.blocks["block"], self.blocks["parts"] = np.array(first, np.int32), np.array(parts, np.int32)

    @property
    def size(self) -> int:
        return int(self.blocks["n"].sum())


def indexed(rows: DataFrame, row_id: str, vector: str = "embedding", cells: int | None = None) -> Index:
    centers = centroids(rows, vector, cells)
    empty = rows.sparkSession.createDataFrame([], "i long, v array<double>, cell int, angle double")
    return Index(checkpointed(placed(rows, row_id, vector, centers), "cells") if len(centers) else empty, centers)


def write(index: Index, path: str) -> None:
    """The placed rows as Parquet and the centroids beside them."""
    index.rows.write.parquet(f"{path}/rows")
    artifacts.write_json(index.rows.sparkSession, f"{path}/centroids.json", index.centers.tolist())


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/rows"), np.array(artifacts.read_json(spark, f"{path}/centroids.json")))


def _bounds(angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least angle there can be between a query and rows of a cell, from its angle to the centroid and their least and greatest ones."""
    return np.maximum(0, np.maximum(angle - high, low - angle)) - SLACK


def _visits(queries: DataFrame, index: Index, again: bool) -> DataFrame:
    """q, v, block, least: the blocks that a query meets, at first that of its nearest cell, then all others with a cell below its limit,
    and the score that it needs there."""
    low, high, first, parts = (index.blocks[c].to_numpy() for c in ("low", "high", "block", "parts"))
    centers = index.centers[index.blocks["cell"].to_numpy(np.int64)]
    cell_of = np.repeat(np.arange(len(parts)), parts)  # each part of each cell, with its block
    block_of = np.repeat(first, parts) + np.arange(len(cell_of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.flatnonzero(np.diff(block_of, prepend=-1))  # blocks are numbered in the order of the cells

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for s in range(0, len(whole), FIRST_ROWS):
                frame = whole.iloc[s : s + FIRST_ROWS]
                v, at = unit(frame["v"])
                if not len(at):
                    continue
                least = frame["least"].to_numpy()[at]
                bound = _bounds(angles(v, centers), low, high)
                home = first[bound.argmin(1)]
                if again:
                    row, block = np.nonzero(np.minimum.reduceat(bound[:, cell_of], starts, axis=1) <= frame["limit"].to_numpy()[at, None])
                    other = block != home[row]
                    row, block = row[other], block[other]
                else:
                    row, block = np.arange(len(at)), home
                if len(row):
                    yield pd.DataFrame({"q": frame["q"].to_numpy()[at][row], "v": list(v[row]), "block": block.astype(np.int32), "least": least[row]})

    return queries.mapInPandas(visit, "q long, v array<double>, block int, least double")


def _within(q: np.ndarray, x: np.ndarray, least: np.ndarray, i: np.ndarray, y: np.ndarray, slabs: list[tuple[np.ndarray, np.ndarray, float, float]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """q, i, score of the k best rows of each query whose score is its least or more, and how many pairs were compared. slabs: the rows of
    each, ascending in i, its centroid, and the least and greatest angle to that."""
    bound = np.stack([_bounds(angles(x, c[None])[:, 0], low, high) for _, c, low, high in slabs], 1)
    least, met = least.copy(), 0
    at, rows, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the best so far, by query, score and i
    for slab in np.argsort(bound.mean(0), kind="stable"):
        mine = slabs[slab][0]
        asks = np.flatnonzero(bound[:, slab] <= np.arccos(np.clip(least - 10.0**-DIGITS, -1, 1)))
        if not len(asks):
            continue
        met += len(asks) * len(mine)
        scores = x[asks] @ y[mine].T
        a, b = np.nonzero(scores >= least[asks, None] - 10.0**-DIGITS)
        if len(a) > 2 * k * len(asks):  # all of a slab at first, or many equal ones
            b = best_of(np.round(scores, DIGITS), k)
            a, b = np.repeat(np.arange(len(asks)), b.shape[1]), b.ravel()
        found = np.round(scores[a, b], DIGITS)
        good = found >= least[asks[a]]
        if not good.any():
            continue
        at, rows, score = np.concatenate([at, asks[a[good]]]), np.concatenate([rows, i[mine[b[good]]]]), np.concatenate([score, found[good]])
        order = np.lexsort((rows, -score, at))
        at, rows, score = at[order], rows[order], score[order]
        begins = np.searchsorted(at, np.arange(len(q)))
        rank = np.arange(len(at)) - begins[at]
        last = rank == k - 1
        least[at[last]] = np.maximum(least[at[last]], score[last])
        at, rows, score = at[rank < k], rows[rank < k], score[rank < k]
    return q[at], rows, score, met


def _found(visits: DataFrame, index: Index, k: int) -> DataFrame:
    """q, i, score: the k best of each query in each block that it meets; and rows without q and i whose score is a number of pairs compared."""
    spark = visits.sparkSession
    cells = spark.createDataFrame(index.blocks[["cell", "block", "parts"]].astype("int32"), "cell int, first int, parts int")
    asked = visits.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("shares"))  # a row a block
    left = visits.join(F.broadcast(asked), "block").select("q", "v", "block", "least", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int").alias("share"))
    right = index.rows.join(F.broadcast(cells), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
    right = right.join(F.broadcast(asked), "block").select("i", "v", "cell", "angle", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    centers = index.centers

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"q": [], "i": [], "score": []}).astype({"q": "Int64", "i": "Int64", "score": "float64"})]
        if len(a) and len(b):
            x, y, q, i, least = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), a["q"].to_numpy(), b["i"].to_numpy(), a["least"].to_numpy()
            cell, angle = b["cell"].to_numpy(), b["angle"].to_numpy()
            order, slabs = np.lexsort((i, angle, cell)), []
            for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                for s in range(0, len(own), FIRST_ROWS):
                    slab = own[s : s + FIRST_ROWS]
                    slabs.append((slab[np.argsort(i[slab], kind="stable")], centers[cell[slab[0]]], angle[slab[0]], angle[slab[-1]]))
            step = max(1, PAIRS // FIRST_ROWS)
            near = np.argsort(nearest_of(x, centers), kind="stable")  # queries that are near each other leave out the same slabs
            for s in range(0, len(near), step):
                own = near[s : s + step]
                got_q, got_i, score, met = _within(q[own], x[own], least[own], i, y, slabs, k)
                parts += [pd.DataFrame({"q": got_q, "i": got_i, "score": score}), pd.DataFrame({"q": [None], "i": [None], "score": [float(met)]})]
        return pd.concat([p.astype({"q": "Int64", "i": "Int64"}) for p in parts])

    key = ["block", "share"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(nearest, "q long, i long, score double")


def nearest_of(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    place = np.argsort(in_order(centers))
    return np.concatenate([place[nearest_cell(x[s : s + FIRST_ROWS], centers)[0]] for s in range(0, len(x), FIRST_ROWS)])


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "i"))
    return found.where("q IS NOT NULL").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int, query_id: str, vector: str = "embedding") -> tuple[DataFrame, float]:
    """(query_id, row_id, rank, score of the k nearest rows of each query; the share of all pairs that was compared). Equal query_ids
    are one query, whose vectors must be equal."""
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    if not index.size:
        return queries.sparkSession.createDataFrame([], "query_id long, row_id long, rank long, score double"), 0.0
    asked = checkpointed(asked.dropDuplicates(["q"]), "queries")
    none = F.lit(-2.0).alias("least")
    first = checkpointed(_found(checkpointed(_visits(asked.select("q", "v", none), index, again=False), "home-block"), index, k), "first-found")
    # Less than k rows so far: nothing bounds the angle.
    enough = F.count("*") >= k
    limit = first.where("q IS NOT NULL").groupBy("q").agg(F.when(enough, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
    limit = limit.withColumn("limit", F.when(F.col("least") < -1.5, F.lit(4.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") - F.lit(10.0**-DIGITS))))))
    others = checkpointed(_visits(asked.join(limit, "q"), index, again=True), "other-blocks")
    every = first.unionByName(checkpointed(_found(others, index, k), "other-found"))
    out = _best(every, k)
    share = (every.where("q IS NULL").agg(F.sum("score")).first()[0] or 0) / max(1, asked.count() * index.size)
    return out.select(F.col("q").alias("query_id"), F.col("i").alias("row_id"), "rank", "score"), share
