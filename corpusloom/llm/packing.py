"""Best-fit packing: best-fit decreasing with a segment tree over the remaining capacities of open bins.

Documents longer than a sequence are cut into whole sequences and a rest; nothing else is cut. All pieces of the table are packed
together, whatever their number: pieces of one length are alike, so the run of best-fit decreasing over all of them follows from how
many there are of each length (no more than a sequence has tokens). It is worked out on runs of bins of equal room, which a
segment tree over the capacities finds in logarithmic time, and gives a plan of runs: pieces first, first + 1, ... of a length go to
these bins, so many to each, at this offset. The plan's size depends on the capacity, not on the table. Each piece then looks up its
place by its number among those of its length, which is counted in each input partition and added up over them.

Defined cases: a null or empty text is the end id alone; a very long one is cut into as many pieces as it needs; repeated rows, ties
and rows without doc_id are packed like any other; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import slices, stored, text_of
from .tokens import BatchTokenizer


class OpenBins:
    """Runs of open bins by remaining capacity; a segment tree over the capacities finds the tightest that fits in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)  # runs below each node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, first: int, n: int) -> None:
        if not room or not n:
            return
        self.runs[room].append((first, n))
        k = room + self.size
        while k:
            self.open[k] += 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int, int] | None:
        """Removes a run of bins with the least room of at least length: (room, first, number)."""
        count, k = self.open, length + self.size
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until a right neighbour has bins
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return room, *self.runs[room].pop()


def best_fit_plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first, bin, each, offset), sorted, and the number of bins: pieces first, first + 1, ... of a length go to the bins
    from `bin` on, `each` pieces a bin, the first of them at the offset. counts[n]: pieces of length n, 1 to capacity.

    In best-fit decreasing a bin that was the tightest stays so while the same length fits, so a run of equal bins is filled bin by bin.
    """
    plan, rooms, bins = [], OpenBins(capacity), 0
    for length in range(capacity, 0, -1):
        done, n = 0, int(counts[length]) if length < len(counts) else 0
        while done < n:
            if not (found := rooms.take(length)):
                found = capacity, bins, -(-(n - done) // (capacity // length))
                bins += found[2]
            room, first, some = found
            each = room // length
            full = min(some, (n - done) // each)
            if full:
                plan.append((length, done, first, each, capacity - room))
                rooms.put(room - each * length, first, full)
                done += full * each
            if full < some:
                rest = n - done  # less than a bin takes
                if rest:
                    plan.append((length, done, first + full, rest, capacity - room))
                    rooms.put(room - rest * length, first + full, 1)
                rooms.put(room, first + full + (rest > 0), some - full - (rest > 0))
                done = n
    return np.array(sorted(plan), np.int64).reshape(-1, 5), bins


def placed(plan: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces with these numbers among those of their length."""
    begins = np.searchsorted(plan[:, 0], np.arange(int(plan[:, 0].max(initial=0)) + 2))
    at = np.zeros(len(length), np.int64)
    for own in np.unique(length):
        mine = length == own
        rows = plan[begins[own] : begins[own + 1], 1]
        at[mine] = begins[own] + np.searchsorted(rows, number[mine], side="right") - 1
    _, first, bins, each, offset = plan[at].T
    return bins + (number - first) // each, offset + (number - first) % each * length


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with its number among those of its length in its input partition (part)."""

    def cut(batches):
        coder, seen = BatchTokenizer.of(tokenizer_path), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            ids, at = coder.encode(batch.column("text"), end_id)
            sizes = np.diff(at)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (at[row] + start)).tolist(), (4 * (at[row] + start + length)).tolist(), strict=True)]
            order, own = np.argsort(length, kind="stable"), np.bincount(length, minlength=capacity + 1)
            number = np.empty(len(row), np.int64)
            number[order] = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(number + seen[length])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
            )
            seen += own

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of the documents."""
    cut = stored(pieces(docs, capacity, tokenizer_path, end_id), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    counts = stored(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        total[r["length"]] = r["n"]
    plan, _ = best_fit_plan(total, capacity)

    def look_up(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            bins, offset = placed(plan, length, number)
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bins), pa.array(offset)], [*kept, "sequence_id", "offset"])

    numbered = cut.join(counts.drop("n").hint("merge"), ["length", "part"]).withColumn("number", F.col("number") + F.col("before"))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
