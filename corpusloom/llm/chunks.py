"""Document fingerprints: content-defined chunks by a normalised gear hash, compared as sets of chunk digests weighted by length.

The gear hash of a position is the sum of the table values of the last 32 bytes, each shifted by its distance. A chunk ends where
its masked bits are zero: with a harder mask before the normal size and an easier one behind it. No position is looked at within
the first MIN bytes of a chunk, so a hash never sees bytes before its chunk, equal texts give equal chunks, and bounds fall into
step again behind an edit. A fingerprint is the sorted set of (XXH64 digest, length) of its chunks; likeness is the
share of a text's chunk length whose chunks the other text has too (its containment).

Defined cases: null texts are empty and have the empty fingerprint; the likeness of two empty fingerprints is 1, of an empty to
any other 0; documents follow each other by doc_id, then text, those without doc_id first, by a hash of their texts, and the rows of
one doc_id or one text without it meet in one task; a very long text is chunked whole; other columns are ignored; a table of one
document is followed by itself; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import partitions, slices, text_of

MIN, NORMAL, MAX = 32, 64, 255
HARD, EASY = np.uint32(0xFE000000), np.uint32(0xF8000000)  # 7 and 5 of the bits that all of the last bytes reach

#: One 32-bit value a byte, from a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, of the 32 bytes that end there; by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    return h


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each text; text i is data[bounds[i]:bounds[i + 1]]."""
    h = gear_hashes(data)
    easy_at = np.flatnonzero(h & EASY == 0) + 1  # a bound lies behind the byte
    hard = (h[easy_at - 1] & HARD == 0).tolist()
    place = np.searchsorted(easy_at, bounds).tolist()
    ends, easy = [], easy_at.tolist()
    n = len(easy)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own, k = [], place[i]
        while a < b:
            stop = min(a + MAX, b)
            cut, normal = stop, a + NORMAL
            while k < n and easy[k] < a + MIN:
                k += 1
            j = k
            while j < n and (at := easy[j]) < stop:
                if at >= normal or hard[j]:
                    cut = at
                    break
                j += 1
            own.append(cut)
            a = cut
        ends.append(own)
    return ends


def fingerprints(texts: list[bytes]) -> list[dict[int, int]]:
    """Digest to length of the chunks of each text."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    ends = chunk_ends(np.frombuffer(b"".join(texts), np.uint8), bounds)
    out, digest = [], xxhash.xxh64_intdigest
    for text, base, own in zip(texts, bounds[:-1].tolist(), ends, strict=True):
        a, found = 0, {}
        for end in own:
            b = end - base
            found[digest(text[a:b])] = b - a
            a = b
        out.append(found)
    return out


def coded(fingerprint: dict[int, int]) -> str:
    """Eighteen hex digits a chunk: sixteen of the digest, two of the length."""
    return "".join(f"{d:016x}{n:02x}" for d, n in sorted(fingerprint.items()))


def decoded(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[k : k + 16], 16): int(fingerprint[k + 16 : k + 18], 16) for k in range(0, len(fingerprint), 18)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    whole = sum(a.values())
    if not whole:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / whole


def _neighbours(docs: DataFrame) -> DataFrame:
    """Documents in buckets of neighbouring doc_ids, sorted; each bucket ends with a copy of the next bucket's first document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = 4 * partitions(spark)
    cuts = docs.select(F.percentile_approx("doc_id", F.lit([k / n for k in range(1, n)]), F.lit(20 * n)).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))  # at most n numbers
    place = F.lit(0)
    if cuts:
        place = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("doc_id")))
    # Rows without doc_id go to 64 buckets below the others, in the order of their hashes.
    own = F.xxhash64("text")
    docs = docs.withColumn("at", F.coalesce("doc_id", own)).withColumn("bucket", F.when(F.col("doc_id").isNull(), F.shiftright(own, 58).cast("int") - 96).otherwise(place))
    heads = docs.groupBy("bucket").agg(F.min(F.struct("at", "text", "doc_id")).alias("head"))
    order = Window.orderBy("bucket")  # one row a bucket
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    heads = heads.select(F.col("before").alias("bucket"), F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.col("head.at").alias("at"), F.lit(1).alias("head"))
    rows = docs.withColumn("head", F.lit(0)).unionByName(heads)
    return rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "head", "at", "text").drop("at")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def compare(batches):
        held = None  # the row before, as (bucket, head, doc_id, text)
        for batch in slices(batches, "text"):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "head", "doc_id", "text")), strict=True))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
            if not pairs:
                continue
            texts = [r[3].encode() for r in rows]
            own = dict(zip(map(id, rows), fingerprints(texts), strict=True))
            edited = []
            for a, b in pairs:
                n = len(a[3])
                edited.append((a[3][: n - n // 4] + b[3][: n // 4]).encode())
            edited_fp = fingerprints(edited)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                    "fingerprint": pa.array([coded(own[id(a)]) for a, _ in pairs]),
                    "edited_fingerprint": pa.array([coded(x) for x in edited_fp]),
                    "near_edited": pa.array([likeness(own[id(a)], x) for (a, _), x in zip(pairs, edited_fp, strict=True)]),
                    "near_next": pa.array([likeness(own[id(a)], own[id(b)]) for a, b in pairs]),
                }
            )

    return _neighbours(docs).mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
