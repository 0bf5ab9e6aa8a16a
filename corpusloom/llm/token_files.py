"""Token-ID files: static range asymmetric numeral systems (rANS) over shared frequency tables.

A shard is a range of documents in ascending doc_id order, cut into segments of about SEGMENT_IDS ids at document bounds. A segment
has one frequency table, and blocks of BLOCK_IDS ids that are encoded with LANES interleaved states each and decode on their own.
The block index holds, for each block, a checkpoint (ids before it, offset of its states and words) and a CRC-32 of its ids, so that a
block is found without the ones before it. The document ids and lengths of a segment are columns beside it, outside of its checksums.

Frequencies add up to 2**SCALE, or for a segment of more symbols than a quarter of that to as much more as gives each of them four slots.

Segment bytes, little-endian: magic, n_ids, n_symbols, n_blocks (u32 each after 4 bytes of magic); symbols u32[], frequencies
u32[]; per block ids, words, crc, ids before it, offset of its states behind the index, all u32; then per block LANES states u64 and
its words u32[].

Defined cases: a null or empty text has the end id only; rows without doc_id come first; rows with the same doc_id follow each
other in order of a hash of their texts, and may go to several shards; a very long text makes a long segment; repeated rows are
written as often as they come; other columns are ignored; an empty table gives no segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import partitions, slices, stored, text_of
from .tokens import BatchTokenizer

MAGIC, SCALE, LANES, BLOCK_IDS, SEGMENT_IDS = b"CLT1", 18, 1024, 1 << 17, 1 << 21
LOW = np.uint64(1 << 31)
U = np.uint64

SEGMENTS = "shard int, segment int, shard_start long, n_ids long, doc_ids binary, lengths binary, data binary"


def scale_of(n_symbols: int) -> int:
    """Bits of the frequencies' sum."""
    return max(SCALE, (n_symbols - 1).bit_length() + 2)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in use and their frequencies, which are at least 1 and add up to 2**scale_of(symbols)."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    size = 1 << scale_of(len(symbols))
    freq = np.maximum(1, count[symbols] * size // len(ids))
    rest = size - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    k = 0
    while rest:
        at = order[k % len(order)]
        step = rest if rest > 0 else -min(-rest, int(freq[at]) - 1)
        freq[at] += step
        rest -= step
        k += 1
    return symbols, freq


def _encode_block(code: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """States and words of one block; code: indices into the table."""
    steps = -(-len(code) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words = []
    shift, limit = U(scale), U(63 - scale)
    for t in range(steps - 1, -1, -1):
        part = code[t * LANES : (t + 1) * LANES]
        f, x = freq[part], state[: len(part)]
        full = x >= f << limit
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> U(32), x)
        q = x // f
        state[: len(part)] = (q << shift) + (x - q * f) + start[part]
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def _decode_block(n: int, state: np.ndarray, words: np.ndarray, slot: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int) -> np.ndarray:
    out, at, state = np.empty(n, np.int64), 0, state.copy()
    mask, shift = U((1 << scale) - 1), U(scale)
    for a in range(0, n, LANES):
        k = min(LANES, n - a)
        x = state[:k]
        low = x & mask
        code = slot[low]
        out[a : a + k] = code
        x = freq[code] * (x >> shift) + low - start[code]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << U(32)) | words[at : at + len(need)]
        at += len(need)
        state[:k] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block's words do not match its states")
    return out


def encode_segment(ids: np.ndarray) -> bytes:
    symbols, freq = frequencies(ids)
    f = freq.astype(np.uint64)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    code = np.zeros(int(symbols[-1]) + 1, np.int64)
    code[symbols] = np.arange(len(symbols))
    code = code[ids]
    index, body, offset = [], [], 0
    for a in range(0, len(ids), BLOCK_IDS):
        state, words = _encode_block(code[a : a + BLOCK_IDS], f, start, scale_of(len(symbols)))
        part = ids[a : a + BLOCK_IDS]
        index += [len(part), len(words), zlib.crc32(part.astype("<u4")), a, offset]
        offset += 8 * LANES + 4 * len(words)
        body += [state.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    head = MAGIC + struct.pack("<III", len(ids), len(symbols), len(index) // 5)
    return b"".join([head, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array(index, "<u4").tobytes(), *body])


def decode_segment(data: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks only; checks each block's CRC-32."""
    n, n_symbols, n_blocks = struct.unpack_from("<III", data, 4)
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    at = 16
    symbols = np.frombuffer(data, "<u4", n_symbols, at).astype(np.int64)
    freq = np.frombuffer(data, "<u4", n_symbols, at + 4 * n_symbols)
    at += 8 * n_symbols
    index = np.frombuffer(data, "<u4", 5 * n_blocks, at).reshape(-1, 5).astype(np.int64)
    body = at + 20 * n_blocks
    slot = np.repeat(np.arange(n_symbols), freq)
    f, start = freq.astype(np.uint64), (np.cumsum(freq.astype(np.int64)) - freq).astype(np.uint64)
    out = []
    for k in range(n_blocks) if blocks is None else blocks:
        ids, words, crc, _, offset = index[k].tolist()
        at = body + offset
        state = np.frombuffer(data, "<u8", LANES, at)
        part = symbols[_decode_block(ids, state, np.frombuffer(data, "<u4", words, at + 8 * LANES).astype(np.uint64), slot, f, start, scale_of(n_symbols))]
        if zlib.crc32(part.astype("<u4")) != crc:
            raise ValueError(f"block {k}: checksum does not match")
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def write_segments(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, label: str = "token-files") -> DataFrame:
    """Tokenizes documents in ascending doc_id order and writes their segments; one shuffle of the texts, none of the ids."""

    def shard(batches):
        coder, k, ids, names, sizes, n, before = BatchTokenizer.of(tokenizer_path), 0, [], [], [], 0, 0
        me = TaskContext.get().partitionId()

        def flush():
            all_ids = np.concatenate(ids)
            row = [me, k, before, len(all_ids), pa.array([x for a in names for x in a.to_pylist()], pa.int64()), np.concatenate(sizes).astype("<i8").tobytes(), encode_segment(all_ids)]
            row[4] = _pack_ids(row[4])
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "segment", "shard_start", "n_ids", "doc_ids", "lengths", "data"])

        for part in slices(batches, "text", 4 << 20):
            got, at = coder.encode(part.column("text"), end_id)
            ids.append(got)
            names.append(part.column("doc_id"))
            sizes.append(np.diff(at))
            n += len(got)
            if n >= SEGMENT_IDS:
                yield flush()
                before, k, n = before + n, k + 1, 0
                ids, names, sizes = [], [], []
        if n:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(shard, SEGMENTS), label)


def _pack_ids(ids: pa.Array) -> bytes:
    """Document ids with their nulls: a byte for each row, then the values."""
    return np.asarray(ids.is_valid()).astype("u1").tobytes() + np.asarray(ids.fill_null(0)).astype("<i8").tobytes()


def _unpack_ids(data: bytes) -> pa.Array:
    n = len(data) // 9
    valid = np.frombuffer(data, "u1", n).astype(bool)
    return pa.array(np.frombuffer(data, "<i8", n, n), pa.int64(), mask=~valid)


def read_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decodes segments, each on its own: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    spark = segments.sparkSession
    totals = sorted((r["shard"], r["n"]) for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row for each shard file
    starts, before = [], 0
    for shard, n in totals:
        starts.append((shard, before))
        before += n
    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = decode_segment(row["data"]), np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4")).cast("B")
                bounds = list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True))
                columns = [
                    pa.array(np.full(len(sizes), row["shard"], np.int32)),
                    _unpack_ids(row["doc_ids"]),
                    pa.array(row["shard_start"] + ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()),
                ]
                names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = segments.select("shard", "shard_start", "doc_ids", "lengths", "data").mapInArrow(decode, schema)
    if not starts:
        return rows.drop("shard")
    base = spark.createDataFrame(starts, "shard int, before long")  # as many rows as shard files
    out = rows.join(F.broadcast(base), "shard").withColumn("start", F.col("start") + F.col("before"))
    return out.drop("shard", "before")
