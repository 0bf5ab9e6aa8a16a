"""Substring dedup: words in windows that occur more than once in the corpus, found by a compressed FM-index per shard.

A window of `window` words is led by its anchor: the GRAM words in it with the least hash, the first of them at a tie. Equal windows
have equal anchors, so only windows of an anchor that occurs twice or more can repeat. Neighbouring windows with one anchor make a
segment; the anchor's hash decides on its shard. Equal segments (of one anchor, told apart by 64 more bits of a hash of their words)
are counted, and one of each is cut out of its text and sent to its shard. There the index (a wavelet tree shaped by a prefix code,
over the Burrows-Wheeler transform of the segments, each place weighted by the segment's count) gives the matching statistics of
every segment by backward search; where a match of `window` words counts twice or more, the window repeats. The spans go back to all
documents that have the segment. An anchor with over CROWD different segments would be too much for one shard: its segments are taken
apart into windows, those whose hash of 128 bits occurs once are left out, and each of the others becomes a segment of its own.

Words are what stands between ASCII white space; the index compares the words themselves. A row is known by two 64-bit hashes, of
its text and of its doc_id and text, so no copy of the documents is written: each step reads the table again.

Defined cases: null and empty texts have no word and lose none; a text shorter than a window keeps all, and a very long one is
cut at all its repeated windows like any other; repeated rows lose all their windows, as each is elsewhere too; `without_repeats`
keeps all columns, whatever their names, sets text (and n_chars, if there is one) of the rows that lose words, and drops a row only if
no word of its text is left; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .base import discard, joined_hot, joined_small, joined_texts, row_keys, slices, stored, text_of, whole_row
from .fm_index import FMIndex, repeated_windows

GRAM, SHARD_BYTES, CROWD, SEED = 8, 3 << 20, 1 << 14, 5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

#: Odd multipliers of the polynomial hashes of words in a row, and what undoes them.
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]
_BACK = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes of all words in a row, bounds of each text's words, the word of each code)."""
    pieces = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = pieces.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    bounds = pieces.offsets.to_numpy(zero_copy_only=False)
    bounds = bounds - bounds[0]
    if "" in words:  # beside white space at the ends of a text
        real = code != words.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        code = code[real]
    return code, bounds, words


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all words in a row, bounds of each text's words)."""
    code, bounds, words = word_codes(texts)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), SEED) for w in words), np.uint64, len(words))[code], bounds


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and the byte behind the end, of all words in a row, in their own text."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]])[: len(space)] | edge[:-1]))
    last = np.flatnonzero(~space & (np.concatenate([space[1:], [True]])[: len(space)] | edge[1:]))
    own = ends[np.searchsorted(ends, first, side="right") - 1]
    return first - own, last + 1 - own


def segments(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the text, windows, anchor) of each run of windows with one anchor."""
    n, gram = len(words), min(GRAM, window)
    width = window - gram + 1
    starts = n - window + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        h = h * _BASES[0] + words[k : k + len(h)]
    h = mixed(h)
    place, size = np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(h[left] <= h[right], left, right)
        size += step
    place = place[:starts]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:starts]
    valid = np.arange(starts) + window <= bounds[1:][text]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(np.cumsum(valid)[first] - 1, valid.sum()))
    return text[first], first - bounds[text[first]], count, h[place[first]]


def digests(words: np.ndarray, first: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    """A hash of each run of n words from `first` on, which does not depend on what stands around it."""
    base, back = _BASES[kind], _BACK[kind]
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), base)]))
    undo = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), back)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words ^ base) * powers[:-1], dtype=np.uint64)])
    return mixed((sums[first + n] - sums[first]) * undo[first] + n.astype(np.uint64) * _BASES[1 - kind])


def occurrences(texts: DataFrame, window: int) -> DataFrame:
    """k1, k2, start (word), place (first byte and number of bytes), anchor, digest of each segment of texts (k1, k2, text)."""

    def run(batches):
        for batch in slices(batches, "text"):
            words, bounds = word_hashes(batch.column("text"))
            begin, end = word_places(batch.column("text"))
            text, start, n, anchor = segments(words, bounds, window)
            first, size = bounds[text] + start, n + window - 1
            row = pa.array(text)
            place = begin[first] << 32 | end[first + size - 1] - begin[first]
            columns = [batch.column("k1").take(row), batch.column("k2").take(row), pa.array(start.astype(np.int32)), pa.array(place), pa.array(anchor.view(np.int64)), pa.array(digests(words, first, size, 0).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "start", "place", "anchor", "digest"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, start int, place long, anchor long, digest long")


def cut_out(texts: DataFrame, some: DataFrame) -> DataFrame:
    """Adds words, the bytes of each of the segments `some` (anchor, digest, m, k1, k2, place), cut from its text."""
    per = some.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "digest", "m", "place")).alias("found"))  # of one text
    rows = joined_texts(texts, per).dropDuplicates(["k1", "k2"])  # repeated rows; dealt and sorted by the join

    def run(batches):
        for batch in slices(batches, "text"):
            found = batch.column("found")
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            fields = found.flatten()
            place = fields.field(3).to_numpy(zero_copy_only=False)
            texts = [memoryview(x.encode()) for x in batch.column("text").to_pylist()]
            for a in range(0, len(row), 20_000):
                own = slice(a, a + 20_000)
                cuts = [bytes(texts[r][p >> 32 : (p >> 32) + (p & 0xFFFFFFFF)]) for r, p in zip(row[own].tolist(), place[own].tolist(), strict=True)]
                at = pa.array(row[own])
                columns = [fields.field(k)[own] for k in range(3)] + [batch.column("k1").take(at), batch.column("k2").take(at), fields.field(3)[own], pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "m", "k1", "k2", "place", "words"])

    return rows.select("k1", "k2", "text", "found").mapInArrow(run, "anchor long, digest long, m long, k1 long, k2 long, place long, words binary")


def windows_of(cuts: DataFrame, window: int) -> DataFrame:
    """w1, w2 (hashes of the words) and at (first word in the segment) of each window of cut segments, with its own place."""

    def run(batches):
        for batch in slices(batches, "words"):
            texts = batch.column("words").cast(pa.string())
            words, bounds = word_hashes(texts)
            begin, end = word_places(texts)
            count = np.diff(bounds) - window + 1
            row = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first, size = bounds[row] + at, np.full(len(row), window)
            own = pa.array(row)
            place = batch.column("place").to_numpy()[row]
            place = (place >> 32) + begin[first] << 32 | end[first + window - 1] - begin[first]
            columns = [batch.column(c).take(own) for c in ("anchor", "digest", "m", "k1", "k2")]
            columns += [pa.array(place), pa.array(at.astype(np.int32)), *(pa.array(digests(words, first, size, k).view(np.int64)) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "m", "k1", "k2", "place", "at", "w1", "w2"])

    return cuts.mapInArrow(run, "anchor long, digest long, m long, k1 long, k2 long, place long, at int, w1 long, w2 long")


def matched(cuts: DataFrame, shards: int, window: int) -> DataFrame:
    """anchor, digest, m, a, b: words a to b - 1 of a cut segment are in repeated windows."""

    def run(batches):
        batches = list(batches)  # a shard: about SHARD_BYTES
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        anchor, digest = (table[c].to_numpy() for c in ("anchor", "digest"))
        order = np.lexsort((digest, anchor))
        once = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1])])
        table = table.take(pa.array(order[once]))
        column = table["words"].cast(pa.large_string()).combine_chunks()
        code, bounds, words = word_codes(pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column)
        sizes, copies = np.diff(bounds), table["m"].to_numpy()
        starts = bounds[:-1] + np.arange(len(sizes))
        text, weights = np.zeros(len(code) + len(sizes), np.int64), np.repeat(copies, sizes + 1)
        inside = np.ones(len(text), bool)
        inside[starts + sizes] = False
        text[inside] = code + 1
        row, at = repeated_windows(FMIndex(text, len(words) + 1, window, weights), starts, sizes, window)
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)])[: len(row)])
        tail = np.append(head[1:], len(row))[: len(head)] - 1
        out = table.select(["anchor", "digest", "m"]).take(pa.array(row[head]))
        out = out.append_column("a", pa.array(at[head].astype(np.int32))).append_column("b", pa.array((at[tail] + window).astype(np.int32)))
        yield from out.to_batches()

    return cuts.select("anchor", "digest", "m", "words").repartition(shards, "anchor").mapInArrow(run, "anchor long, digest long, m long, a int, b int")


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """k1, k2, spans array<struct<a, b>>: words a to b - 1 of a text are in repeated windows; texts: k1, k2, text."""
    found = stored(occurrences(texts, window), "segments")
    anchors = stored(found.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "anchors")
    seen = stored(joined_hot(found, anchors, ["anchor"], "left_semi"), "repeated-anchors")
    discard(found, anchors)
    distinct = seen.groupBy("anchor", "digest").agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "place")).alias("at"))
    distinct = stored(distinct.select("anchor", "digest", "m", "at.*"), "distinct-segments")
    few, crowd = distinct, stored(distinct.groupBy("anchor").agg(F.count("*").alias("of")).where(F.col("of") > CROWD).select("anchor"), "crowded-anchors")
    crowded = crowd.limit(1).count() > 0
    if crowded:
        many = stored(windows_of(cut_out(texts, joined_small(distinct, crowd, ["anchor"], "left_semi")), window), "crowded-windows")
        again = many.groupBy(F.col("w1").alias("anchor"), F.col("w2").alias("digest")).agg(F.sum("m").alias("m"), F.min(F.struct("k1", "k2", "place")).alias("at"))
        again = stored(again.where("m > 1").select("anchor", "digest", "m", "at.*"), "repeated-windows")
        few = joined_small(distinct, crowd, ["anchor"], "left_anti").unionByName(again)
    shards = max(1, -(-(few.agg(F.sum(F.col("place").bitwiseAND(0xFFFFFFFF))).first()[0] or 0) // SHARD_BYTES))
    spans = stored(matched(cut_out(texts, few), shards, window), "segment-spans")
    if crowded:
        whole = many.select("anchor", "digest", "m", "at", "w1", "w2").join(spans.select(F.col("anchor").alias("w1"), F.col("digest").alias("w2")), ["w1", "w2"], "left_semi")
        whole = whole.select("anchor", "digest", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
        own = whole.join(distinct.select("anchor", "digest", "m"), ["anchor", "digest"]).select("anchor", "digest", "m", "a", "b")
        spans = stored(spans.join(again.select("anchor", "digest"), ["anchor", "digest"], "left_anti").unionByName(own), "all-spans")
    back = joined_hot(seen.select("k1", "k2", "start", "anchor", "digest"), spans, ["anchor", "digest"])
    back = back.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans"))
    out = stored(back, "text-spans")
    discard(seen, distinct, crowd, *((many, again) if crowded else ()))
    return out


def removed_words(spans: list[dict], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [s["a"] for s in spans], 1)
    np.add.at(edge, [s["b"] for s in spans], -1)
    return np.cumsum(edge[:n]) > 0


def deduplicated(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *row_keys(docs))

    def run(batches):
        for batch in slices(batches, "text"):
            n, removed, hashes = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                gone = removed_words(spans or [], len(words))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
                n.append(len(words))
                removed.append(len(words) - len(kept))
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = joined_texts(rows, repeated_spans(rows.select("k1", "k2", "text"), window), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and the white space behind them."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    gone = removed_words(spans, len(places)).tolist()
    ends = [a for a, _ in places[1:]] + [len(raw)]
    kept = [raw[a:b] for (a, _), b, g in zip(places, ends, gone, strict=True) if not g]
    return b"".join(kept).decode().strip(" \t\n\x0b\f\r")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents with their own columns, their texts without repeated windows."""
    rows = docs.select(whole_row(docs), text_of().alias("text"), *row_keys(docs))
    spans = repeated_spans(rows.select("k1", "k2", "text"), window)

    def run(batches):
        for batch in slices(batches, "text"):
            texts = [without(t, s) if s else None for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.string())], ["_doc", "_new"])

    found = joined_texts(rows.drop("text"), spans, "left")
    schema = StructType([rows.schema["_doc"], StructField("_new", StringType())])
    changed = found.select(text_of("_doc.text").alias("text"), "spans", "_doc").mapInArrow(run, schema)
    out = changed.where("_new IS NULL OR _new <> ''")
    columns = {"text": F.coalesce("_new", F.col("_doc.text")), "n_chars": F.when(F.col("_new").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(columns[c].alias(c) if c in columns else F.col(f"_doc.`{c}`") for c in docs.columns))


def deduplicated_sql(window: int) -> str:
    """What `deduplicated` returns, in DuckDB SQL: every window as a string, counted over all documents."""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - {window - 2})) AS j, unnest(list_transform(range(1, len(w) - {window - 2}), lambda i: array_to_string(w[i:i + {window - 1}], ' '))) AS g
  FROM d WHERE len(w) >= {window}
), starts AS (SELECT r, j FROM (SELECT r, j, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
places AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
marked AS (
  SELECT r, j, word, count(starts.j) OVER (PARTITION BY r ORDER BY places.j ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) = 0 AS stays
  FROM places LEFT JOIN starts USING (r, j)
), kept AS (SELECT r, count(*) FILTER (NOT stays) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (stays) AS text FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
