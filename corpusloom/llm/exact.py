"""Exact deduplication by progressive refinement: lengths, then prefix hashes, then full hashes of what is left.

Texts are equal when they are identical after each run of ASCII white space is made one space. The first reading takes the length and
the hash of a prefix of each text only. Rows are grouped by length; those whose length occurs again are grouped by length and prefix
hash; what occurs again there is a group that survives. The second reading computes the full SHA-256 only for rows of surviving groups
and groups by it. So a row that is alone by its length or its prefix is never hashed in full, and no text is ever shuffled: what is
known of the surviving groups comes to the second reading as a bitmap of CELLS bits at most, one megabyte however many groups there are.
A bit that another group has set costs a full hash of a row too many, and no more: groups are made of full hashes alone.

A group may hold any share of the rows: rows are counted by full hash and a salt, which is dealt evenly over the rows, before they are
counted by the full hash, and the result goes back the same way, so that no task has more of a group than its share.

Defined cases: a null text counts as an empty one, like a text of white space at either end only by that space; null doc_ids come after
all others, so a group stays by its smallest doc_id if it has any; of rows that tie on the smallest doc_id one stays, repeated rows
included; very long texts are read whole; extra columns are kept by `without_copies`, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, partitions, stored, text_of, whole_row

#: Code points of a prefix, and bits of a bitmap of surviving groups.
PREFIX, CELLS = 64, 1 << 23


def normal(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def bitmap(places: DataFrame) -> DataFrame:
    """_bucket, _bits for a column _place of numbers from 1 to CELLS: a row of 4 KB for each 32,768 of them, where any is set."""
    return places.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))


def marked(rows: DataFrame, place: Column, bits: DataFrame, name: str) -> DataFrame:
    """Adds a boolean: whether the bit of the row's place is set. bits has at most CELLS / 32,768 rows and is broadcast."""
    out = rows.withColumn("_place", place)
    out = out.join(F.broadcast(bits), F.bitmap_bucket_number("_place") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return out.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_place", "_bucket", "_bits")


def length_place() -> Column:
    return F.pmod(F.col("_length").cast("long"), F.lit(CELLS)) + 1


def prefix_place() -> Column:
    return F.pmod(F.xxhash64("_length", "_prefix"), F.lit(CELLS)) + 1


def measured(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """The kept columns and _text, the normalised text."""
    return docs.select(*kept, normal(text_of()).alias("_text"))


def brief(rows: DataFrame) -> DataFrame:
    """Adds _length, in bytes, and _prefix, a hash of the first PREFIX code points."""
    return rows.withColumns({"_length": F.octet_length("_text"), "_prefix": F.xxhash64(F.substring("_text", 1, PREFIX))})


def surviving(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bitmaps of the lengths, and of the lengths with prefix hashes, that more than one row has."""
    rows = stored(brief(measured(docs, [])).select("_length", "_prefix"), "lengths")
    lengths = rows.groupBy("_length").agg(F.count("*").alias("m")).where("m > 1")
    lengths = stored(bitmap(lengths.select(length_place().alias("_place"))), "length-bits")
    left = marked(rows, length_place(), lengths, "_again").where("_again")
    pairs = left.groupBy("_length", "_prefix").agg(F.count("*").alias("m")).where("m > 1")
    return lengths, stored(bitmap(pairs.select(prefix_place().alias("_place"))), "prefix-bits")


def grouped(docs: DataFrame, kept: list[Column], digests: list[Column] | None = None) -> DataFrame:
    """The kept columns (of docs; doc_id as _id is added), the digests (of the column _text), keep_id, group_size and kept of each row."""
    lengths, prefixes = surviving(docs)
    rows = brief(measured(docs, [*kept, F.col("doc_id").cast("long").alias("_id")]))
    rows = marked(marked(rows, length_place(), lengths, "_long"), prefix_place(), prefixes, "_both")
    names = [c for c in rows.columns if c not in ("_text", "_length", "_prefix", "_long", "_both")]
    full = F.when(F.col("_long") & F.col("_both"), F.unhex(F.sha2("_text", 256))).alias("_full")
    salts = partitions(docs.sparkSession)
    rows = rows.select(*names, *(digests or []), full, F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows.withColumn("_salt", F.pmod("_row", F.lit(salts))), "full-hashes")
    names = [c for c in rows.columns if c not in ("_full", "_row", "_salt")]
    alone = rows.where("_full IS NULL").select(*names, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = rows.where("_full IS NOT NULL")
    first = lambda row, by: F.coalesce(F.min_by(row, by), F.min(row)).alias("_first")
    parts = some.groupBy("_full", "_salt").agg(F.count("*").alias("group_size"), F.min("_id").alias("keep_id"), first("_row", "_id"))
    whole = parts.groupBy("_full").agg(F.sum("group_size").alias("group_size"), F.min("keep_id").alias("keep_id"), first("_first", "keep_id"))
    back = some.join(parts.select("_full", "_salt").join(whole, "_full"), ["_full", "_salt"])
    return alone.unionByName(back.select(*names, "keep_id", "group_size", (F.col("_row") == F.col("_first")).alias("kept")))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 of each row."""
    rows = grouped(docs, [], [F.sha2("_text", 256).alias("text_sha256")])
    return rows.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns."""
    return grouped(docs, [whole_row(docs)]).where("kept").select("_doc.*")


COPIES_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
