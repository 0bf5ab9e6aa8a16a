"""What the operators of this package share: tables, scratch tables in the shared folder, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.lineage import checkpointed as stored  # noqa: F401
from corpusloom.operators.lineage import discard, scratch_until_here  # noqa: F401
from corpusloom.operators.lineage import shared_folder as scratch_root  # noqa: F401
from corpusloom.sources.tables import read_table as table  # noqa: F401

#: ASCII white space, the word separator of every contract here (Java and Python regex syntax).
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]"

#: A side of a join is broadcast only if it was counted and has no more rows than this (rows here are a few dozen bytes).
BROADCAST_ROWS = 20_000


def joined_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Inner or left semi join of stored tables whose keys may be very uneven; right says in m how many rows of left a key has.

    Keys with more rows than a partition's share are fewer than there are partitions: their rows of right are broadcast, and only
    the others are shuffled.
    """
    share = max(1, left.count() // partitions(left.sparkSession))
    hot = right.where(F.col("m") > share)
    cold = left.join(F.broadcast(hot.select(*on).distinct()), on, "left_anti").join(right.where(F.col("m") <= share), on, how)
    return left.join(F.broadcast(hot), on, how).unionByName(cold)


def attached(rows: DataFrame, values: DataFrame, on: list[str], salt: str, how: str = "inner") -> DataFrame:
    """rows with the columns of values, which has a row a key, however many rows a key has: the distinct pairs of key and salt are joined
    with values first, and rows with those pairs. rows is stored, with whole numbers in `salt` that are dealt evenly within a key; of a key
    as many rows as there are salts meet values, and its rows go to as many tasks."""
    pairs = rows.select(*on, salt).distinct().join(values, on, how)
    return rows.join(pairs, [*on, salt], how)


def joined_small(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins with a stored table that is expected to be small: broadcast behind a count of it, else a shuffled join."""
    n = small.limit(BROADCAST_ROWS + 1).count()
    return left.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


#: Copies of a table that is joined with an uneven one.
SALTS = 32


def joined_within(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins left, of which a key may have any share of the rows, with a stored table of some rows a key: it is broadcast behind a count;
    beyond that, each of its rows is dealt out SALTS times, and left is spread among these."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.hash(*(c for c, kind in left.dtypes if "map<" not in kind)), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return salted.join(right.select("*", salts), [*on, "_salt"], how).drop("_salt")


def joined_texts(texts: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """Joins rows that hold whole texts on k1 and k2: always one shuffle of them, so that the plan is alike at every size."""
    return texts.join(keys.hint("merge"), ["k1", "k2"], how)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_keys(docs: DataFrame, *also: str) -> list[Column]:
    """k1, k2: hashes of the text, and of doc_id, text and the columns `also` (nulls count as empty). By these 128 bits a row is found
    again when the table is read anew, so that no copy of it has to be written; repeated rows share them."""
    others = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", *also) if c in docs.columns]
    return [F.xxhash64(text_of()).alias("k1"), F.xxhash64(F.lit(71), *others, text_of()).alias("k2")]


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, column: str, limit: int = 2 << 20):
    """Cuts Arrow batches so that the texts of each piece take about limit bytes at most, or the piece is one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
