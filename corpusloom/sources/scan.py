"""Quoted tab-separated text in parallel: one file is read by as many tasks as it has splits, and its records are numbered in order.

Spark's text source cuts files at line ends, but a line may be inside a quoted cell that began in another split. What a split does to
the question whether one is inside a quote is a function of one bit: it keeps it, flips it, or sets it. A first reading finds this function
of each split and how many records start in it for either answer. Composing the functions in order, which are a row a split, gives the
state and the number of records before each split; a second reading cuts the records, and the few that cross a split are put together
by number. Files follow each other by name.

The rules are those of Python's csv module: a quote opens a cell at its beginning only and is doubled inside, what follows the closing
quote is taken as it is, CR LF, LF and CR end a record outside of quotes and stay as they are inside, and a quote that nothing closes ends
with the file, before a line end there. Blank records count but are left out; a byte order mark at a file's start is dropped.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.lineage import checkpointed

#: Splits that are known to all tasks; more of them are joined by a shuffle of the lines.
BROADCAST_SPLITS = 100_000
BARE_CR = re.compile("(?<=\r)(?!$)")
#: Lines or records that are Python's at once, and the characters of the records.
ROWS, CHARACTERS = 256, 1 << 20


def inside_after(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside a quoted cell, of a line that starts inside one or not."""
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                at += 1
            else:
                at = line.find('\t"', at) + 2
                if at == 1:
                    return False
        inside = False
        while True:
            at = line.find('"', at) + 1
            if not at:
                return True
            if not line.startswith('"', at):
                break
            at += 1
        at = line.find("\t", at) + 1
        if not at:
            return False


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str]]:
    """The columns but value of each line, and the line with its end; a CR inside a line ends it too."""
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        values = batch.column("value").to_pylist()
        others = batch.drop_columns("value").to_pylist()
        for value, other in zip(values, others, strict=True):
            if "\r" in value[:-1]:
                *parts, value = BARE_CR.split(value)
                yield from ((other, p) for p in parts)
            yield other, value + "\n"


def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, and for a split entered outside and inside of quotes: whether it ends inside, and the records that start in it."""
    at, ends, counts = None, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "out_to": ends[0], "in_to": ends[1], "n_out": counts[0], "n_in": counts[1]}])

    for other, line in cut(batches):
        if (other["file"], other["start"]) != at:
            if at:
                yield row()
            at, ends, counts = (other["file"], other["start"]), [False, True], [0, 0]
        quoted = '"' in line
        for k in (0, 1):
            counts[k] += not ends[k]
            if quoted:
                ends[k] = inside_after(line, ends[k])
    if at:
        yield row()


def cells_of(record: str) -> list[str]:
    if '"' not in record:
        record = record.rstrip("\r\n")
        return record.split("\t") if record else []
    csv.field_size_limit(2**31 - 1)
    if inside_after(record, False):
        record = record.removesuffix("\n")
    return next(csv.reader(io.StringIO(record, newline=""), delimiter="\t"), [])


RECORDS = "file string, record long, start long, part string, cells array<string>"
_RECORDS = pa.schema([("file", pa.string()), ("record", pa.int64()), ("start", pa.int64()), ("part", pa.string()), ("cells", pa.list_(pa.string()))])


def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records with their cells; of those that cross the split's ends, their part in it with the split's start."""
    at, inside, entered, number, parts, out, size = None, False, False, 0, [], [], 0

    def put(open_end: bool) -> None:
        nonlocal size
        if parts:
            text = "".join(parts)
            size += len(text)
            crosses = open_end or entered
            out.append({"file": at[0], "record": number, "start": at[1] if crosses else None, "part": text if crosses else None, "cells": None if crosses else cells_of(text)})

    for other, line in cut(batches):
        if (other["file"], other["start"]) != at:
            put(inside)
            if other["inside"] is None:
                raise ValueError(f"{other['file']} was cut otherwise at {other['start']} when it was surveyed")
            at, inside, number, parts = (other["file"], other["start"]), other["inside"], other["before"], []
            entered = inside
            if at[1] == 0:
                line = line.removeprefix("\ufeff")
        elif not inside:
            put(False)
            parts, entered = [], False
        if not inside:
            number += 1
        parts.append(line)
        if '"' in line:
            inside = inside_after(line, inside)
        if size > CHARACTERS or len(out) >= ROWS:
            yield pa.RecordBatch.from_pylist(out, _RECORDS)
            out, size = [], 0
    put(inside)
    yield pa.RecordBatch.from_pylist(out, _RECORDS)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        yield pa.RecordBatch.from_pylist([{"file": r["file"], "record": r["record"], "cells": cells_of(r["part"])} for r in batch.to_pylist()], pa.schema([_RECORDS.field(c) for c in ("file", "record", "cells")]))


def lines(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def splits(spark: SparkSession, path: str) -> DataFrame:
    """file, start, inside (a quote when the split begins), before (records of the file that started before it), n, offset (records of
    files before), of each split with a line."""
    found = lines(spark, path).mapInArrow(surveyed, "file string, start long, out_to boolean, in_to boolean, n_out long, n_in long")
    sets, flips = F.col("out_to") == F.col("in_to"), F.col("out_to") & ~F.col("in_to")
    order = Window.partitionBy("file").orderBy("start")
    up_to, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("flips", F.sum(flips.cast("int")).over(up_to))
    last = lambda c: F.last(F.when(sets, c), ignorenulls=True).over(before)
    flipped = F.coalesce(F.lag("flips").over(order), F.lit(0)) - F.coalesce(last(F.col("flips")), F.lit(0))
    found = found.withColumn("inside", F.coalesce(last(F.col("out_to")), F.lit(False)) != (flipped % 2 == 1))
    found = found.withColumn("n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    found = checkpointed(found.select("file", "start", "inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n"), "splits")
    files = found.groupBy("file").agg(F.sum("n").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    return found.join(files.select("file", offset.alias("offset"), (F.row_number().over(Window.orderBy("file")) - 1).alias("nth")), "file")


def records(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """record (the number of the record, over all files in order of their names, from 1; with a header, the first record of each file is
    left out and does not count), cells array<string>. Blank records are left out but count."""
    known = checkpointed(splits(spark, path), "numbered-splits")
    few = known.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    given = known.select("file", "start", "inside", "before")
    if few:
        rows = lines(spark, path).join(F.broadcast(given), ["file", "start"], "left")
    else:
        rows = lines(spark, path).withColumn("row", F.monotonically_increasing_id()).join(given, ["file", "start"], "left").sortWithinPartitions("file", "start", "row")
    found = rows.select("value", "file", "start", "inside", "before").mapInArrow(recorded, RECORDS)
    whole = found.where("cells IS NOT NULL").select("file", "record", "cells")
    parts = found.where("cells IS NULL").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))
    parts = parts.select("file", "record", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("part"))
    out = whole.unionByName(parts.mapInArrow(joined, "file string, record long, cells array<string>"))
    files = known.groupBy("file").agg(F.first("offset").alias("offset"), F.first("nth").alias("nth"))
    out = out.join(F.broadcast(files) if few else files, "file").where(F.size("cells") > 0)
    if header:
        return out.where("record > 1").select((F.col("record") - 1 + F.col("offset") - F.col("nth")).alias("record"), "cells")
    return out.select((F.col("record") + F.col("offset")).alias("record"), "cells")
