"""Cutting the lineage of steps in the shared folder, and deleting what was written there.

What a block of `scratch_until_here` stores belongs to that block alone: the list of its tables is held in a context variable, so
blocks of other threads, and blocks around it, keep theirs. Outside of any block, tables stay until `discard`, as a lazy result may
still read them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that the innermost block of this thread has stored; None outside of blocks.
_block: ContextVar[list[str] | None] = ContextVar("stored_tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; one of this machine only where none is set and Spark runs in this process alone, as in tests."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame, label: str = "rows", by: list[str] | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: computed once, and there when executors are lost. With `by`, a
    folder for each of its values."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    held = _block.get()
    if held is not None:
        held.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    held = _block.get()
    for t in tables:
        delete(t.sparkSession, t._path)
        if held is not None and t._path in held:
            held.remove(t._path)


@contextmanager
def scratch_until_here(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored inside: for a step whose result has been written by then."""
    mine: list[str] = []
    token = _block.set(mine)
    try:
        yield
    finally:
        _block.reset(token)
        for path in mine:
            delete(spark, path)
