"""Conversation turns that arrive in any order, put together by a stateful stream over boundary-hash fragments.

The stream is keyed by conversation and block, a range of SPAN turns from the conversation's first one. The state of a block is three
maps: the fragments by the turn they start with (their end, how many turns repeat the role before them, their first and last role),
the starts by the turn they end with, and the turns that wait. A turn looks up the fragment that ends before it and the one that starts
behind it, joins them in constant time and adds their role breaks and those at its own edges. When the fragment at the block's start
grows, its new turns are released, each once, so the state holds no text of a released turn. One more key of a conversation (block -1)
keeps the batch of its last arrival and a timer in event time, which closes it.

Batches come one start of the query each, as files in its input folder; batch b carries the event time b, and a tick that passes only
the watermark announces the next one, so an empty batch moves the clock as well, and the batch in which a conversation closes is the one
that finds its timer due, behind its arrivals, without a run of the query for timers alone. What closed is joined to later arrivals as they are fed, which the stream then
rejects, and is fed to the blocks, which give their fragments and clear their state. One batch later than the last one all timers are due.

A conversation of any length spreads over blocks: a block that is full tells its batch, and the runs of full blocks, found block by
block and then by GROUP blocks, say when what a later block has released is free. Joins on the conversation go through a salt of the
turn. Only the list of the turns that a conversation never released is one value of one row, as its digest is a chain over all of it.

Defined cases: rows without turn are dropped; a null conv_id is a conversation of its own, and hashed as an empty string; null role
and text are empty; of equal turns in one batch the smallest payload in UTF-8 arrives, with the smallest role if several make it; repeated
rows arrive once a batch; turns may be negative; very long texts are kept whole; extra columns are ignored, whatever their names; an empty table
gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .base import attached, partitions, scratch_root, stored

#: Turns of a block; blocks of a group; batches without arrivals that close a conversation; batches of the query's cut.
SPAN, GROUP, IDLE, BATCHES = 256, 1024, 2, 10
HOUR = 3_600_000

ARRIVALS = "kind string, conv string, block long, first long, turn long, role string, payload string, batch int, closed boolean, at timestamp"
EVENTS = "conv string, block long, turn long, upto long, first long, run boolean, breaks long, head string, tail string, payload string, batch int, kind string"
EVENT = Row("conv", "block", "turn", "upto", "first", "run", "breaks", "head", "tail", "payload", "batch", "kind")


def hour(batch: int) -> int:
    """The event time of a batch, in milliseconds."""
    return (batch + 24) * HOUR


def hour_of(start: int, batches: int) -> int:
    """The event time of what a start is fed: of its batch; behind the last one all timers are due."""
    return hour(start if start < batches else start + IDLE)


def due(last: int) -> int:
    """When a conversation closes whose last arrival was in batch `last`: a while before batch last + IDLE."""
    return hour(last + IDLE) - HOUR // 2


class Fragments(StatefulProcessor):
    def __init__(self, span: int, batches: int):
        self.span, self.batches = span, batches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "batch int")
        self.starts = handle.getMapState("starts", "turn long", "upto long, breaks long, head string, tail string")
        self.ends = handle.getMapState("ends", "turn long", "start long")
        self.held = handle.getMapState("held", "turn long", "payload string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            if row.kind == "active":
                self.touched(row.batch)
            elif row.kind == "closed":
                yield from self.cleared(row)
            elif row.closed:
                yield EVENT(row.conv, row.block, row.turn, None, None, None, None, None, None, row.payload, row.batch, "reject")
            else:
                yield from self.arrived(row)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        batch = min(self.last.get()[0] + IDLE, self.batches)
        self.last.update((None,))  # closed for good
        yield EVENT(key[0], None, None, None, None, None, None, None, None, None, batch, "close")

    def touched(self, batch: int) -> None:
        if self.last.exists():
            last = self.last.get()[0]
            if last is None:
                return
            self.handle.deleteTimer(due(last))
        self.last.update((batch,))
        self.handle.registerTimer(due(batch))

    def arrived(self, row: Row) -> Iterator[Row]:
        t, low = row.turn, row.first + row.block * self.span
        run = self.starts.getValue((low,))
        free = run[0] + 1 if run else low
        if t < free or self.held.containsKey((t,)):
            return
        start, end, breaks, head, tail = t, t, 0, row.role, row.role
        before = low if t == free and run else (self.ends.getValue((t - 1,)) or (None,))[0]
        if before is not None:
            _, n, head, other = self.starts.getValue((before,))
            start, breaks = before, n + (other == row.role)
            self.ends.removeKey((t - 1,))
        if after := self.starts.getValue((t + 1,)):
            end, n, other, tail = after
            breaks += n + (other == row.role)
            self.starts.removeKey((t + 1,))
        self.starts.updateValue((start,), (end, breaks, head, tail))
        self.ends.updateValue((end,), (start,))
        if start != low:
            self.held.updateValue((t,), (row.payload,))
            return
        for k in range(free, end + 1):
            payload = row.payload
            if k != t:
                payload = self.held.getValue((k,))[0]
                self.held.removeKey((k,))
            yield EVENT(row.conv, row.block, k, None, None, None, None, None, None, payload, row.batch, "release")
        if end == low + self.span - 1:
            yield EVENT(row.conv, row.block, None, None, None, None, None, None, None, None, row.batch, "full")

    def cleared(self, row: Row) -> Iterator[Row]:
        low = row.first + row.block * self.span
        for (start,), (end, breaks, head, tail) in self.starts.iterator():
            yield EVENT(row.conv, row.block, start, end, row.first, start == low, breaks, head, tail, None, row.batch, "fragment")
        for state in (self.starts, self.ends, self.held):
            state.clear()


def arrivals(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """conv (conv_id as a string), turn, batch, payload, role, first of what arrives, each turn once a batch at most."""
    salts = partitions(rows.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.where(F.col("turn").isNotNull()).select(text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "conv", "turn"), 256), 1, 8), 16, 10).cast("long")
    first = F.struct((h % batches).cast("int").alias("batch"), "role")
    again = F.struct(((h + 5) % batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    copies = F.explode(F.when(h % 7 < 2, F.array(first, again)).otherwise(F.array(first))).alias("x")
    rows = rows.select("conv", "turn", "text", copies).select("conv", "turn", "x.batch", F.struct(F.concat("x.role", F.lit("|"), "text").alias("payload"), "x.role").alias("x"))
    rows = rows.groupBy("conv", "turn", "batch").agg(F.min("x").alias("x")).select("conv", "turn", "batch", "x.*", F.pmod(F.xxhash64("turn"), F.lit(salts)).alias("salt"))
    rows = stored(rows, "arrivals")
    return attached(rows, rows.groupBy("conv").agg(F.min("turn").alias("first")), ["conv"], "salt")


def fed(rows: DataFrame, kind: str, at: int, batch: Column, **columns: Column) -> DataFrame:
    """Rows as the stream takes them, at an event time."""
    given = {"kind": F.lit(kind), "batch": batch, "at": F.timestamp_millis(F.lit(at))} | columns
    have = {f: given.get(f, F.col(f) if f in rows.columns else F.lit(None)) for f in (x.split()[0] for x in ARRIVALS.split(", "))}
    kinds = dict(x.split() for x in ARRIVALS.split(", "))
    return rows.select(*(c.cast(kinds[f]).alias(f) for f, c in have.items()))


def events(rows: DataFrame, batches: int = BATCHES, span: int = SPAN) -> DataFrame:
    """What the stream has given for all batches of the rows (conv_id, turn, role, text): EVENTS."""
    spark = rows.sparkSession
    folder = f"{scratch_root(spark)}/reassembly-{uuid.uuid4().hex}"
    block = F.floor((F.col("turn") - F.col("first")) / span).cast("long").alias("block")
    placed = stored(arrivals(rows, batches).select("conv", "turn", "batch", "payload", "role", "first", "salt", block), "placed", ["batch"])
    blocks = stored(placed.select("conv", "first", "block").distinct(), "blocks")

    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores, no space ahead of their use
    # A start has one micro-batch, and stores of its own: each is closed by the task that commits it. Open ones would stay for a minute,
    # those of all partitions and starts at once, some megabytes of an executor each.
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")

    def start() -> None:
        """Takes what is new in the input folder; the state and what was read are those of the checkpoint."""
        found = session.readStream.schema(ARRIVALS).parquet(f"{folder}/in").withWatermark("at", "0 seconds")
        # The tick goes behind the watermark; a condition on the event time stays there.
        found = found.where((F.col("kind") != "tick") | (F.col("at") < F.timestamp_millis(F.lit(0))))
        out = found.groupBy("conv", "block").transformWithState(Fragments(span, batches), EVENTS, "Append", "EventTime")
        writer = out.writeStream.format("parquet").partitionBy("kind").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()

    tick = spark.range(1).select()
    for b in range(batches + 2):
        at, number = hour_of(b, batches), F.lit(b)
        feed = fed(tick, "tick", hour_of(b + 1, batches) - HOUR // 60, number)
        closed = spark.read.schema(EVENTS).parquet(f"{folder}/out").where("kind = 'close'").select("conv", F.col("batch").alias("closed_in")) if b > IDLE else None
        if b < batches:
            own = placed.where(F.col("batch") == b)
            feed = feed.unionByName(fed(own.select("conv").distinct(), "active", at, number, block=F.lit(-1)))
            if closed:
                own = attached(own, closed, ["conv"], "salt", "left")
            feed = feed.unionByName(fed(own, "turn", at, number, closed=F.col("closed_in").isNotNull() if closed else F.lit(False)))
        if closed:
            feed = feed.unionByName(fed(blocks.join(closed.where(F.col("closed_in") == b - 1), "conv"), "closed", at, F.col("closed_in")))
        # A batch has a share of the rows, and as many of the partitions will do for it.
        feed.coalesce(max(1, partitions(spark) // batches)).write.mode("append").parquet(f"{folder}/in")
        start()
    return spark.read.schema(EVENTS).parquet(f"{folder}/out")


def gates(full: DataFrame) -> DataFrame:
    """conv, block, gate: in which batch all blocks before a block were full, of blocks behind full ones. full: conv, block, batch.

    Runs of full blocks are found within groups of GROUP blocks first, and then over whole groups.
    """
    full = full.select("conv", "block", "batch", F.floor(F.col("block") / GROUP).alias("group"))
    so_far = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    inside = full.withColumns({"n": F.count("*").over(so_far("conv", "group", "block")), "gate": F.max("batch").over(so_far("conv", "group", "block"))})
    inside = inside.where(F.col("n") == F.col("block") % GROUP + 1)
    whole = full.groupBy("conv", "group").agg(F.count("*").alias("n"), F.max("batch").alias("batch")).where(F.col("n") == GROUP)
    whole = whole.select("conv", "group", F.count("*").over(so_far("conv", "group")).alias("k"), F.max("batch").over(so_far("conv", "group")).alias("before"))
    whole = whole.where(F.col("k") == F.col("group") + 1).select("conv", (F.col("group") + 1).alias("group"), "before")
    out = inside.join(whole, ["conv", "group"], "left").where("group = 0 OR before IS NOT NULL")
    return out.select("conv", (F.col("block") + 1).alias("block"), F.greatest("gate", "before").alias("gate"))


def reassembled(rows: DataFrame, batches: int = BATCHES, span: int = SPAN) -> DataFrame:
    """event (release, reject, close), conv_id, turn (-1 of close), batch, payload (of close: the turns kept and never released, joined
    by commas), n_missing, n_breaks (of close only)."""
    found = events(rows, batches, span)
    of = lambda kind: found.where(F.col("kind") == kind)
    gate = gates(of("full"))
    free = of("release").join(gate, ["conv", "block"], "left").where("block = 0 OR gate IS NOT NULL")
    none = F.lit(None).cast("long")
    free = free.select(F.lit("release").alias("event"), "conv", "turn", F.greatest("batch", "gate").alias("batch"), "payload", none.alias("n_missing"), none.alias("n_breaks"))
    late = of("reject").select(F.lit("reject").alias("event"), "conv", "turn", "batch", "payload", none.alias("n_missing"), none.alias("n_breaks"))

    parts = of("fragment").join(gate, ["conv", "block"], "left")
    kept = F.col("upto") - F.col("turn") + 1
    ends = parts.select("conv", (F.col("upto") + 1).alias("turn"), F.col("tail").alias("before"))
    joined = parts.join(ends, ["conv", "turn"], "left")  # fragments that meet where blocks do
    sums = joined.groupBy("conv").agg((F.max("upto") - F.min("first") + 1 - F.sum(kept)).alias("n_missing"), F.sum(F.col("breaks") + F.coalesce(F.col("before") == F.col("head"), F.lit(False)).cast("long")).alias("n_breaks"))
    waiting = parts.where("NOT run OR (block > 0 AND gate IS NULL)").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "upto"))).alias("x"))
    listed = F.array_join(F.transform("x", lambda x: F.array_join(F.sequence(x["turn"], x["upto"]), ",")), ",")
    closes = of("close").select("conv", "batch").join(sums, "conv").join(waiting, "conv", "left")
    closes = closes.select(F.lit("close").alias("event"), "conv", F.lit(-1).cast("long").alias("turn"), "batch", F.coalesce(listed, F.lit("")).alias("payload"), "n_missing", "n_breaks")
    out = free.unionByName(late).unionByName(closes)
    conv = F.nullif(F.col("conv"), F.lit("")).cast(rows.schema["conv_id"].dataType)
    return out.select("event", conv.alias("conv_id"), "turn", F.col("batch").cast("long").alias("batch"), "payload", "n_missing", "n_breaks")


def digest(rows: DataFrame) -> DataFrame:
    """reassembled with the SHA-256 of the payload in its place."""
    out = reassembled(rows)
    return out.select("event", "conv_id", "turn", "batch", F.sha2("payload", 256).alias("sha256"), "n_missing", "n_breaks")
