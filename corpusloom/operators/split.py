"""Whole groups to train, val and test; greedy deduplication across the bounds; the audit."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from .lineage import checkpointed, discard

UNKNOWN = "<unknown>"
KEYS = ("input_key", "output_key")


def group_of(column: str):
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(UNKNOWN))


def assignment_plan(sizes: list[tuple[int, int]], lacks: dict[str, Fraction]) -> list[tuple[int, int, int, list[str]]]:
    """(size, first, last, names) for groups counted by size, (size, how many), largest first: the groups of that size from `first` to
    `last`, counted in order, go to the names in turn. lacks: what each split lacks at first.

    A group goes to the split that lacks most, the first by name at a tie. For groups of one size, splits take turns while what they lack
    is within that size, and all that they take before the next split comes in is one step: a handful of steps a size, however many
    groups it has.
    """
    out, lacks = [], dict(lacks)
    for size, many in sizes:
        at = 0
        while at < many:
            order = sorted(lacks, key=lambda x: (-lacks[x], x))
            before = lambda a, less, b: (-(lacks[a] - less), a) < (-lacks[b], b)  # a, with that much less, still goes before b
            for k in range(len(order), 0, -1):
                # The first k take turns if the first, having had one, comes after the last of them.
                if before(order[0], size, order[k - 1]) and k > 1:
                    continue
                if k == len(order):
                    turns = -(-(many - at) // k)
                else:
                    gap = (lacks[order[k - 1]] - lacks[order[k]]) / size
                    turns = int(gap) + (1 if gap != int(gap) or order[k - 1] < order[k] else 0)
                if turns:
                    break
            took = min(many - at, k * turns)
            out.append((size, at, at + took - 1, order[:k]))
            for place, name in enumerate(order[:k]):
                lacks[name] -= size * (took // k + (place < took % k))
            at += took
    return out


def assign_groups(rows: DataFrame, column: str, fractions: dict[str, float] | None = None) -> DataFrame:
    """work, n, split, work_rank: largest groups first, each to the split furthest below its target; unknown groups go to train.

    The splits are planned for the numbers of groups of each size, which are no more than the root of twice the rows, and groups get theirs
    by their place in the order, which is found by a sort and the sums of its parts: no task goes through all groups.
    """
    fractions = fractions or {"train": 0.8, "val": 0.1, "test": 0.1}
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError("the fractions do not add up to 1")
    spark = rows.sparkSession
    works = checkpointed(rows.groupBy(group_of(column).alias("work")).agg(F.count("*").alias("n")))
    counted = works.where(F.col("work") != UNKNOWN).groupBy("n").agg(F.count("*").alias("many")).orderBy(F.col("n").desc()).collect()
    unknown = (works.where(F.col("work") == UNKNOWN).agg(F.sum("n")).first()[0]) or 0
    total = unknown + sum(r["n"] * r["many"] for r in counted)
    lacks = {name: Fraction(total * share) for name, share in fractions.items()}
    if unknown:
        lacks["train"] -= unknown
    steps = assignment_plan([(r["n"], r["many"]) for r in counted], lacks)
    starts, place = {}, int(unknown > 0)
    for r in counted:
        starts[r["n"]] = place
        place += r["many"]

    order = [(F.col("work") == UNKNOWN).desc(), F.col("n").desc(), F.col("work")]
    placed = checkpointed(works.orderBy(*order).withColumn("id", F.monotonically_increasing_id()))
    placed = placed.select("work", "n", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    parts = placed.groupBy("part").agg(F.count("*").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a part
    ranked = placed.join(F.broadcast(parts), "part").select("work", "n", (F.col("at") + F.col("before")).alias("work_rank"))
    plan = spark.createDataFrame([(n, starts[n] + a, starts[n] + b, names) for n, a, b, names in steps], "n long, first long, last long, names array<string>")
    turn = F.element_at("names", ((F.col("work_rank") - F.col("first")) % F.size("names") + 1).cast("int"))
    known = ranked.where(F.col("work") != UNKNOWN).join(F.broadcast(plan), "n").where("work_rank BETWEEN first AND last").select("work", "n", turn.alias("split"), "work_rank")
    return ranked.where(F.col("work") == UNKNOWN).select("work", "n", F.lit("train").alias("split"), "work_rank").unionByName(known)


#: An assignment is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 100_000


def with_split(rows: DataFrame, column: str, assignment: DataFrame) -> DataFrame:
    """Adds work, split and work_rank; a large assignment is shuffled, a small one is sent to all."""
    own = assignment.select("work", "split", "work_rank")
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return rows.withColumn("work", group_of(column)).join(own, "work")


def keyed(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Adds input_key and output_key."""
    return rows.withColumns({"input_key": T.normalize_key(F.col(source)), "output_key": T.normalize_key(F.col(target))})


#: Rounds of drop_seen before chains are looked for.
ROUNDS = 4


def drop_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows: split, input_key, output_key and an order. All of train stays; of val, then test, a row stays if no row that stays
    before it has either key.

    A round settles the rows that come first among the live ones by both keys, which stay, and drops all that share a key with one. In
    chains, where each row shares a key with the one before it, that would take a round for every two rows; so after ROUNDS rounds also the
    rows that have one earlier live row in all are settled: such a row stays if that one goes, and the row at the chain's beginning is found
    by doubling pointers. Rounds end when no row is live. All is done by aggregations and joins on the keys themselves, none by one task.
    """
    train = rows.where("split = 'train'")
    rank = F.when(F.col("split") == "val", 0).otherwise(1)
    live = rows.where("split <> 'train'").select("*", F.struct(rank.alias("r"), *order, F.monotonically_increasing_id().alias("row")).alias("_at"))
    for key in KEYS:
        live = live.join(train.select(key).distinct(), key, "left_anti")
    whole = checkpointed(live)
    # The rounds need the keys and the order only.
    live, kept, k = checkpointed(whole.select("_at", *KEYS)), [], 0
    while not live.isEmpty():
        k += 1
        first = [live.groupBy(key).agg(F.min("_at").alias("_at")) for key in KEYS]  # one row a key
        both = checkpointed(first[0].join(first[1], "_at"))
        stays, gone = both.select("_at", *KEYS), None
        if k > ROUNDS:
            settled = _chains(live, both)
            if settled is not None:
                stays = checkpointed(stays.unionByName(live.join(settled.where("stays").select("_at"), "_at", "left_semi").select("_at", *KEYS)))
                gone = settled.where("NOT stays").select("_at")
        kept.append(stays)
        left = live if gone is None else live.join(gone, "_at", "left_anti")
        for key in KEYS:
            left = left.join(stays.select(key), key, "left_anti")
        left = checkpointed(left)
        discard(live)
        live = left
    out = train
    if kept:
        at = reduce(DataFrame.unionByName, (x.select("_at") for x in kept))
        out = out.unionByName(whole.join(at, "_at", "left_semi").drop("_at"))
    return out


def _chains(live: DataFrame, both: DataFrame) -> DataFrame | None:
    """_at, stays of the live rows that are settled by a chain of rows with one earlier live row each, down to one that comes first by
    both keys; None if there is no such chain of two."""
    firsts, seconds = [], []
    for key in KEYS:
        first = live.groupBy(key).agg(F.min("_at").alias("first"))
        second = live.join(first, key).where(F.col("_at") > F.col("first")).groupBy(key).agg(F.min("_at").alias("second"))
        firsts.append(first.withColumnRenamed("first", f"first_{key}"))
        seconds.append(second.withColumnRenamed("second", f"second_{key}"))
    # Only the first two rows of a key can have one earlier row at most, so each key gives two rows, however many it has.
    few = None
    for first, second, key in zip(firsts, seconds, KEYS, strict=True):
        named = first.join(second, key, "left")
        at = named.select(F.explode(F.array(f"first_{key}", f"second_{key}")).alias("_at"), F.col(f"first_{key}").alias(f"before_{key}")).where("_at IS NOT NULL")
        few = at if few is None else few.join(at, "_at")
    before = [F.when(F.col("_at") != F.col(f"before_{key}"), F.col(f"before_{key}")) for key in KEYS]
    few = few.select("_at", before[0].alias("a"), before[1].alias("b")).where("(a IS NULL) <> (b IS NULL) OR a = b")
    links = checkpointed(few.select("_at", F.coalesce("a", "b").alias("to"), F.lit(True).alias("odd")))
    if links.join(links.select(F.col("_at").alias("to")), "to", "left_semi").isEmpty():
        return None
    while True:
        further = links.select(F.col("_at").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        doubled = links.join(further, "to", "left").select("_at", F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved"))
        doubled = checkpointed(doubled)
        moved = not doubled.where("moved").isEmpty()
        discard(links)
        links = doubled.drop("moved")
        links._path = doubled._path
        if not moved:
            break
    return links.join(both.select(F.col("_at").alias("to")), "to", "left_semi").select("_at", (~F.col("odd")).alias("stays"))


def audit(rows: DataFrame) -> DataFrame:
    """split, side, n: distinct keys of val and test that train has as well; one aggregation for both sides and all splits."""
    sides = F.explode(F.array(*(F.struct(F.lit(k.removesuffix("_key")).alias("side"), F.col(k).alias("key")) for k in KEYS)))
    found = rows.select("split", sides.alias("s")).select("split", "s.*").groupBy("side", "key").agg(F.collect_set("split").alias("splits"))
    found = found.where(F.array_contains("splits", "train")).select("side", F.explode("splits").alias("split")).where("split <> 'train'")
    return found.groupBy("split", "side").agg(F.count("*").alias("n"))


def assert_no_leaks(rows: DataFrame) -> None:
    if leaks := audit(rows).collect():
        raise ValueError(f"keys of train in other splits: {leaks}")


def split_counts(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def dedup_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """split, n_before, n_final, n_dropped, ratio (of the final rows) of each split before and after drop_seen."""
    counts = before.groupBy("split").agg(F.count("*").alias("n_before")).join(after.groupBy("split").agg(F.count("*").alias("n")), "split", "left")
    counts = counts.select("split", "n_before", F.coalesce("n", F.lit(0)).alias("n_final"))
    ratio = F.round(F.try_divide(F.col("n_final"), F.sum("n_final").over(Window.partitionBy())), 4)
    return counts.select("*", (F.col("n_before") - F.col("n_final")).alias("n_dropped"), ratio.alias("ratio"))
