"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with token share p gets weight p**a, normalised. The exponent a is bisected in [0, 1]: to the flattest mixture that meets
the repetition limit, or to the one with the target entropy if there is one, unless that needs more repetition. The target may be given in
nats, or by its place between the entropy of the sources' own shares (0) and that of equal ones (1), which is a mixture that really lies
between them on any table whose sources are not equal. `solution` gives the exponent and what it reaches. The documents of a source are dealt by hash to blocks of about `block_tokens` tokens, LEAST_BLOCKS of them at least, so that small
sources are permuted as well. An epoch of a source is a permutation of its blocks by hash; its budget takes whole epochs and then a
part of one more: blocks in that epoch's order, and within the last block documents in hash order until the budget is met, so it is
missed by less than one document, or one group of repeated rows, which are taken alike.

Tokens are words between ASCII white space. Without a budget, it is the least with which no source goes short of one whole epoch
(`keep_all`), or else the number of tokens of the corpus.

Defined cases: a null source is a source of its own, named by an empty string; null and empty texts have no token, and like sources
without any token they are taken once an epoch; a very long text makes its block as long; repeated rows are taken alike; extra columns are kept by `mixed_documents`,
whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, joined_small, stored, text_of

SEED, BLOCK_TOKENS, LEAST_BLOCKS = 17, 1 << 20, 64
#: Halvings of the exponent's interval a pass: each evaluates all midpoints that they could meet, in one aggregation of the totals.
HALVINGS, PASSES = 5, 4


def keyed(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """The kept columns, _source, _tokens and _h, a hash of the row's doc_id and text."""
    return docs.select(*kept, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("_tokens"), F.xxhash64(F.col("doc_id"), text_of(), F.lit(SEED)).alias("_h"))


@dataclass(frozen=True)
class Target:
    """What a mixture is bisected to: the most epochs of a source, and an entropy in nats, or an evenness from 0 (that of the sources'
    own shares) to 1 (that of equal shares)."""

    max_epochs: float = 4.0
    entropy: float | None = None
    evenness: float | None = None


@dataclass(frozen=True)
class Solution:
    exponent: float
    entropy: float
    target: float | None
    epochs: float
    budget: float


def solve_exponent(totals: DataFrame, tokens: float, target: Target, budget: float | None, keep_all: bool) -> Solution:
    """The exponent for stored totals (_source, total), with the entropy, the most epochs of a source and the budget it makes."""
    share = F.col("total") / F.lit(float(tokens))

    def measures(exponents: list[float]) -> list[tuple[float, float, float]]:
        """Entropy, budget and most epochs of a source at each exponent."""
        columns = []
        for k, a in enumerate(exponents):
            p = F.pow(share, F.lit(a))
            columns += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log(p)).alias(f"l{k}"), F.max(F.col("total") / p).alias(f"b{k}"), F.max(p / F.col("total")).alias(f"e{k}")]
        row = totals.where("total > 0").agg(*columns).first()
        out = []
        for k in range(len(exponents)):
            z = row[f"z{k}"]
            size = row[f"b{k}"] * z if keep_all and not budget else float(budget or tokens)
            out.append((math.log(z) - row[f"l{k}"] / z, size, size * row[f"e{k}"] / z))
        return out

    def fits(m: tuple[float, float, float]) -> bool:
        return m[2] <= target.max_epochs * (1 + 1e-9)

    def bisect(holds) -> float:
        """The end of [0, 1] nearer to 1 of the interval at which `holds` turns true."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            n = 1 << HALVINGS
            grid = [low + (high - low) * k / n for k in range(n + 1)]
            known = dict(enumerate(map(holds, measures(grid))))
            a, b = 0, n
            if known[a]:
                return grid[a]
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if known[mid] else (mid, b)
            low, high = grid[a], grid[b]
        return high

    exponent = bisect(fits)
    entropy = target.entropy
    if target.evenness is not None:
        flat, own = (m[0] for m in measures([0.0, 1.0]))
        entropy = own + target.evenness * (flat - own)
    if entropy is not None:
        # Entropy falls as the exponent rises.
        exponent = max(exponent, bisect(lambda m: m[0] <= entropy))
    reached, size, epochs = measures([exponent])[0]
    return Solution(exponent, reached, entropy, epochs, size)


def solved(totals: DataFrame, target: Target, budget: float | None, keep_all: bool) -> tuple[int, Solution]:
    """(tokens, solution) of stored totals; without any token the exponent is 1."""
    tokens = totals.agg(F.sum("total")).first()[0] or 0
    return tokens, solve_exponent(totals, tokens, target, budget, keep_all) if tokens else Solution(1.0, 0.0, None, 0.0, 0.0)


def totals_of(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("_source").agg(F.sum("_tokens").alias("total")), "mix-totals")


def solution(docs: DataFrame, target: Target, budget: float | None = None, keep_all: bool = False) -> Solution:
    return solved(totals_of(keyed(docs, [])), target, budget, keep_all)[1]


def plan(rows: DataFrame, target: Target, budget: float | None, keep_all: bool, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks) for stored keyed rows: each source's weight, epochs and number of blocks; each block's copies and cutoff."""
    totals = totals_of(rows)
    tokens, found = solved(totals, target, budget, keep_all)
    exponent, size, z = found.exponent, found.budget, 1.0
    if tokens:
        z = totals.where("total > 0").agg(F.sum(F.pow(F.col("total") / F.lit(float(tokens)), F.lit(exponent)))).first()[0]
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(float(max(tokens, 1))), F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    quota = F.round(weight * F.lit(size)).cast("long")
    blocks = F.greatest(F.ceil(F.col("total") / F.lit(block_tokens)), F.lit(LEAST_BLOCKS)).cast("long")
    sources = totals.select("_source", "total", weight.alias("weight"), F.when(F.col("total") > 0, quota).otherwise(0).alias("quota"), blocks.alias("n_blocks"))
    whole = F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(1)
    sources = sources.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("total"))
    sources = stored(sources, "mix-sources")
    dealt = joined_small(rows, sources, ["_source"]).withColumn("_block", F.pmod("_h", "n_blocks"))
    order = Window.partitionBy("_source").orderBy(F.xxhash64("_source", "_block", "whole", F.lit(SEED)), "_block")  # a row a block
    sums = dealt.groupBy("_source", "_block").agg(F.sum("_tokens").alias("n"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    sums = stored(sums.select("_source", "_block", "whole", (F.col("before") + F.col("n") <= F.col("rest")).alias("taken"), (F.col("rest") - F.col("before")).alias("room")), "mix-blocks")
    partly = sums.where("not taken and room > 0").select("_source", "_block", "room")  # at most one block a source
    inside = joined_small(dealt.select("_source", "_block", "_tokens", "_h"), stored(partly, "mix-partly"), ["_source", "_block"])
    inside = inside.groupBy("_source", "_block", "room", draw("_h").alias("draw")).agg(F.sum("_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    cutoff = inside.withColumn("upto", upto).where("upto <= room").groupBy("_source", "_block").agg(F.max("draw").alias("cutoff"))
    # The place of each block in every epoch that its source enters; the order of the last one is that of the sums above.
    entered = sums.select("_source", "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"))
    order = Window.partitionBy("_source", "epoch").orderBy(F.xxhash64("_source", "_block", "epoch", F.lit(SEED)), "_block")
    entered = entered.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    places = entered.groupBy("_source", "_block").agg(F.sort_array(F.collect_list(F.struct("epoch", "position"))).alias("places"))
    blocks = sums.join(cutoff, ["_source", "_block"], "left").join(places, ["_source", "_block"])
    return sources, stored(blocks.select("_source", "_block", "whole", "taken", "cutoff", "places"), "mix-copies")


def draw(h: str) -> Column:
    return F.xxhash64(h, F.lit(SEED + 1))


def with_copies(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    out = joined_small(rows, sources.select("_source", "n_blocks", "total", "weight", "quota"), ["_source"]).withColumn("_block", F.pmod("_h", "n_blocks"))
    out = joined_small(out, blocks, ["_source", "_block"])
    more = F.col("taken") | F.coalesce(draw("_h") <= F.col("cutoff"), F.lit(False))
    out = out.withColumn("copies", (F.col("whole") + F.when(more & (F.col("total") > 0), 1).otherwise(0)).cast("int"))
    return out.withColumn("places", F.slice("places", F.lit(1), F.col("copies")))


def schedule(docs: DataFrame, target: Target = Target(), budget: float | None = None, keep_all: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, n_tokens, block, weight, copies of each row, how often the mixture takes it; places, the epoch and the block's
    position in it for each copy; draw, by which the rows of a block are ordered. A source's order is by epoch, position, draw."""
    rows = stored(keyed(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "mix")
    out = with_copies(rows, *plan(rows, target, budget, keep_all, block_tokens))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_block").alias("block"), "weight", "copies", "places", draw("_h").alias("draw"))


def mixed_documents(docs: DataFrame, target: Target = Target(), budget: float | None = None, keep_all: bool = True, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents with their own columns, each as often as the mixture takes it, in no particular order (see schedule)."""
    small = stored(keyed(docs, []), "mix")
    sources, blocks = plan(small, target, budget, keep_all, block_tokens)
    rows = keyed(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")])
    out = with_copies(rows, sources, blocks).where("copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
