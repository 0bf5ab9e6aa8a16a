"""Register reports, overlap metrics, fertility and cost."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusloom.functions import text as T

from .lineage import checkpointed

# USD per million tokens, input and output; other models cost nothing.
PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1": (2.00, 8.00),
    "gpt-5.5": (5.00, 30.00),
    "claude-opus-4-8": (5.00, 25.00),
    "claude-opus-4-7": (5.00, 25.00),
    "claude-sonnet-4-6": (3.00, 15.00),
    "claude-haiku-4-5": (1.00, 5.00),
    "claude-fable-5": (10.00, 50.00),
}


def featured(rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows that are not blank, with the register features as columns."""
    out = rows.where(~T.is_blank(F.col(column))).withColumn("_f", F.array(T.features(F.col(column))))
    return out.select(*rows.columns, F.inline("_f"))  # a generator, so that no feature is worked out again for each column


def centroid(rows: DataFrame) -> DataFrame:
    """One row: n_segments and for each feature f: f_mean, f_std (sample; 1e-9 at least)."""
    out = [F.count("*").alias("n_segments")]
    for f in T.FEATURES:
        out += [F.avg(f).alias(f"{f}_mean"), F.greatest(F.coalesce(F.stddev_samp(f), F.lit(0.0)), F.lit(1e-9)).alias(f"{f}_std")]
    return rows.agg(*out)


def report(rows: DataFrame, by: str) -> DataFrame:
    """by, n, and for each feature f: f_mean, f_sd (sample; 0 for a single text)."""
    out = [F.count("*").alias("n")]
    for f in T.FEATURES:
        out += [F.avg(f).alias(f"{f}_mean"), F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}_sd")]
    return rows.groupBy(by).agg(*out)


def with_distance(reports: DataFrame, center: DataFrame) -> DataFrame:
    """Adds stylo_dist, the standardized distance of a report's means to the centroid."""
    one = center.select(*(F.col(c).alias(f"_{c}") for c in center.columns))  # one row
    total = sum((F.pow((F.col(f"{f}_mean") - F.col(f"_{f}_mean")) / F.col(f"_{f}_std"), F.lit(2.0)) for f in T.FEATURES), F.lit(0.0))
    return reports.crossJoin(F.broadcast(one)).withColumn("stylo_dist", F.sqrt(total)).select(*reports.columns, "stylo_dist")


def marker_rate(rows: DataFrame, by: str, column: str = "text") -> DataFrame:
    """by, n, marker_rate: hits a segment; null and blank segments count as segments without hits."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(T.marker_hits(F.coalesce(F.col(column), F.lit("")))).alias("marker_rate"))


def tokens_13a(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("<skipped>"), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, "-\n", ""), "\n", " ")
    for code, to in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(code), F.lit(to))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, to in ((r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{20}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        c = F.regexp_replace(c, pattern, to)
    return F.filter(F.split(c, f"{T.WS}+", -1), lambda x: x != "")


def shared_ngrams(hyp: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray], orders: int) -> np.ndarray:
    """For segment and order 1 to orders: n-grams in common (each as often as the side that has it less often), of the hypothesis, of the
    reference. A side is (codes of its units, below 2**31, in a row; bounds of the segments)."""
    codes = np.concatenate([hyp[0], ref[0]]).astype(np.int64)
    n = len(hyp[1]) - 1
    sizes = np.concatenate([np.diff(hyp[1]), np.diff(ref[1])])
    segment = np.repeat(np.concatenate([np.arange(n)] * 2), sizes)
    is_ref = np.arange(len(codes)) >= len(hyp[0])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # units from here to the end of the segment
    out = np.zeros((n, orders, 3), np.int64)
    at, gram = np.arange(len(codes)), codes
    for order in range(1, orders + 1):
        if order > 1:  # an n-gram is the shorter one before its last unit, and that unit
            at = np.flatnonzero(left >= order)
            gram = known[at] << 31 | codes[at + order - 1]
        number = np.unique(gram, return_inverse=True)[1]
        known = np.zeros(len(codes), np.int64)
        known[at] = number
        count = []
        for k in (False, True):
            mine = at[is_ref[at] == k]
            keys, times = np.unique(segment[mine] * (len(codes) + 1) + known[mine], return_counts=True)
            count.append((keys, times))
            out[:, order - 1, 1 + k] = np.bincount(segment[mine], minlength=n)
        both, x, y = np.intersect1d(count[0][0], count[1][0], assume_unique=True, return_indices=True)
        np.add.at(out[:, order - 1, 0], both // (len(codes) + 1), np.minimum(count[0][1][x], count[1][1][y]))
    return out


def _matches(rows: DataFrame, by: str, hyp: Column, ref: Column, orders: int) -> DataFrame:
    """by, n, matched, hyp_total, ref_total of strings or arrays of strings. All n-grams of a segment stay in its row; what is shuffled
    are three sums an order."""
    rows = rows.select(F.col(by).alias("_by"), hyp.alias("_h"), ref.alias("_r"))

    def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if pa.types.is_string(column.type):
            texts = [x.encode("utf-32-le") for x in column.to_pylist()]
            return np.frombuffer(b"".join(texts), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in texts])]).astype(np.int64)
        return column.flatten(), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sides = [units(batch.column(c)) for c in ("_h", "_r")]
                if not isinstance(sides[0][0], np.ndarray):
                    coded = pa.concat_arrays([s[0] for s in sides]).dictionary_encode().indices.to_numpy()
                    sides = [(coded[: len(sides[0][0])], sides[0][1]), (coded[len(sides[0][0]) :], sides[1][1])]
                got = shared_ngrams(*sides, orders).reshape(-1, 3)
                own = pa.array(np.repeat(np.arange(batch.num_rows), orders))
                n = pa.array(np.tile(np.arange(1, orders + 1, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column("_by").take(own), n, *(pa.array(got[:, c].copy()) for c in range(3))], ["_by", "n", "matched", "hyp_total", "ref_total"])

    schema = StructType([rows.schema["_by"], StructField("n", IntegerType()), *(StructField(c, LongType()) for c in ("matched", "hyp_total", "ref_total"))])
    sums = [F.sum(c).alias(c) for c in ("matched", "hyp_total", "ref_total")]
    return rows.mapInArrow(run, schema).groupBy(F.col("_by").alias(by), "n").agg(*sums)


def bleu(rows: DataFrame, by: str, hyp: str, ref: str) -> DataFrame:
    """by, bleu: corpus score with orders 1 to 4, exponential smoothing and brevity penalty."""
    got = _matches(rows, by, tokens_13a(F.col(hyp)), tokens_13a(F.col(ref)), 4)
    got = got.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("n", F.col("matched").alias("m"), F.col("hyp_total").alias("t"), F.col("ref_total").alias("r")))).alias("o"))
    orders = F.filter("o", lambda x: x["t"] > 0)
    start = F.struct(F.lit(1.0).alias("smooth"), F.lit(0.0).alias("log"))
    step = lambda s, x: F.struct(F.when(x["m"] == 0, s["smooth"] * 2).otherwise(s["smooth"]).alias("smooth"), (s["log"] + F.log(F.when(x["m"] == 0, 1 / (s["smooth"] * 2 * x["t"])).otherwise(x["m"] / x["t"]))).alias("log"))
    logs = F.aggregate(orders, start, step, lambda s: s["log"])
    first = F.get(F.col("o"), F.lit(0))
    penalty = F.when(first["t"] >= first["r"], 1.0).otherwise(F.exp(1 - first["r"] / first["t"]))
    some = (F.size(orders) == 4) & F.exists(orders, lambda x: x["m"] > 0)
    return got.select(by, F.when(some, 100 * penalty * F.exp(logs / 4)).otherwise(0.0).alias("bleu"))


def chrf(rows: DataFrame, by: str, hyp: str, ref: str) -> DataFrame:
    """by, chrf: corpus score over character orders 1 to 6 without white space, beta 2."""
    chars = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), T.WS, "")
    got = _matches(rows, by, chars(hyp), chars(ref), 6)
    some = (F.col("hyp_total") > 0) & (F.col("ref_total") > 0)
    got = got.groupBy(by).agg(F.avg(F.when(some, F.col("matched") / F.col("hyp_total"))).alias("p"), F.avg(F.when(some, F.col("matched") / F.col("ref_total"))).alias("r"))
    return got.select(by, F.when(F.col("p") + F.col("r") > 0, 500 * F.col("p") * F.col("r") / (4 * F.col("p") + F.col("r"))).otherwise(0.0).alias("chrf"))


def scores(rows: DataFrame, by: str, hyp: str, ref: str) -> DataFrame:
    """by, n, bleu, chrf, and the marker rates of the hypotheses and of the references: the row an evaluation reports for a condition."""
    rates = [marker_rate(rows, by, c).withColumnRenamed("marker_rate", f"{side}_marker_rate") for side, c in (("hyp", hyp), ("ref", ref))]
    return rates[0].join(rates[1].drop("n"), by).join(bleu(rows, by, hyp, ref), by).join(chrf(rows, by, hyp, ref), by).select(by, "n", "bleu", "chrf", "hyp_marker_rate", "ref_marker_rate")


def fertility(rows: DataFrame, by: str, column: str = "text", tokens: Column | None = None) -> DataFrame:
    """Tokens a word by group: of all, and mean, median, p90 (lower nearest rank) and greatest of the texts; texts without words do
    not count. The rank is taken from counts of equal values, so that no group is collected."""
    c = F.col(column)
    rows = rows.where(~T.is_blank(c)).select(by, T.word_count(c).cast("long").alias("words"), (T.token_count(c) if tokens is None else tokens).cast("long").alias("tokens"))
    rows = rows.withColumn("ratio", F.col("tokens") / F.col("words"))
    values = rows.groupBy(by, "ratio").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
    # Ranks are counted in steps of the ratio first, so that no task sorts all the values of a group.
    values = checkpointed(values.withColumn("step", F.floor(F.col("ratio") * 64)))
    steps = values.groupBy(by, "step").agg(F.sum("n").alias("of_step"))
    group = Window.partitionBy(by)
    steps = steps.select(by, "step", (F.sum("of_step").over(group.orderBy("step")) - F.col("of_step")).alias("before"), F.sum("of_step").over(group).alias("of"))
    values = values.join(steps, [by, "step"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(by, "step").orderBy("ratio")))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("ratio")))
    of = F.col("of")
    return values.groupBy(by).agg(
        F.sum("n").alias("n"),
        F.sum("words").alias("words"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.sum("words")).alias("fertility_corpus"),
        (F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("fertility_mean"),
        ((at(F.floor((of - 1) / 2)) + at(F.floor(of / 2))) / 2).alias("fertility_median"),
        at(F.floor(F.lit(0.9).cast("double") * (of - 1))).alias("fertility_p90"),
        F.max("ratio").alias("fertility_max"),
    )


def fertility_verdict(c: Column) -> Column:
    return F.when(c < 2.5, "LOCK IT").when(c < 4.0, "BORDERLINE").otherwise("CATASTROPHIC")


def usage(calls: DataFrame) -> DataFrame:
    """calls: condition, model, prompt_tokens, completion_tokens. condition, model, calls, tokens and cost in USD."""
    spark = calls.sparkSession
    prices = spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, _in double, _out double")
    total = calls.groupBy("condition", "model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    cost = (F.col("prompt_tokens") * F.coalesce("_in", F.lit(0.0)) + F.col("completion_tokens") * F.coalesce("_out", F.lit(0.0))) / 1e6
    return total.join(F.broadcast(prices), "model", "left").select("condition", "model", "calls", "prompt_tokens", "completion_tokens", F.round(cost, 4).alias("cost_usd"))


def feature_shift(rows: DataFrame, by: str, one: str, other: str) -> DataFrame:
    """feature, <one>_mean, <other>_mean, shift: how the mean register features of featured rows differ between two conditions."""
    means = report(rows.where(F.col(by).isin(one, other)), by)
    long = means.select(by, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("mean")) for f in T.FEATURES))))
    own = lambda name: F.max(F.when(F.col(by) == name, F.col("mean")))
    return long.groupBy("feature").agg(own(one).alias(f"{one}_mean"), own(other).alias(f"{other}_mean"), (own(other) - own(one)).alias("shift"))


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, n, rho: the rank correlation of two numeric columns, equal values with their mean rank. Values are counted first, so no
    group of rows is sorted in a task."""
    pairs = checkpointed(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("m")))

    def ranks(c: str) -> DataFrame:
        counts = pairs.groupBy(by, c).agg(F.sum("m").alias("of"))
        before = F.sum("of").over(Window.partitionBy(by).orderBy(c)) - F.col("of")  # over distinct values
        return counts.select(by, c, (before + (F.col("of") + 1) / 2).alias(f"r{c}"))

    both = pairs.join(ranks("x"), [by, "x"]).join(ranks("y"), [by, "y"])
    of = lambda c: F.sum(F.col("m") * c)
    n, sx, sy = F.sum("m"), of(F.col("rx")), of(F.col("ry"))
    sxx, syy, sxy = of(F.col("rx") * F.col("rx")), of(F.col("ry") * F.col("ry")), of(F.col("rx") * F.col("ry"))
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return both.groupBy(by).agg(n.alias("n"), F.try_divide(n * sxy - sx * sy, spread).alias("rho"))


#: Up to which uniform number a Poisson variable of mean one is 0, 1, 2, ...; beyond the last it counts one more.
POISSON = [sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(12)]
#: Odd multipliers and the step of a 64-bit mixing function; fixed values.
MIX, STEP = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15


def drawn_weights(h: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson weights of segments with hashes h, of 60 bits, in each replicate: from 53 bits of a mixed sum of both."""
    x = h.astype(np.uint64)[:, None] + replicates.astype(np.uint64)[None, :] * np.uint64(STEP)
    for m in MIX:
        x ^= x >> np.uint64(33)
        x *= np.uint64(m)
    x ^= x >> np.uint64(33)
    return np.searchsorted(np.array(POISSON), (x >> np.uint64(11)) / float(1 << 53), side="right")


def paired_bootstrap(rows: DataFrame, segment: str, one: str, other: str, replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """n, difference of the means of two scores of the same segments (other - one), and its low and high bound over resamples.

    Each replicate weighs a segment by a Poisson number drawn from the segment's hash and the replicate's number, the same wherever
    the segment lies. A task adds up all replicates in two vectors and gives a row a replicate, whatever it has read.
    """
    name = F.coalesce(F.col(segment).cast("string"), F.lit(""))
    scores = rows.select(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("h"), (F.col(other) - F.col(one)).cast("double").alias("d")).where("d IS NOT NULL")

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, replicates + 1)
        sums, sizes, some = np.zeros(replicates), np.zeros(replicates), False
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                w = drawn_weights(part.column("h").to_numpy(), numbers)
                sums += part.column("d").to_numpy() @ w
                sizes += w.sum(0)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(sums), pa.array(sizes)], names=["k", "d", "w"])

    means = scores.mapInArrow(resampled, "k long, d double, w double").groupBy("k").agg(F.try_divide(F.sum("d"), F.sum("w")).alias("mean"))
    edge = (1 - level) / 2
    bounds = means.agg(F.percentile("mean", F.lit(edge)).alias("low"), F.percentile("mean", F.lit(1 - edge)).alias("high"))
    return scores.agg(F.count("*").alias("n"), F.avg("d").alias("difference")).crossJoin(F.broadcast(bounds))  # one row each
