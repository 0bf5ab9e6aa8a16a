"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each metric of a document that passes the base rule goes into a mergeable quantile sketch of its language and source: counts of log-linear
buckets that keep the seven leading bits of a value, so a quantile is off by less than 1 in 64 and sketches merge by adding counts, in
any order and with the same result. A threshold lies FENCE times as far from the median as the metric's tail quantile does, beyond that quantile.
The quantiles of a group are drawn to those of its language, and these to those of all documents, as if PRIOR documents more had the
latter; so a large group has its own, a small one nearly its language's, and no size is a switch. There are no least spreads: where
nearly all documents have a metric of zero, the threshold is zero too. What a document may have beyond a threshold is a number of single
events (symbols, lines, words), as a share in a short text says little.

Defined cases: a null text has no words and fails the base rule, as does any text of under ten words; null lang or source count as
an empty string; a very long text is measured whole; repeated rows are judged alike and each one counts in the sketches; extra columns are kept by `kept_documents`,
whatever their names; an empty table gives no row. Five-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACE, joined_within, stored, text_of, whole_row

PRIOR, FENCE, WINDOW = 50, 2, 5
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Metric: what it counts, of what, its unit, the percentile of its tail, events allowed beyond a threshold, and whether low values are
#: fenced as well. Junk may be up to a quarter of a source's documents by symbols; repeats are rarer, but of any size.
RULES = {
    "symbol_share": ("n_symbols", "n_words", 1000, 75, 3, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000, 97, 1, False),
    "repeat_share": ("n_repeat_words", "n_words", 1000, 97, 2 * WINDOW, False),
    "word_length": ("word_chars", "n_words", 100, 95, 40, True),
}

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """The kept columns, the base counts of the text, and the metrics of RULES; needs columns text, lang, source in docs."""
    # Each select names what the next one uses more than once, so that nothing is computed twice.
    rows = docs.select(*kept, F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"), text_of().alias("_text"))
    bare = F.trim("_text", F.lit(ASCII_SPACE))
    names = [c for c in rows.columns if c != "_text"]
    rows = rows.select(*names, "_text", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+", -1)).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    names += ["n_words", "word_chars", "n_symbols"]
    windows = F.transform("_hashes", lambda h, i: F.xxhash64(h, *(F.get("_hashes", i + k) for k in range(1, WINDOW))))
    rows = rows.select(
        *names,
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.slice(windows, 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))).alias("_windows"),
    )
    names += ["n_lines", "n_dup_lines"]
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*names, F.when(some, placed).alias("_placed"))
    again = F.filter("_placed", lambda x, i: (x["h"] == F.get("_placed", i - 1)["h"]) | (x["h"] == F.get("_placed", i + 1)["h"]))
    rows = rows.select(*names, F.sort_array(F.transform(again, lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda n, x: n + x)
    rows = rows.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    rows = rows.withColumns(
        {m: F.floor(F.col(c) * unit / F.greatest(F.col(of), F.lit(1).cast("long"))).cast("long") for m, (c, of, unit, *_) in RULES.items()}
        | {"base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))}
    )
    # Through a generator, as a condition on a count would be worked out from the text once more below the steps above.
    others = [c for c in names if c not in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")]
    return rows.select(*others, F.explode(F.array(F.struct(*(c for c in rows.columns if c not in others)))).alias("_m")).select(*others, "_m.*")


def bucket(value: Column) -> Column:
    """The least value of the log-linear bucket of a non-negative whole number: its seven leading bits."""
    rest = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.expr("0L").bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", value, rest), rest))


def sketches(rows: DataFrame) -> DataFrame:
    """Bucket counts of every metric, of the documents that pass the base rule: _lang, _source, metric, bucket, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in RULES)))
    return rows.where(~F.col("base_failed")).select("_lang", "_source", pairs.alias("p")).select("_lang", "_source", "p.*").groupBy("_lang", "_source", "metric", "bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """_lang, _source and for each metric m: m_low, m_high; a row for each language and source."""
    levels = {"own": ["_lang", "_source"], "lang": ["_lang"], "all": []}
    tail = F.element_at(F.create_map(*(F.lit(x) for m, (_, _, _, percent, _, _) in RULES.items() for x in (m, percent))), F.col("metric"))
    tables = {}
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        merged = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "of": F.sum("n").over(group)})
        quantile = lambda k: F.min(F.when(100 * F.col("upto") >= k * F.col("of"), F.col("bucket")))
        found = {"low": quantile(100 - tail), "mid": quantile(50), "high": quantile(tail)}
        tables[level] = merged.groupBy(*keys, "metric").agg(*(q.alias(f"{level}_{name}") for name, q in found.items()), F.max("of").alias(f"{level}_n"))
    out = tables["own"].join(tables["lang"], ["_lang", "metric"]).join(tables["all"], ["metric"])
    drawn = lambda n, q, to: F.call_function("div", n * q + PRIOR * to, n + PRIOR)
    of_lang = lambda q: drawn(F.col("lang_n"), F.col(f"lang_{q}"), F.col(f"all_{q}"))
    out = out.select("_lang", "_source", "metric", *(drawn(F.col("own_n"), F.col(f"own_{q}"), of_lang(q)).alias(q) for q in ("low", "mid", "high")))
    own = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    columns = []
    for m in RULES:
        columns += [own(m, F.col("low") - FENCE * (F.col("mid") - F.col("low"))).alias(f"{m}_low"), own(m, F.col("high") + FENCE * (F.col("high") - F.col("mid"))).alias(f"{m}_high")]
    return out.groupBy("_lang", "_source").agg(*columns)


def fences(rows: DataFrame) -> DataFrame:
    """The thresholds of measured rows, stored."""
    return stored(thresholds(stored(sketches(rows), "quality-sketches")), "quality-thresholds")


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept to measured rows: not base_failed, and within the thresholds of their language and source."""
    within = F.lit(True)
    for m, (count, of, unit, _, events, low) in RULES.items():
        within &= unit * F.col(count) <= F.col(f"{m}_high") * F.col(of) + unit * events
        if low:
            within &= unit * F.col(count) >= F.col(f"{m}_low") * F.col(of) - unit * events
    return joined_within(rows, limits, ["_lang", "_source"], "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept of each row."""
    rows = stored(measured(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "quality")
    return judged(rows, fences(rows)).select("doc_id", *BASE, "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns: one reading for the thresholds and one that filters, where each text stays."""
    limits = fences(measured(docs, []))
    return judged(measured(docs, [whole_row(docs)]), limits).where("kept").select("_doc.*")


def verdicts_sql() -> str:
    """What `verdicts` returns, in DuckDB SQL."""
    share = {m: f"{count} * {unit} // greatest({of}, 1)" for m, (count, of, unit, *_) in RULES.items()}
    tails = " ".join(f"WHEN '{m}' THEN {tail}" for m, (_, _, _, tail, _, _) in RULES.items())
    limit = lambda m, side: f"max({side}) FILTER (metric = '{m}')"
    within = " AND ".join(f"{unit} * {count} <= {limit(m, 'high')} * {of} + {unit * events}" + (f" AND {unit} * {count} >= {limit(m, 'low')} * {of} - {unit * events}" if low else "") for m, (count, of, unit, _, events, low) in RULES.items())
    quantiles = lambda keys: ", ".join([*keys, "metric", *(f"min(bucket) FILTER (100 * upto >= {k} * total) AS {q}" for q, k in (("low", "(100 - tail)"), ("mid", "50"), ("high", "tail"))), "max(total) AS n"])
    levels = ""
    for level, keys in {"own": ["lang", "source"], "lang": ["lang"], "whole": []}.items():
        by = ", ".join([*keys, "metric"])
        levels += f"""by_{level} AS (SELECT {quantiles(keys)} FROM (
  SELECT *, CASE metric {tails} END AS tail, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {by}),
"""
    pick = lambda q: f"(o.n * o.{q} + {PRIOR} * ((l.n * l.{q} + {PRIOR} * a.{q}) // (l.n + {PRIOR}))) // (o.n + {PRIOR}) AS {q}"
    metrics = ", ".join(f"{sql} AS {m}" for m, sql in share.items())
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS j, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS g FROM d WHERE len(w) >= {WINDOW}
), starts AS (SELECT r, j FROM (SELECT r, j, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(after - j, {WINDOW}))) AS n FROM (SELECT r, j, lead(j) OVER (PARTITION BY r ORDER BY j) AS after FROM starts) GROUP BY r),
base AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)
), rows AS MATERIALIZED (SELECT *, {metrics}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
sketch AS (
  SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n
  FROM (UNPIVOT (SELECT lang, source, {", ".join(RULES)} FROM rows WHERE NOT base_failed) ON {", ".join(RULES)} INTO NAME metric VALUE v) GROUP BY ALL
), {levels}fences AS (
  SELECT lang, source, metric, low - {FENCE} * (mid - low) AS low, high + {FENCE} * (high - mid) AS high FROM (
    SELECT o.lang, o.source, metric, {", ".join(map(pick, ("low", "mid", "high")))} FROM by_own o JOIN by_lang l USING (lang, metric) JOIN by_whole a USING (metric))
)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND coalesce({within}, false) AS kept
FROM rows LEFT JOIN fences USING (lang, source) GROUP BY r, doc_id, {", ".join(BASE)}, n_lines, base_failed
"""
