"""Source divergence audit: how far the sources of a language lie apart by their terms, counted by DuckDB in shards.

Each task counts the terms of its documents in DuckDB (lang, source, term, occurrences, documents), which makes the rows that are
shuffled few; shards by hash of language and term add them up, again in DuckDB, and keep the terms that enough documents have. Spark sums
the totals of sources and languages and joins them to the counts. A second pass over the shards sums, for each pair of sources, what
the terms that both have add to the pair's value, and ranks the terms of a source within the shard. Spark merges sums and rankings.

A pair's value is a sum over all kept terms, most of which a source may not have. With f(p, q) the value of a term, p0 and q0 the
smoothed share of a term that the source lacks, and V kept terms, it is exactly
  V f(p0, q0) + sum over terms of the one [f(p, q0) - f(p0, q0)] + sum over terms of the other [f(p0, q) - f(p0, q0)]
  + sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)],
of which only the last part needs a term's rows together, and the middle two depend on how many terms a source has with each count.

A source with any share of the rows is counted in many tasks and shards; its totals come to its counts through a salt of the term.
DuckDB adds up what it holds after COMPACT rows, and a task of the first pass emits it then.

Defined cases: null text, lang and source are empty; a text without terms adds none, but its source takes part; a very long text is
counted whole; repeated rows count each; extra columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import attached, joined_within, partitions, slices, stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents of a language that a kept term is in; parts of a share's unit; terms ranked for a source.
LEAST_DOCS, UNIT, RANKS = 10, 1_000_000_000, 10
#: Bytes of text a query of the first pass takes, rows after which a task adds up what it holds, rows of a batch that leaves it.
TEXT, COMPACT, BATCH = 8 << 20, 2_000_000, 50_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
SUMS = "lang string, source string, item string, value long, part string"


def batches_of(found: duckdb.DuckDBPyRelation, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in found.to_arrow_reader(BATCH):
        yield from pa.Table.from_batches([batch]).cast(schema).to_batches()


def database() -> duckdb.DuckDBPyConnection:
    """A database in memory, on the task's one core; it writes no files."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


class Held:
    """Counts in DuckDB that are added up whenever they have grown by COMPACT rows."""

    def __init__(self) -> None:
        self.con = database()
        self.con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT)")
        self.rows = 0

    def add(self, table: pa.Table | pa.RecordBatch, sql: str) -> None:
        self.con.register("given", table if isinstance(table, pa.Table) else pa.Table.from_batches([table]))
        self.rows += self.con.execute(f"INSERT INTO held {sql}").fetchone()[0]
        self.con.unregister("given")

    def full(self) -> bool:
        return self.rows > COMPACT

    def compact(self) -> None:
        self.con.execute("CREATE OR REPLACE TABLE added AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM held GROUP BY ALL")
        self.con.execute("DROP TABLE held")
        self.con.execute("ALTER TABLE added RENAME TO held")
        self.rows = 0

    def emptied(self) -> Iterator[pa.RecordBatch]:
        self.compact()
        yield from batches_of(self.con.sql("FROM held"), COUNTS)
        self.con.execute("TRUNCATE held")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, d of the documents (lang, source, text) of a task."""
    held = Held()
    for batch in slices(batches, "text", TEXT):
        table = pa.Table.from_batches([batch]).append_column("r", pa.array(np.arange(batch.num_rows)))
        held.add(
            table,
            f"""SELECT lang, source, term, sum(n), count(*) FROM (
  SELECT r, lang, source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM given) GROUP BY ALL) GROUP BY lang, source, term""",
        )
        if held.full():
            yield from held.emptied()
    yield from held.emptied()


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counts of a shard, of the terms that LEAST_DOCS documents of their language have."""
    held = Held()
    for batch in batches:
        held.add(batch, "SELECT lang, source, term, n, d FROM given")
        if held.full():
            held.compact()
    held.compact()
    enough = f"SELECT * FROM held QUALIFY sum(d) OVER (PARTITION BY lang, term) >= {LEAST_DOCS}"
    yield from batches_of(held.con.sql(enough), COUNTS)


#: The value of a term with shares p and q; p0 and q0 are those of a term without occurrences.
VALUE = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard's counts with their totals: the part of each pair's value that needs both sources' counts of a term, and the best
    terms of each source."""
    con = database()
    con.execute("CREATE TABLE c (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, size BIGINT, lang_size BIGINT)")
    for batch in batches:
        con.register("given", pa.Table.from_batches([batch]))
        con.execute("INSERT INTO c SELECT lang, source, term, n, size, lang_size FROM given")
        con.unregister("given")
    share = lambda n, size: f"(1 + ({UNIT}::HUGEINT * ({n} + 2)) // {size})::BIGINT"
    con.execute(f"CREATE TABLE s AS SELECT lang, source, term, {share('n', 'size')} AS p, {share('0', 'size')} AS p0, {share('sum(n) OVER (PARTITION BY lang, term)', 'lang_size')} AS q FROM c")
    f = lambda p, q: VALUE.format(p=p, q=q)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("part", pa.string())])
    yield from batches_of(
        con.sql(f"""SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")})::BIGINT AS value, 'pair' AS part
FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL"""),
        schema,
    )
    yield from batches_of(
        con.sql(f"""SELECT lang, source, term AS item, {f("p", "q")} AS value, 'term' AS part FROM s WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {RANKS}"""),
        schema,
    )


def share(n: Column, size: Column) -> Column:
    wide = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, size.cast("decimal(20,0)")) + 1


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audited(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank of each source of a language."""
    shards = partitions(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    kinds = "lang string, source string, term string, n long, d long"
    counts = rows.mapInArrow(counted, kinds).repartition(shards, "lang", "term").mapInArrow(kept, kinds)
    counts = stored(counts.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("salt")), "term-counts")

    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(terms, "lang")
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    size = lambda n: F.coalesce(F.col(n), F.lit(0)) + 2 * F.coalesce("v", F.lit(0))
    groups = stored(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), size("n").alias("size"), size("lang_n").alias("lang_size")), "groups")

    of_term = attached(counts, groups.select("lang", "source", "size", "lang_size"), ["lang", "source"], "salt")
    sums = stored(of_term.select("lang", "source", "term", "n", "size", "lang_size").repartition(shards, "lang", "term").mapInArrow(paired, SUMS), "shard-sums")

    none = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("size")))
    bare = groups.select("lang", F.col("source").alias("item"), none.alias("q0"))
    base = joined_within(groups.select("lang", "source", "v", none.alias("p0")), bare, ["lang"]).where("source <> item")
    base = base.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * value(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    alike = of_term.groupBy("lang", "source", "n", "size").agg(F.count("*").alias("terms"))
    alike = alike.select("lang", "source", "terms", share(F.col("n"), F.col("size")).alias("p"), share(F.lit(0).cast("long"), F.col("size")).alias("p0"))
    ones = joined_within(alike, bare, ["lang"]).where("source <> item")
    ones = ones.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (value(F.col("p"), F.col("q0")) - value(F.col("p0"), F.col("q0")))).alias("value"))
    both = ones.unionByName(sums.where("part = 'pair'").drop("part"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = base.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(sums.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return out.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= RANKS))


AUDIT_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text FROM documents
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(d) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
t AS (SELECT c.lang, c.source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
s AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v))::HUGEINT AS p,
    (1 + ({UNIT}::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v))::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM s x JOIN s y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {RANKS}
"""
