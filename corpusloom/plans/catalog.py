"""Named queries over the supplied tables and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.words import FUNCTION_WORDS, MARKERS
from corpusloom.operators import cells, evaluate, generate, lexicon, prepare, retrieve, split
from corpusloom.operators.lineage import checkpointed, shared_folder
from corpusloom.plans import workflows
from corpusloom.sources import artifacts
from corpusloom.sources import pairs as files
from corpusloom.sources.tables import read_table as table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rough(c: str = "text"):
    """Texts with spaces before commas, and on even doc_ids doubled spaces, so that normalizing has work."""
    spaced = F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(", "), F.lit(" , "))
    return F.when(F.col("doc_id") % 2 == 0, F.replace(spaced, F.lit(" "), F.lit("  "))).otherwise(spaced)


ROUGH = "CASE WHEN doc_id % 2 = 0 THEN replace(replace(coalesce(text, ''), ', ', ' , '), ' ', '  ') ELSE replace(coalesce(text, ''), ', ', ' , ') END"
S = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NONBLANK = f"regexp_matches(text, '[^{S[1:]}')"
MASKED = r"regexp_replace(text, '[^\x00-\x7F]', 'z', 'g')"
HITS = rf"len(regexp_extract_all({MASKED}, '\b(?:{'|'.join(MARKERS)})\b'))"


def normal_sql(c: str) -> str:
    c = f"translate(nfc_normalize({c}), '“”‘’', '\"\"''''')"
    c = rf"regexp_replace({c}, '\r\n?|\n', ' ', 'g')"
    for pattern, to in ((f"{S}+([,.;:!?])", r"\1"), (rf"\({S}+", "("), (rf"{S}+\)", ")"), (f"{S}+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


def source_sql(c: str) -> str:
    c = rf"regexp_replace(translate(translate(nfc_normalize({c}), chr(8203) || chr(65279), ''), 'يكـ', 'یک'), '\r\n?|\n', ' ', 'g')"
    return f"trim(regexp_replace({c}, '{S}+', ' ', 'g'))"


def key_sql(c: str) -> str:
    c = f"replace(lower(nfc_normalize({c})), 'ß', 'ss')"
    return rf"trim(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_{S[1:-1]}]', ' ', 'g'), '{S}+', ' ', 'g'))"


FEATURED = f"""
WITH w AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS w,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+{S}+'), lambda s: len(regexp_extract_all(lower(s), '[a-z'']+'))), lambda x: x > 0) AS l,
  {HITS} AS hits FROM documents WHERE text IS NOT NULL AND {NONBLANK}),
f AS (SELECT doc_id, source, lang,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: NOT list_contains([{", ".join("'" + x + "'" for x in FUNCTION_WORDS)}], x))) / len(w)::DOUBLE END AS lex_density,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w)::DOUBLE END AS ttr,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / sqrt(len(w)) END AS root_ttr,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE list_avg(l) END AS sent_len_mean,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE list_var_pop(l) END AS sent_len_var,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE hits / len(w)::DOUBLE END AS marker_rate FROM w)"""

MEANS = ", ".join(f"avg({f}) AS {f}_mean, coalesce(stddev_samp({f}), 0.0) AS {f}_sd" for f in T.FEATURES)
ROUNDED = ", ".join(f"round({f}_mean, 4) AS {f}_mean, round({f}_sd, 4) AS {f}_sd" for f in T.FEATURES)
CENTER = ", ".join(f"avg({f}) AS {f}_mean, greatest(coalesce(stddev_samp({f}), 0.0), 1e-9) AS {f}_std" for f in T.FEATURES)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"{FEATURED}, r AS (SELECT source, count(*) AS n, {MEANS} FROM f GROUP BY source) SELECT source, n, {ROUNDED} FROM r")
def stylometric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.report(evaluate.featured(table(spark, sf_dir, "documents")), "source"))


@query(f"{FEATURED} SELECT doc_id, {', '.join(f'round({f}, 6) AS {f}' for f in T.FEATURES)} FROM f")
def stylometric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.featured(table(spark, sf_dir, "documents")).select("doc_id", *T.FEATURES), 6)


@query(f"{FEATURED} SELECT count(*) AS n_segments, {', '.join(f'round(avg({f}), 4) AS {f}_mean, round(greatest(coalesce(stddev_samp({f}), 0.0), 1e-9), 4) AS {f}_std' for f in T.FEATURES)} FROM f WHERE lang = 'en'")
def register_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return rounded(evaluate.centroid(evaluate.featured(docs)))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' features without their texts, worked out once for all that reads them."""
    return checkpointed(evaluate.featured(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", *T.FEATURES), "features")


@query(
    f"{FEATURED}, r AS (SELECT source, {MEANS} FROM f GROUP BY source), c AS (SELECT {CENTER} FROM f WHERE lang = 'en') SELECT source, round(sqrt("
    + " + ".join(f"pow((r.{f}_mean - c.{f}_mean) / c.{f}_std, 2)" for f in T.FEATURES)
    + "), 4) AS stylo_dist FROM r, c"
)
def register_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_features(spark, sf_dir)
    out = evaluate.with_distance(evaluate.report(rows, "source"), evaluate.centroid(rows.where("lang = 'en'")))
    return rounded(out.select("source", "stylo_dist"))


@query(f"SELECT source, count(*) AS n, round(avg({HITS}), 6) AS marker_rate FROM (SELECT source, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE coalesce(text, '') END AS text FROM documents) GROUP BY source")
def marker_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits a segment; the texts of every ninth document are made blank, which still count as segments."""
    texts = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    return rounded(evaluate.marker_rate(texts, "source"), 6)


@query(f"SELECT doc_id, sha256({normal_sql(ROUGH)}) AS text_sha256 FROM documents")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(rough(), is_source=False), 256).alias("text_sha256"))


#: Letters that source-mode normalization maps or removes, two invisible characters and U+FFFD, in place of some that the tables have.
LETTERS = ("ykqxjw", "يكـ\u200b\ufeff\ufffd")


@query(f"SELECT doc_id, sha256({source_sql(f"translate({ROUGH}, '{LETTERS[0]}', '{LETTERS[1]}')")}) AS text_sha256 FROM documents")
def normalized_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.translate(rough(), *LETTERS), is_source=True), 256).alias("text_sha256"))


@query(f"SELECT doc_id, sha256({key_sql(ROUGH)}) AS key_sha256 FROM documents")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_key(rough()), 256).alias("key_sha256"))


#: Whole groups to splits, as a recursion over the counted groups in order.
GROUPS = """w AS (SELECT coalesce(nullif(source, ''), '<unknown>') AS work, count(*) AS n FROM documents GROUP BY 1),
o AS (SELECT work, n, row_number() OVER (ORDER BY work = '<unknown>' DESC, n DESC, work) AS k FROM w), t AS (SELECT sum(n)::DOUBLE AS total FROM w),
f(k, work, n, split, a, b, c) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT
UNION ALL SELECT k, work, n, split, a + CASE WHEN split = 'train' THEN n ELSE 0 END, b + CASE WHEN split = 'val' THEN n ELSE 0 END, c + CASE WHEN split = 'test' THEN n ELSE 0 END
FROM (SELECT o.k, o.work, o.n, f.a, f.b, f.c, CASE WHEN o.work = '<unknown>' THEN 'train' WHEN f.c - total * 0.1::DOUBLE <= least(f.a - total * 0.8::DOUBLE, f.b - total * 0.1::DOUBLE) THEN 'test' WHEN f.a - total * 0.8::DOUBLE <= f.b - total * 0.1::DOUBLE THEN 'train' ELSE 'val' END AS split FROM f JOIN o ON o.k = f.k + 1, t))"""


@query(f"WITH RECURSIVE {GROUPS} SELECT work, n, split, k - 1 AS work_rank FROM f WHERE k > 0")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.assign_groups(table(spark, sf_dir, "documents"), "source")


@query(f"WITH RECURSIVE {GROUPS} SELECT doc_id, work, split, k - 1 AS work_rank FROM documents JOIN f ON work = coalesce(nullif(source, ''), '<unknown>') WHERE k > 0")
def rows_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the split of its source."""
    docs = table(spark, sf_dir, "documents")
    return split.with_split(docs, "source", split.assign_groups(docs, "source")).select("doc_id", "work", "split", "work_rank")


SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"


def word_keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first and the last word of the whole text's match key, in splits by the last digit of doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(SPLIT).alias("split"), T.normalize_key(F.col("text")).alias("key"))
    word = lambda k: F.substring_index("key", " ", k)
    return docs.select("doc_id", "split", word(1).alias("input_key"), word(-1).alias("output_key"))


KEYED = f"""w AS (SELECT doc_id, {SPLIT} AS split, string_split({key_sql("coalesce(text, '')")}, ' ') AS w FROM documents), k AS MATERIALIZED (SELECT doc_id, split, w[1] AS i, w[-1] AS o FROM w)"""


@query(
    f"""WITH {KEYED}
SELECT split, 'input' AS side, count(DISTINCT i) AS n FROM k WHERE split <> 'train' AND i IN (SELECT i FROM k WHERE split = 'train') GROUP BY split
UNION ALL SELECT split, 'output', count(DISTINCT o) FROM k WHERE split <> 'train' AND o IN (SELECT o FROM k WHERE split = 'train') GROUP BY split"""
)
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.audit(word_keyed_documents(spark, sf_dir))


#: The greedy scan as a recursion over the rows that share no key with train, in order.
SCAN = f"""{KEYED}, c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY split = 'test', doc_id) AS place FROM k WHERE split <> 'train' AND i NOT IN (SELECT i FROM k WHERE split = 'train') AND o NOT IN (SELECT o FROM k WHERE split = 'train')),
scan(place, doc_id, split, stays, ins, outs) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, false, []::VARCHAR[], []::VARCHAR[]
UNION ALL SELECT place, doc_id, split, stays, CASE WHEN stays THEN list_append(ins, i) ELSE ins END, CASE WHEN stays THEN list_append(outs, o) ELSE outs END
FROM (SELECT c.place, c.doc_id, c.split, c.i, c.o, ins, outs, NOT list_contains(ins, c.i) AND NOT list_contains(outs, c.o) AS stays FROM scan JOIN c ON c.place = scan.place + 1)),
final AS (SELECT doc_id, split FROM k WHERE split = 'train' UNION ALL SELECT doc_id, split FROM scan WHERE stays)"""


@query(f"WITH RECURSIVE {SCAN} SELECT doc_id, split FROM final")
def cross_boundary_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.drop_seen(checkpointed(word_keyed_documents(spark, sf_dir)), ["doc_id"]).select("doc_id", "split")


@query(
    f"""WITH RECURSIVE {SCAN}, n AS (SELECT split, count(*) AS n_before, (SELECT count(*) FROM final WHERE final.split = k.split) AS n_final FROM k GROUP BY split)
SELECT split, n_before, n_final, n_before - n_final AS n_dropped, round(n_final / sum(n_final) OVER (), 4) AS ratio FROM n"""
)
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(word_keyed_documents(spark, sf_dir))
    return split.dedup_counts(rows, split.drop_seen(rows, ["doc_id"]))


@query(
    f"SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS ratio FROM (SELECT {SPLIT} AS split FROM documents) GROUP BY split"
)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(table(spark, sf_dir, "documents").select(F.expr(SPLIT).alias("split")))


def neighbours(spark: SparkSession, sf_dir: str, k: int, asked: str = "vec_id % 20 = 0") -> DataFrame:
    """The k nearest of all rows for each row that meets a condition."""
    index = table(spark, sf_dir, "embeddings")
    return retrieve.cosine_topk(index.where(asked), index, k, "vec_id", "vec_id")


NEAR = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, i.vec_id AS row_id, list_cosine_similarity(q.v, i.v) AS score FROM e q, e i WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s)"""


@query(f"{NEAR} SELECT query_id, row_id, rank, round(score, 4) AS score FROM t WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours(spark, sf_dir, 5))


@query(
    """WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS MATERIALIZED (SELECT q.vec_id AS a, i.vec_id AS b, list_cosine_similarity(q.v, i.v) AS score FROM e q, e i),
f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s),
m AS (SELECT a, avg(score) AS mean FROM f WHERE k <= 8 GROUP BY a),
g AS (SELECT f.a AS query_id, f.b AS row_id, f.score, f.score / ((x.mean + y.mean) / 2) AS margin FROM f JOIN m x ON x.a = f.a JOIN m y ON y.a = f.b WHERE k <= 8)
SELECT query_id, row_id, round(score, 4) AS score, round(margin, 4) AS margin, row_number() OVER (PARTITION BY query_id ORDER BY margin DESC, row_id) AS rank FROM g"""
)
def margin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's neighbours ranked by cosine over the mean neighbour cosine of both sides, which one search of all rows gives."""
    found = checkpointed(neighbours(spark, sf_dir, 8, "true"), "neighbours")
    scored = retrieve.margin_scores(found, found)
    # Means of the same cosines may differ in the last bits, which would decide ties.
    order = Window.partitionBy("query_id").orderBy(F.round("margin", 12).desc(), "row_id")
    return rounded(scored.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "row_id", "score", "margin", "rank"))


#: As NEAR, for every row.
EACH_NEAR = NEAR.replace(" WHERE q.vec_id % 20 = 0", "")
TEXTS = "x AS (SELECT vec_id, 'row ' || vec_id AS input, 'label ' || label AS output FROM embeddings)"


@query(
    f"""{EACH_NEAR}, {TEXTS}, g AS (SELECT query_id, string_agg('Source: ' || x.input || chr(10) || 'English: ' || x.output || chr(10), chr(10) ORDER BY rank DESC) AS b FROM t JOIN x ON x.vec_id = row_id WHERE rank <= 4 GROUP BY query_id)
SELECT query_id, 'Here are example translations in the required style:' || chr(10) || chr(10) || b || chr(10) || 'Now translate the following text into English in the same style:' || chr(10) || chr(10) || 'Source: ' || x.input || chr(10) || 'English:' AS prompt FROM g JOIN x ON x.vec_id = query_id"""
)
def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("row "), F.col("vec_id")).alias("input"), F.concat(F.lit("label "), F.col("label")).alias("output"))
    found = neighbours(spark, sf_dir, 4, "true").join(texts.withColumnRenamed("vec_id", "row_id"), "row_id")
    own = F.sort_array(F.collect_list(F.struct("rank", "input", "output")))
    found = found.groupBy("query_id").agg(own.alias("exemplars"))
    out = found.join(texts.select(F.col("vec_id").alias("query_id"), "input"), "query_id")
    return out.select("query_id", retrieve.few_shot_prompt(F.col("input"), F.col("exemplars")).alias("prompt"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn behind them."""
    turns = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumns({"next_role": F.lead("role").over(after), "output": F.lead("text").over(after)})
    return turns.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("input"), "output", F.concat(F.lit("c"), F.col("conv_id") % 3).alias("condition"))


PAIRS = """WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS input, output, 'c' || (conv_id % 3) AS condition FROM n WHERE role = 'user' AND next_role = 'assistant')"""


@query(
    f"""{PAIRS}, q AS (SELECT conv_id, turn, {source_sql(f"translate(coalesce(input, ''), '{LETTERS[0]}', '{LETTERS[1]}')")} AS s, {normal_sql("coalesce(output, '')")} AS t FROM p),
r AS (SELECT *, list_filter([CASE WHEN t = '' OR s = '' THEN 'EmptyField' END, CASE WHEN t = s THEN 'SourceEqualsTarget' END, CASE WHEN len(regexp_extract_all(s, '{T.ARABIC}')) < 5 THEN 'LowArabicScriptCount' END, CASE WHEN len(regexp_extract_all(t, '[A-Za-z]')) < 100 THEN 'LowLatinScriptCount' END, CASE WHEN contains(t, chr(65533)) OR contains(s, chr(65533)) THEN 'EncodingErrorChar' END], lambda x: x IS NOT NULL) AS reasons FROM q),
d AS (SELECT *, row_number() OVER (PARTITION BY len(reasons) = 0, t, s ORDER BY conv_id, turn) AS k FROM r)
SELECT conv_id, turn, CASE WHEN len(reasons) = 0 AND k > 1 THEN 'Duplicate' ELSE array_to_string(reasons, ';') END AS reasons FROM d"""
)
def validated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, with letters of Arabic script put in, beside the whole answers, as pairs."""
    rows = pairs(spark, sf_dir).select("conv_id", "turn", F.struct("conv_id", "turn").alias("record"), F.translate("input", *LETTERS).alias("source_text"), F.col("output").alias("target_text"))
    return prepare.prepare(rows, min_arabic=5, min_latin=100).select("conv_id", "turn", F.array_join("reasons", ";").alias("reasons"))


@query(f"{PAIRS} SELECT conv_id, turn, 'Translate the following text into English:' || chr(10) || chr(10) || input AS prompt FROM p")
def zero_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", retrieve.zero_shot_prompt(F.col("input")).alias("prompt"))


@query(
    f"""{PAIRS}, q AS (SELECT conv_id, turn, 'Translate the following text into English:' || chr(10) || chr(10) || coalesce(input, '') AS prompt FROM p), a AS (SELECT *, string_split(prompt, chr(10))[-1] AS said FROM q)
SELECT conv_id, turn, prompt, trim(regexp_replace(said, '^{S}+|{S}+$', '', 'g')) AS prediction, len(regexp_extract_all(' ' || prompt, '[^{S[1:]}+'))::BIGINT AS prompt_tokens, len(regexp_extract_all(said, '[^{S[1:]}+'))::BIGINT AS completion_tokens FROM a"""
)
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = pairs(spark, sf_dir).select("conv_id", "turn", retrieve.zero_shot_prompt(F.coalesce("input", F.lit(""))).alias("prompt"))
    return generate.answered(prompts, "echo").drop("latency_s")


CHRF = f"""ch AS (SELECT condition, row_number() OVER () AS seg, regexp_replace(coalesce(input, ''), '{S}', '', 'g') AS h, regexp_replace(coalesce(output, ''), '{S}', '', 'g') AS r FROM p),
co AS (SELECT unnest(range(1, 7)) AS n),
cg AS (SELECT condition, seg, n, substr(h, i, n) AS g, 1 AS a, 0 AS b FROM (SELECT *, unnest(range(1, length(h) - n + 2)) AS i FROM ch, co WHERE length(h) >= n)
UNION ALL SELECT condition, seg, n, substr(r, i, n), 0, 1 FROM (SELECT *, unnest(range(1, length(r) - n + 2)) AS i FROM ch, co WHERE length(r) >= n)),
cm AS (SELECT condition, n, least(sum(a), sum(b)) AS m, sum(a) AS a, sum(b) AS b FROM cg GROUP BY condition, seg, n, g),
cs AS (SELECT condition, n, sum(m) / sum(a) AS p, sum(m) / sum(b) AS r FROM cm GROUP BY condition, n HAVING sum(a) > 0 AND sum(b) > 0),
cz AS (SELECT condition, avg(p) AS p, avg(r) AS r FROM cs GROUP BY condition),
chrfs AS (SELECT condition, CASE WHEN p + r > 0 THEN 500 * p * r / (4 * p + r) ELSE 0.0 END AS chrf FROM cz)"""


@query(f"{PAIRS}, {CHRF} SELECT condition, round(chrf, 4) AS chrf FROM chrfs")
def corpus_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.chrf(pairs(spark, sf_dir), "condition", "input", "output"))


def tokens_sql(c: str) -> str:
    """The 13a tokenizer."""
    c = f"replace(replace(replace(replace({c}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"')"
    c = f"' ' || replace(replace(replace({c}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
    for pattern, to in ((r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{20}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"list_filter(regexp_split_to_array({c}, '{S}+'), lambda x: x <> '')"


BLEU = f"""h AS (SELECT condition, row_number() OVER () AS seg, {tokens_sql("coalesce(input, '')")} AS h, {tokens_sql("coalesce(output, '')")} AS r FROM p),
o AS (SELECT unnest(range(1, 5)) AS n),
g AS (SELECT condition, seg, n, array_to_string(h[i:i + n - 1], ' ') AS g, 1 AS a, 0 AS b FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM h, o WHERE len(h) >= n)
UNION ALL SELECT condition, seg, n, array_to_string(r[i:i + n - 1], ' '), 0, 1 FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM h, o WHERE len(r) >= n)),
m AS (SELECT condition, n, least(sum(a), sum(b)) AS m, sum(a) AS a, sum(b) AS b FROM g GROUP BY condition, seg, n, g),
t AS (SELECT condition, n, sum(m)::DOUBLE AS m, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM m GROUP BY condition, n),
u AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY condition ORDER BY n) AS zeros FROM t WHERE a > 0),
bleus AS (SELECT condition, CASE WHEN count(*) = 4 AND max(m) > 0 THEN 100 * least(1.0, exp(1 - max(b) FILTER (n = 1) / max(a) FILTER (n = 1))) * exp(avg(ln(CASE WHEN m = 0 THEN 1 / (pow(2, zeros) * a) ELSE m / a END))) ELSE 0.0 END AS bleu FROM u GROUP BY condition)"""


@query(f"{PAIRS}, {BLEU} SELECT condition, round(bleu, 4) AS bleu FROM bleus")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.bleu(pairs(spark, sf_dir), "condition", "input", "output"))


def hits_sql(c: str) -> str:
    return HITS.replace("text", f"coalesce({c}, '')", 1)


@query(
    f"""{PAIRS}, {BLEU}, {CHRF}, rates AS (SELECT condition, count(*) AS n, avg({hits_sql("input")}) AS hyp_marker_rate, avg({hits_sql("output")}) AS ref_marker_rate FROM p GROUP BY condition)
SELECT condition, n, round(bleu, 4) AS bleu, round(chrf, 4) AS chrf, round(hyp_marker_rate, 4) AS hyp_marker_rate, round(ref_marker_rate, 4) AS ref_marker_rate FROM rates JOIN bleus USING (condition) JOIN chrfs USING (condition)"""
)
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.scores(pairs(spark, sf_dir), "condition", "input", "output"))


@query(
    f"""WITH r AS (SELECT lang, len(regexp_extract_all(text, '[^{S[1:]}+')) AS words, len(regexp_extract_all(text, '[A-Za-z0-9]{{1,4}}|[^A-Za-z0-9 \\t\\n\\r]')) AS tokens FROM documents WHERE text IS NOT NULL AND {NONBLANK}),
k AS (SELECT *, tokens / words AS ratio, row_number() OVER (PARTITION BY lang ORDER BY tokens / words) - 1 AS k, count(*) OVER (PARTITION BY lang) AS of FROM r)
SELECT lang, count(*) AS n, sum(words)::BIGINT AS words, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / sum(words), 6) AS fertility_corpus, round(avg(ratio), 6) AS fertility_mean, round(median(ratio), 6) AS fertility_median,
round(max(CASE WHEN k = floor(0.9::DOUBLE * (of - 1)) THEN ratio END), 6) AS fertility_p90, round(max(ratio), 6) AS fertility_max,
CASE WHEN sum(tokens) / sum(words) < 2.5 THEN 'LOCK IT' WHEN sum(tokens) / sum(words) < 4.0 THEN 'BORDERLINE' ELSE 'CATASTROPHIC' END AS verdict FROM k GROUP BY lang"""
)
def fertility_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.fertility(table(spark, sf_dir, "documents"), "lang")
    return rounded(out.withColumn("verdict", evaluate.fertility_verdict(F.col("fertility_corpus"))), 6)


@query(
    f"""{PAIRS}, u AS (SELECT condition, CASE conv_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-4.1' ELSE 'other' END AS model, length(coalesce(input, '')) AS i, length(coalesce(output, '')) AS o FROM p),
m(model, a, b) AS (VALUES ('gpt-4o-mini', 0.15, 0.6), ('gpt-4o', 2.5, 10.0), ('gpt-4.1', 2.0, 8.0))
SELECT condition, u.model, count(*) AS calls, sum(i)::BIGINT AS prompt_tokens, sum(o)::BIGINT AS completion_tokens, round((sum(i) * coalesce(max(a), 0)::DOUBLE + sum(o) * coalesce(max(b), 0)::DOUBLE) / 1e6, 4) AS cost_usd FROM u LEFT JOIN m ON m.model = u.model GROUP BY condition, u.model"""
)
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.expr("CASE conv_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-4.1' ELSE 'other' END")
    size = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long")
    return evaluate.usage(pairs(spark, sf_dir).select("condition", model.alias("model"), size("input").alias("prompt_tokens"), size("output").alias("completion_tokens")))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS paragraph_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(lang, '') AS target_text, coalesce(source, '') AS source_name, NULL::VARCHAR AS sentence_id FROM documents")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a table of pairs, written as TSV and read back."""
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "tsv")
    files.write_tsv(docs.select(F.col("text").alias("source_text"), F.col("lang").alias("target_text"), F.col("source").alias("source_name"), F.col("doc_id").alias("paragraph_id"), F.lit(None).cast("string").alias("sentence_id")), path)
    rows = files.read_tsv(spark, path, header=True)
    return rows.select("paragraph_id", F.sha2("source_text", 256).alias("text_sha256"), "target_text", "source_name", "sentence_id")


@query(f"{PAIRS} SELECT sha256(coalesce(input, '')) AS input_sha256, sha256(coalesce(output, '')) AS output_sha256, condition AS source, 'turn' AS type FROM p")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns as training records, written as JSON lines and read back."""
    path = scratch(spark, "jsonl")
    rows = pairs(spark, sf_dir).select(F.col("input").alias("source_text"), F.col("output").alias("target_text"), F.col("condition").alias("source_name"))
    files.write_jsonl(files.training_records(rows, "turn"), path)
    got = files.read_jsonl(spark, path)
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return got.select(digest("input").alias("input_sha256"), digest("output").alias("output_sha256"), "metadata.source", "metadata.type")


@query(f"{NEAR} SELECT query_id, row_id, rank, round(score, 4) AS score FROM t WHERE rank <= 5")
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an index that is written with its cells, read back and searched."""
    path = scratch(spark, "index")
    artifacts.write_index(table(spark, sf_dir, "embeddings").drop("label"), path, "given", sf_dir)
    passages, _ = artifacts.read_index(spark, path)
    cells.write(cells.indexed(passages, "vec_id"), f"{path}/cells")
    found, _ = cells.search(passages.where("vec_id % 20 = 0"), cells.read(spark, f"{path}/cells"), 5, "vec_id")
    return rounded(found)


LETTER = "abcdefghijklmnopqrstuvwxyz"
PROFILES = "[" + ", ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{x}'))::DOUBLE" for x in LETTER) + "]"


@query(
    f"""WITH e AS MATERIALIZED (SELECT doc_id, v FROM (SELECT doc_id, {PROFILES} AS v FROM documents) WHERE list_sum(v) > 0),
s AS (SELECT q.doc_id AS query_id, i.doc_id AS row_id, round(list_cosine_similarity(q.v, i.v), 9) AS score FROM e q, e i WHERE q.doc_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s)
SELECT query_id, row_id, rank, round(score, 6) AS score FROM t WHERE rank <= 5"""
)
def profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose letters are distributed most alike, exactly, by an index that leaves most of them out."""
    rows = checkpointed(table(spark, sf_dir, "documents").select("doc_id", T.letters(F.col("text")).alias("letters")))
    found, _ = cells.search(rows.where("doc_id % 20 = 0"), cells.indexed(rows, "doc_id", "letters"), 5, "doc_id", "letters")
    return rounded(found, 6)


@query(ORACLES["register_distance"])
def written_centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As register_distance, with a centroid that is written and read back."""
    rows, path = stored_features(spark, sf_dir), scratch(spark, "centroid")
    artifacts.write_centroid(evaluate.centroid(rows.where("lang = 'en'")), path)
    out = evaluate.with_distance(evaluate.report(rows, "source"), artifacts.read_centroid(spark, path))
    return rounded(out.select("source", "stylo_dist"))


@query(ORACLES["score_table"])
def written_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As score_table, over predictions that are written by condition and read back."""
    path = scratch(spark, "predictions")
    rows = pairs(spark, sf_dir).select("input", "output", F.col("input").alias("prediction"), "condition", F.lit("none").alias("model"), F.struct(F.lit("s").alias("source"), F.lit("turn").alias("type")).alias("metadata"))
    artifacts.write_predictions(rows, path, "val")
    return rounded(evaluate.scores(artifacts.read_predictions(spark, path), "condition", "prediction", "output"))


@query(
    f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{LETTERS[0]}', '{LETTERS[1]}') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '{T.ARABIC}'))::BIGINT AS arabic, len(regexp_extract_all(t, '[A-Za-z]'))::BIGINT AS latin, contains(t, chr(65533)) AS replaced FROM t"""
)
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each script, and whether a text has a replacement character."""
    text = F.translate(F.coalesce("text", F.lit("")), *LETTERS)
    return table(spark, sf_dir, "documents").select("doc_id", T.arabic_count(text).cast("long").alias("arabic"), T.latin_count(text).cast("long").alias("latin"), text.contains("\ufffd").alias("replaced"))


@query(f"{PAIRS} SELECT conv_id, turn, sha256(coalesce(input, '')) AS input_sha256 FROM p ORDER BY conv_id, turn LIMIT 25")
def first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by an order: here a limit is the operator."""
    rows = pairs(spark, sf_dir).withColumn("place", F.struct("conv_id", "turn"))
    return files.first(rows, "place", 25).select("conv_id", "turn", F.sha2(F.coalesce("input", F.lit("")), 256).alias("input_sha256"))


@query(
    f"""{PAIRS}, q AS (SELECT conv_id, turn, {source_sql(f"translate(coalesce(input, ''), '{LETTERS[0]}', '{LETTERS[1]}')")} AS s, {normal_sql("coalesce(output, '')")} AS t FROM (SELECT conv_id, turn, input, output FROM p UNION ALL SELECT conv_id + 1000000, turn, input, output FROM p WHERE conv_id % 4 = 0)),
r AS (SELECT *, list_filter([CASE WHEN t = '' OR s = '' THEN 'EmptyField' END, CASE WHEN t = s THEN 'SourceEqualsTarget' END, CASE WHEN len(regexp_extract_all(s, '{T.ARABIC}')) < 5 THEN 'LowArabicScriptCount' END, CASE WHEN len(regexp_extract_all(t, '[A-Za-z]')) < 100 THEN 'LowLatinScriptCount' END, CASE WHEN contains(t, chr(65533)) OR contains(s, chr(65533)) THEN 'EncodingErrorChar' END], lambda x: x IS NOT NULL) AS reasons FROM q)
SELECT CASE WHEN len(reasons) = 0 AND k = 1 THEN 'cleaned' ELSE 'dropped' END AS file, sha256(s) AS source_sha256, sha256(t) AS target_sha256, conv_id::VARCHAR AS paragraph_id, turn::VARCHAR AS sentence_id, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ';') WHEN k > 1 THEN 'Duplicate' END AS rejection_reasons
FROM (SELECT *, row_number() OVER (PARTITION BY s, t, len(reasons) = 0 ORDER BY conv_id, turn) AS k FROM r)"""
)
def prepared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns, and a fourth of them once more behind all others, as TSV files in order that are prepared; the rows of the cleaned and
    dropped files. A later copy of a pair is one by its record number."""
    folder = scratch(spark, "prepared")
    rows = pairs(spark, sf_dir)
    rows = rows.unionByName(rows.where("conv_id % 4 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000)).orderBy("conv_id", "turn").select(F.translate("input", *LETTERS).alias("source_text"), F.col("output").alias("target_text"), F.lit("turns").alias("source_name"), F.col("conv_id").alias("paragraph_id"), F.col("turn").alias("sentence_id"))
    files.write_tsv(rows, f"{folder}/in")
    workflows.prepared_files(spark, f"{folder}/in", folder, "turns", header=True, min_arabic=5, min_latin=100)
    good = files.read_tsv(spark, f"{folder}/turns_cleaned.tsv", header=True).select(F.lit("cleaned").alias("file"), *files.SENTENCES, F.lit(None).cast("string").alias("rejection_reasons"))
    bad = files.read_tsv(spark, f"{folder}/turns_dropped.tsv", ["unit_type", *files.SENTENCES, "rejection_reasons"], header=True)
    out = good.unionByName(bad.select(F.lit("dropped").alias("file"), *files.SENTENCES, "rejection_reasons"))
    return out.select("file", F.sha2("source_text", 256).alias("source_sha256"), F.sha2("target_text", 256).alias("target_sha256"), "paragraph_id", "sentence_id", "rejection_reasons")


# Extensions: analyses that go with the others.


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), r AS (SELECT label, arg_min(v, vec_id) AS ref FROM e GROUP BY label)
SELECT vec_id, round(1 - list_cosine_similarity(v, ref), 4) AS distance FROM e JOIN r USING (label)"""
)
def reference_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance of each vector to the first one of its label."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))  # a row a label
    return rounded(rows.join(first, "label").select("vec_id", retrieve.cosine_distance(F.col("embedding"), F.col("ref")).alias("distance")))


@query(
    f"""{FEATURED}, r AS (SELECT lang, {MEANS} FROM f GROUP BY lang)
{" UNION ALL ".join(f"SELECT '{f}' AS feature, round(a.{f}_mean, 4) AS en_mean, round(b.{f}_mean, 4) AS de_mean, round(b.{f}_mean - a.{f}_mean, 4) AS shift FROM r a, r b WHERE a.lang = 'en' AND b.lang = 'de'" for f in T.FEATURES)}"""
)
def feature_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.feature_shift(evaluate.featured(table(spark, sf_dir, "documents")), "lang", "en", "de"))


@query(
    """WITH r AS (SELECT lang, n_chars AS x, length(regexp_replace(text, '[^e]', '', 'g')) AS y FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS ry FROM r)
SELECT lang, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY lang"""
)
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a text's length and how often it has the letter e."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("e", F.length(F.regexp_replace("text", "[^e]", "")))
    return rounded(evaluate.spearman(docs, "lang", "n_chars", "e"), 6)


MIXED = "r AS (SELECT *, (h::UHUGEINT + k::UHUGEINT * " + f"{evaluate.STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x0 FROM s, (SELECT unnest(range(1, 201)) AS k))"
for place, m in enumerate(evaluate.MIX):
    MIXED += f", r{place} AS (SELECT *, (xor(x{place}, x{place} >> 33) * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x{place + 1} FROM r{place - 1 if place else ''})"


@query(
    f"""{PAIRS}, s AS (SELECT ('0x' || md5(conv_id || '/' || turn)[1:15])::BIGINT AS h, (length(output) - length(input))::DOUBLE AS d FROM p WHERE input IS NOT NULL AND output IS NOT NULL),
{MIXED}, u AS (SELECT k, d, (xor(x2, x2 >> 33) >> 11)::DOUBLE / 9007199254740992 AS u FROM r1),
m AS (SELECT k, sum(d * w) / sum(w) AS mean FROM (SELECT k, d, {" + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in evaluate.POISSON)} AS w FROM u) GROUP BY k)
SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(d) FROM s), 4) AS difference, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM m"""
)
def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference in length of answers and questions, with bounds by resampling."""
    rows = pairs(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("segment"), F.length("input").alias("one"), F.length("output").alias("other"))
    return rounded(evaluate.paired_bootstrap(rows, "segment", "one", "other", 200))


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '{S}+'), lambda x: x <> '')"


ROUNDS = 3
#: A round of expectation and maximisation after another, over the words that meet.
ASSOCIATED = f"""g AS (SELECT row_number() OVER () AS pair, {words_sql("input")} AS s, {words_sql("output")} AS t FROM p),
a AS (SELECT pair, s, count(*) AS n_s FROM (SELECT pair, unnest(s) AS s FROM g) GROUP BY ALL), b AS (SELECT pair, t, count(*) AS n_t FROM (SELECT pair, unnest(t) AS t FROM g) GROUP BY ALL),
m AS MATERIALIZED (SELECT pair, s, n_s, t, n_t FROM a JOIN b USING (pair)), q0 AS (SELECT DISTINCT s, t, 1.0::DOUBLE AS p FROM m)"""
for place in range(ROUNDS):
    ASSOCIATED += f""", e{place} AS (SELECT s, t, sum(c) AS c FROM (SELECT s, t, n_t * n_s * p / sum(n_s * p) OVER (PARTITION BY pair, t) AS c FROM m JOIN q{place} USING (s, t)) GROUP BY ALL),
q{place + 1} AS MATERIALIZED (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS p FROM e{place})"""
TRANSLATED = f"{ASSOCIATED}, best AS (SELECT s, t, round(p, 9) AS p, row_number() OVER (PARTITION BY s ORDER BY round(p, 9) DESC, t) AS rank FROM q{ROUNDS})"


@query(f"{PAIRS}, {TRANSLATED} SELECT s, t, p, rank FROM best WHERE rank <= 3")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest words of answers for each word of questions, as if these were translations."""
    return lexicon.likeliest(pairs(spark, sf_dir), "input", "output", ROUNDS, 3)


@query(
    f"""{PAIRS}, {TRANSLATED}, h AS (SELECT conv_id, turn, {words_sql("input")} AS s FROM p), w AS (SELECT conv_id, turn, unnest(list_distinct(s)) AS s, s AS own FROM h)
SELECT conv_id, turn, sha256(string_agg(s || ' → ' || t, ' | ' ORDER BY list_position(own, s))) AS word_pairs_sha256 FROM w JOIN best USING (s) WHERE rank = 1 GROUP BY conv_id, turn"""
)
def word_pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of word pairs that goes before a question in a prompt."""
    rows = pairs(spark, sf_dir).withColumn("row", F.struct("conv_id", "turn"))
    best = lexicon.likeliest(rows, "input", "output", ROUNDS, 1)
    return lexicon.pair_lines(rows, "row", "input", best).select("row.conv_id", "row.turn", F.sha2("word_pairs", 256).alias("word_pairs_sha256"))


@query(
    f"""{NEAR}, {TEXTS}, k AS (SELECT unnest([1, 2, 4]) AS shots)
SELECT query_id, shots, string_agg('Source: ' || x.input || chr(10) || 'English: ' || x.output || chr(10), chr(10) ORDER BY rank DESC) AS examples FROM t JOIN x ON x.vec_id = row_id JOIN k ON rank <= shots GROUP BY query_id, shots"""
)
def shot_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.concat(F.lit("row "), F.col("vec_id")).alias("input"), F.concat(F.lit("label "), F.col("label")).alias("output"))
    found = retrieve.shot_sweep(neighbours(spark, sf_dir, 4), [1, 2, 4]).join(texts, "row_id")
    block = F.concat(F.lit("Source: "), F.col("input"), F.lit("\nEnglish: "), F.col("output"), F.lit("\n")).alias("block")
    found = found.groupBy("query_id", "shots").agg(F.sort_array(F.collect_list(F.struct("rank", block)), asc=False).alias("b"))  # four at most
    return found.select("query_id", "shots", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("examples"))


@query(
    f"""{EACH_NEAR.replace("WITH ", FEATURED + ", ", 1)}, c AS (SELECT {CENTER} FROM f WHERE lang = 'en'),
z AS (SELECT f.doc_id AS row_id, sqrt({" + ".join(f"pow((f.{x} - c.{x}_mean) / c.{x}_std, 2)" for x in T.FEATURES)}) AS style FROM f, c),
v AS (SELECT query_id, row_id, score - 0.01::DOUBLE * style AS value FROM t JOIN z USING (row_id) WHERE rank <= 8)
SELECT query_id, row_id, round(value, 4) AS value, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, row_id) AS rank FROM v"""
)
def style_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's neighbours, those whose documents are nearer to the register of the English ones first."""
    rows = stored_features(spark, sf_dir)
    own = rows.select(F.col("doc_id").alias("row_id"), *(F.col(f).alias(f"{f}_mean") for f in T.FEATURES))
    style = evaluate.with_distance(own, evaluate.centroid(rows.where("lang = 'en'"))).select("row_id", F.col("stylo_dist").alias("style"))
    return rounded(retrieve.style_rerank(neighbours(spark, sf_dir, 8, "true"), style, 0.01).select("query_id", "row_id", "value", "rank"))
