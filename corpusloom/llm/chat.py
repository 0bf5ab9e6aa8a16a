"""Chat formatting in Spark expressions only: sort the collected turns, merge neighbours of one role, concatenate.

Template, for each run of turns of one role: `<turn>` role, a line feed, the texts with `<next/>` between them, `</turn>`, a line
feed. Roles and texts never hold a `<` of their own: a backslash is written `\\b`, `<` is written `\\l`, and in roles a line feed
is written `\\n`, so that both can be read back exactly. The loss mask is a list of spans of the output (first code point, number of
them), in order: exactly the texts of assistant turns, cut from the output and unescaped, are trained on.

Defined cases: null roles and texts count as empty; rows without conv_id make one conversation; rows are ordered by turn (nulls
first), role, text, and repeated rows are turns of their own; a conversation is one string, so all its turns meet in one row, however
many and long they are; other columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, NEXT, END = "<turn>", "<next/>", "</turn>\n"
TRAINED = "assistant"
#: Turns whose lengths are added up at a time.
RUN = 128


def escaped(c: Column, line_feed: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if line_feed else c


def unescaped(c: Column) -> Column:
    """Each backslash of an escaped string has its letter behind it, so one kind after the other is undone."""
    return F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def running(lengths: Column, start: Column) -> Column:
    """What has been added up before each of the lengths; in one pass, but with a copy of the result for each, so for few of them."""
    zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted string, mask array<struct<start, length>> (bytes of formatted, from 0) of each conversation."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def part(t: Column, i: Column) -> Column:
        """What a turn adds: the bounds before it, and its text."""
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        head = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(BEGIN), escaped(t["role"], True), F.lit("\n"))
        return F.struct(F.when(first, head).otherwise(F.lit(NEXT)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == TRAINED).alias("loss"))

    rows = rows.select("conv_id", F.transform("turns", part).alias("parts"))
    sized = F.transform("parts", lambda p: F.struct(F.octet_length(p["head"]).alias("head"), F.octet_length(p["body"]).alias("body"), p["loss"].alias("loss")))
    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END))
    rows = rows.select("conv_id", text.alias("formatted"), sized.alias("sizes"))
    rows = rows.select("*", F.transform("sizes", lambda p: (p["head"] + p["body"]).cast("long")).alias("lengths"), F.sequence(F.lit(0), F.size("sizes") - 1, F.lit(RUN)).alias("runs"))
    own = lambda at: F.slice("lengths", at + 1, F.lit(RUN))
    sums = F.transform("runs", lambda at: F.aggregate(own(at), F.lit(0).cast("long"), lambda n, x: n + x))
    rows = rows.select("*", running(sums, F.lit(0).cast("long")).alias("begins"))
    starts = F.flatten(F.zip_with("runs", "begins", lambda at, begin: running(own(at), begin)))
    spans = F.zip_with("sizes", starts, lambda p, at: F.struct((at + p["head"]).alias("start"), p["body"].alias("length"), p["loss"].alias("loss")))
    mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))
    return rows.select("conv_id", "formatted", mask.alias("mask"))


def under_mask() -> Column:
    """The text of the spans of the mask, cut from the output and unescaped, nothing between."""
    held = F.array(F.struct(F.col("formatted").cast("binary").alias("bytes"), F.col("mask").alias("mask")))  # taken out of the row once
    cut = F.transform(held, lambda h: F.transform(h["mask"], lambda s: unescaped(F.substring(h["bytes"], (s["start"] + 1).cast("int"), s["length"]).cast("string"))))
    return F.array_join(F.get(cut, F.lit(0)), "")


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text>>, parsed from the formatted string alone."""

    def run(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescaped(F.substr(head, F.lit(len(BEGIN) + 1)))
        body = F.substr(block, F.length(head) + 2)
        return F.transform(F.split(body, NEXT, -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    blocks = F.split("formatted", END, -1)
    return formatted_rows.withColumn("turns", F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), run)))


def digest(conversations: DataFrame) -> DataFrame:
    rows = read_back(formatted(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), under_mask().alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: What op5 returns, in DuckDB SQL: the lengths of the template follow from its constants.
DIGEST_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) t(k)
), turns AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(replace(replace(text, '\\', '\\b'), '<', '\\l'))
    + CASE WHEN before = role THEN {len(NEXT)} ELSE {len(BEGIN) + 1} + length(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), chr(10), '\\n'))
      + CASE WHEN place > 1 THEN {len(END)} ELSE 0 END END AS written
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  (sum(written) + {len(END)})::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
