"""Column expressions over texts: normalization, match keys, script counts, tokenizers and register features."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from .words import FUNCTION_WORDS, MARKERS

#: The white space of Unicode, as Java's default class has six characters only.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NONWS = WS.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"
MARKER = rf"(?<!{WORD})(?:{'|'.join(MARKERS)})(?!{WORD})"
DIACRITICS = r"\x{64b}-\x{670}\x{65f}\x{6d6}-\x{6ed}"
ARABIC = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
FEATURES = ["lex_density", "ttr", "root_ttr", "sent_len_mean", "sent_len_var", "marker_rate"]


#: Texts of a batch that are Python's at once; a batch has 10,000 rows whatever their lengths.
SLICE = 256


def mapped(texts: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """one(text) of each text that is not null."""
    parts = [pa.array([x if x is None else one(x) for x in texts.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return mapped(texts, lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x))


@F.arrow_udf(StringType())
def _nfkc_casefold(texts: pa.Array) -> pa.Array:
    return mapped(texts, lambda x: unicodedata.normalize("NFKC", x).casefold())


#: All but ASCII and the letters of Latin-1, which NFKC leaves as they are; no text without these needs Python.
FOREIGN = r"[^\x{0}-\x{7f}\x{c0}-\x{ff}]"


def nfkc(c: Column) -> Column:
    """NFKC of a text that is not null."""
    return F.coalesce(_nfkc(F.when(c.rlike(FOREIGN), c)), c)


def nfkc_casefold(c: Column) -> Column:
    """NFKC of a text that is not null, case-folded."""
    return F.coalesce(_nfkc_casefold(F.when(c.rlike(FOREIGN), c)), F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def counted(texts: pa.Array) -> np.ndarray:
    """How often each of a to z is in each text; a null text has none."""
    out = np.zeros((len(texts), 26))
    for k in range(0, len(texts), SLICE):
        part = texts.slice(k, SLICE).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(part).to_numpy())
        letter = np.frombuffer("".join(part.to_pylist()).encode(), np.uint8).astype(np.int64) - ord("a")  # bytes of others are none of ASCII
        row = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
        good = (letter >= 0) & (letter < 26)
        out[k : k + len(part)] = np.bincount(row[good] * 26 + letter[good], minlength=26 * len(part)).reshape(-1, 26)
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def _letters(texts: pa.Array) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(counted(texts).ravel()), 26).cast(pa.list_(pa.float64()))


def letters(c: Column) -> Column:
    """array<double>: how often each letter of a to z is in a text, in one pass; null counts as empty."""
    return _letters(F.lower(F.coalesce(c, F.lit(""))))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize_text(c: Column, is_source: bool = True) -> Column:
    """Normal form of a text; null counts as empty."""
    c = F.translate(nfkc(F.coalesce(c, F.lit(""))), "﻿​", "")
    c = F.regexp_replace(c, "\r\n?|\n", " ")
    if is_source:
        c = F.translate(c, "يكـ", "یک")
    else:
        c = F.translate(c, "“”‘’", "\"\"''")
        for pattern, to in ((f"{WS}+([,.;:!?])", "$1"), (rf"\({WS}+", "("), (rf"{WS}+\)", ")")):
            c = F.regexp_replace(c, pattern, to)
    return collapse(c)


def normalize_key(c: Column) -> Column:
    """Match key: case and punctuation do not count; a text of punctuation only has the empty key."""
    c = nfkc_casefold(F.coalesce(c, F.lit("")))
    return collapse(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{WS[1:-1]}{DIACRITICS}]", " "))


def arabic_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ARABIC))


def latin_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, f"[.!?]+{WS}+", -1), lambda s: s.rlike(NONWS))


def marker_hits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MARKER))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(c, F.lit(f"{NONWS}+"))


def pieces(texts: pa.Array) -> np.ndarray:
    """Runs of letters and digits of ASCII in pieces of at most four, and single symbols, of each text; a null text has none."""
    out = np.zeros(len(texts), np.int64)
    for k in range(0, len(texts), SLICE):
        part = [(x or "").encode() for x in texts.slice(k, SLICE).to_pylist()]
        ends = np.cumsum([len(x) + 1 for x in part])
        data = np.frombuffer(b"\n".join([*part, b""]), np.uint8)
        low = data | 32
        run = ((data >= 48) & (data <= 57)) | ((low >= 97) & (low <= 122))
        single = ~run & ((data & 0xC0) != 0x80) & ~np.isin(data, (32, 9, 10, 13))  # a symbol by its first byte
        edges = np.flatnonzero(np.diff(np.concatenate([[False], run]).astype(np.int8)))  # each text ends behind its last run
        starts, upto = edges[::2], edges[1::2]
        row = lambda at: np.searchsorted(ends, at, side="right")
        n = np.bincount(row(starts), (upto - starts + 3) // 4, len(part)) + np.bincount(row(np.flatnonzero(single)), minlength=len(part))
        out[k : k + len(part)] = n
    return out


@F.arrow_udf(LongType())
def _pieces(texts: pa.Array) -> pa.Array:
    return pa.array(pieces(texts))


def token_count(c: Column) -> Column:
    """The stand-in tokenizer: runs of letters and digits in pieces of at most four, and single symbols. A regular expression would make a
    string of each."""
    return F.when(c.isNotNull(), _pieces(c)).cast("int")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(NONWS), F.lit(False))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def features(c: Column) -> Column:
    """struct of the register features in their fixed order; zeros for a text without words."""
    c = F.coalesce(c, F.lit(""))
    counts = F.filter(F.transform(sentences(c), lambda s: F.size(words(s)).cast("double")), lambda x: x > 0)

    def of_words(v: Column) -> Column:
        n = F.size(v["w"]).cast("double")
        return F.struct(
            n.alias("n"),
            F.size(F.array_distinct(v["w"])).alias("types"),
            F.size(F.filter(v["w"], lambda x: ~x.isin(FUNCTION_WORDS))).alias("content"),
            F.when(F.size(v["l"]) > 0, v["l"]).otherwise(F.array(n)).alias("l"),
            v["hits"].alias("hits"),
        )

    def with_mean(v: Column) -> Column:
        return F.struct(v.alias("v"), (F.aggregate(v["l"], F.lit(0.0), lambda a, x: a + x) / F.size(v["l"])).alias("mean"))

    def measures(m: Column) -> Column:
        v, mean = m["v"], m["mean"]
        n = v["n"]
        variance = F.aggregate(v["l"], F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v["l"])
        values = [v["content"] / n, v["types"] / n, v["types"] / F.sqrt(n), mean, variance, v["hits"] / n]
        return F.struct(*(F.when(n > 0, x).otherwise(0.0).alias(name) for x, name in zip(values, FEATURES, strict=True)))

    found = F.struct(words(c).alias("w"), counts.alias("l"), marker_hits(c).alias("hits"))
    return let(let(let(found, of_words), with_mean), measures)


def feature_vector(c: Column) -> Column:
    """array<double> of the register features in their fixed order."""
    return let(features(c), lambda f: F.array(*(f[name] for name in FEATURES)))
