import math
import re
import statistics
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.words import FUNCTION_WORDS, STANDARD


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["v"] for r in rows.select("i", make(F.col("text")).alias("v")).orderBy("i").collect()]


def test_normal_form_of_sources_and_targets(spark):
    got = values(spark, ["كيـ", "a\r\nb\rc\nd", "﻿x​y", "a‌b", " ﬁ ", "مُؤ", None], T.normalize_text)
    assert got == ["کی", "a b c d", "xy", "a‌b", "fi", "مُؤ", ""]
    got = values(spark, ["“a” ‘b’", "word , x", "( x )", "a…"], lambda c: T.normalize_text(c, is_source=False))
    assert got == ["\"a\" 'b'", "word, x", "(x)", "a..."]


def test_match_keys(spark):
    assert values(spark, ["Straße, ΣΑΣ!", "?!", "a‌b", "٪", None], T.normalize_key) == ["strasse σασ", "", "a b", "٪", ""]


def test_counts(spark):
    assert values(spark, ["ab سلام"], T.arabic_count) == [4] and values(spark, ["ab سلام"], T.latin_count) == [2]
    assert values(spark, ["\n", " a\tb ", ""], T.word_count) == [0, 2, 0]
    assert values(spark, ["Thou thou O Oh cart art.", "éart arté art"], T.marker_hits) == [3, 1]


def test_features_of_hand_counted_texts(spark):
    text = "He came. Then the long and weary road led him unto thee! O day."
    words, content = 14, [w for w in "came long weary road led o day".split()]
    f, blank, half = values(spark, [text, "  ", "thou and thee speak"], T.features)
    assert f["lex_density"] == pytest.approx(len(content) / words)
    assert f["ttr"] == 1.0 and f["root_ttr"] == pytest.approx(words / math.sqrt(words))
    assert f["sent_len_mean"] == pytest.approx(words / 3) and f["sent_len_var"] == pytest.approx(statistics.pvariance([2, 10, 2]))
    assert f["marker_rate"] == pytest.approx(3 / words)
    assert list(blank) == [0.0] * 6 and half["marker_rate"] == 0.5
    assert len(STANDARD) == len(set(STANDARD)) == 167 and len(FUNCTION_WORDS) == 218


def test_feature_vector_has_the_features_in_order(spark):
    row = spark.createDataFrame([("Thou art here. He came, and he went away!",)], "t string").select(T.features(F.col("t")).alias("f"), T.feature_vector(F.col("t")).alias("v")).first()
    assert row["v"] == [row["f"][name] for name in T.FEATURES] and row["v"][2] > 0


def test_letters_are_counted_in_one_pass(spark):
    texts = ["Abc zZ éK", "", None, "日本 a" * 300] * 200
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = {r["id"]: r["x"] for r in rows.select("id", T.letters(F.col("t")).alias("x")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [float((t or "").lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]


def test_few_texts_of_a_batch_are_objects_at_once():
    seen = []

    class Watched:
        def __len__(self):
            return 1000

        def slice(self, k, n):
            seen.append(min(n, 1000 - k))
            return pa.array(["É"] * seen[-1])

    assert T.mapped(Watched(), str.lower).to_pylist() == ["é"] * 1000
    assert max(seen) <= T.SLICE < 1000
    assert T.mapped(pa.array(["A", None]), str.lower).to_pylist() == ["a", None] and len(T.mapped(pa.array([], pa.string()), str)) == 0


def test_tokens_are_those_of_the_regular_expression():
    texts = ["", None, "abcd12345 x", "é日本, a-b\t\r\nabcde\u3000\U0001f600!", "a" * 9, "\n", "Zz[`{@/:", " ab"] * 70
    want = [len(re.findall(r"[A-Za-z0-9]{1,4}|[^A-Za-z0-9 \t\n\r]", t or "")) for t in texts]
    assert T.pieces(pa.array(texts)).tolist() == want and T.pieces(pa.array([], pa.string())).tolist() == []


def test_python_normalizes_foreign_texts_only(spark, monkeypatch):
    """Texts of ASCII and Latin-1 letters never go to Python, and come out as if they did."""
    latin = [chr(k) for k in [*range(1, 128), *range(0xC0, 0x100)]]
    texts = [None, "", "".join(latin), "Straße ÉÀ İ", "ﬁ é µ ²", "كتاب ي", "Σίσυφος", *(f"a{chr(k)}b" for k in range(0x80, 0x250))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *latin])], "k long, t string")
    shown = lambda rows: [tuple(r) for r in rows.select("k", T.nfkc(F.coalesce("t", F.lit(""))), T.nfkc_casefold(F.coalesce("t", F.lit("")))).orderBy("k").collect()]
    normal = lambda t: unicodedata.normalize("NFKC", t or "")
    assert shown(rows) == [(k, normal(t), normal(t).casefold()) for k, t in enumerate([*texts, *latin])]

    @F.arrow_udf("string")
    def nothing(texts: pa.Array) -> pa.Array:
        assert texts.null_count == len(texts)
        return texts

    monkeypatch.setattr(T, "_nfkc", nothing)
    monkeypatch.setattr(T, "_nfkc_casefold", nothing)
    plain = rows.where(F.col("t").isin(latin) | F.col("t").isNull() | (F.col("k") == 2))
    assert len(plain.select(T.normalize_text(F.col("t")), T.normalize_key(F.col("t"))).collect()) == len(latin) + 2
