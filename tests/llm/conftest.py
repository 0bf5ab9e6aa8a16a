import os

import pytest

ODD_TEXTS = [None, "", " \n\t", "one", "word " * 30 + "\n", "é ü ß 日本 語 <b> | # $ %", "same line\nsame line\nother line of some words here\n", "<turn>\\n</turn>", "a" * 5000, "long text with words " * 20_000]


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with names that operators use inside."""
    rows = [(i, t, ("en", "fr", None)[i % 3], ("web", None)[i % 2], len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], rows[6], (None, "without an id but with some words", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "'x' AS _doc", "1 AS _row", "'y' AS row", "2.5D AS copies", "'z' AS `kept.h`")


@pytest.fixture
def table_dir(tmp_path):
    """Writes tables as Parquet and gives their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return write
