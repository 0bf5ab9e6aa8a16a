from pyspark.sql import functions as F

from corpusloom.llm import quality


def prose(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_sketches_merge_by_adding(spark):
    docs = spark.createDataFrame([(i, prose(i, 10 + i % 37), ("en", "fr")[i % 2], "s") for i in range(120)], "doc_id long, text string, lang string, source string")
    rows = quality.measured(docs, [F.col("doc_id")])
    key = ["_lang", "_source", "metric", "bucket"]
    parts = quality.sketches(rows.where("doc_id < 50")).unionByName(quality.sketches(rows.where("doc_id >= 50"))).groupBy(*key).agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, quality.sketches(rows).collect()))


def test_outliers_of_their_own_source_go_and_clean_rows_stay(spark):
    symbols = " ".join("### $$$" for _ in range(3)) + " " + prose(1000, 12)
    rows = [(i, prose(i), "en", "web") for i in range(300)] + [(300, symbols, "en", "web"), (301, "too short", "en", "web"), (302, "again and " * 40, "en", "web")]
    rows += [(400 + i, symbols + f" {i} {prose(i, 9)}", "en", "code") for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"] for r in quality.verdicts(docs).where("not kept").collect()}
    assert gone == {300, 301, 302}
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_odd_rows(odd_docs):
    got = quality.verdicts(odd_docs)
    assert got.count() == odd_docs.count() and got.where("kept is null").count() == 0
    assert quality.kept_documents(odd_docs).schema.names == odd_docs.columns
    assert quality.verdicts(odd_docs.limit(0)).count() == 0 and quality.kept_documents(odd_docs.limit(0)).count() == 0


def test_thresholds_of_a_source_are_drawn_to_those_of_its_language(spark):
    rows = [("en", "large", 400, 10_000), ("en", "large", 500, 10_000), ("en", "small", 900, 5), ("fr", "other", 700, 20_000)]
    sketch = spark.createDataFrame([(lang, source, "word_length", b, n) for lang, source, b, n in rows], "_lang string, _source string, metric string, bucket long, n long")
    got = {r["_source"]: (r["word_length_low"], r["word_length_high"]) for r in quality.thresholds(sketch).collect()}

    def quantiles(own):
        values = sorted((b, n) for _, _, b, n in own)
        total, out = sum(n for _, n in values), []
        for k in (5, 50, 95):
            upto = 0
            for b, n in values:
                upto += n
                if 100 * upto >= k * total:
                    out.append(b)
                    break
        return total, out

    drawn = lambda n, q, to: [(n * x + quality.PRIOR * y) // (n + quality.PRIOR) for x, y in zip(q, to)]
    for lang, source in {r[:2] for r in rows}:
        low, mid, high = drawn(*quantiles([r for r in rows if r[:2] == (lang, source)]), drawn(*quantiles([r for r in rows if r[0] == lang]), quantiles(rows)[1]))
        assert got[source] == (low - quality.FENCE * (mid - low), high + quality.FENCE * (high - mid))


def test_sources_with_unlike_tails_get_unlike_fences(spark):
    noisy = lambda i: prose(i, 60) + " #" * (i % 10)
    rows = [(i, prose(i, 60), "en", "plain") for i in range(1000)] + [(1000 + i, noisy(i), "en", "noisy") for i in range(1000)]
    rows += [(5000, prose(1, 60) + " #" * 9, "en", "plain"), (5001, prose(2, 60) + " #" * 9, "en", "noisy"), (5002, prose(3, 60) + " # " * 60, "en", "noisy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {r["_source"]: r["symbol_share_high"] for r in quality.fences(quality.measured(docs, [])).collect()}
    assert limits["plain"] < 60 < 150 < limits["noisy"]
    assert {r["doc_id"] for r in quality.verdicts(docs).where("not kept").collect()} == {5000, 5002}


def test_thresholds_of_many_groups_are_dealt_out(spark, odd_docs, monkeypatch):
    from corpusloom.llm import base

    want = sorted(map(str, quality.verdicts(odd_docs).collect()))
    monkeypatch.setattr(base, "BROADCAST_ROWS", 0)
    assert sorted(map(str, quality.verdicts(odd_docs).collect())) == want and quality.kept_documents(odd_docs).columns == odd_docs.columns
