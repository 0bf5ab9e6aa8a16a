from corpusloom.llm import language


def test_held_out_rows_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert sum(r["accepted"] for r in got) >= 0.9 * len(got)


def test_odd_rows(odd_docs):
    got = language.identify(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by_id[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and by_id[0]["score"] == 0 and not by_id[0]["accepted"]
    none = language.identify(odd_docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.identify(odd_docs.limit(0)).count() == 0


def test_language_and_source_are_no_input_of_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 3 = 1 THEN 'xx' ELSE lang END AS lang", "'other' AS source")
    one, two = ({tuple(r) for r in language.identify(d).collect()} for d in (docs, changed))
    assert one == two
