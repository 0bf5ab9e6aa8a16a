from corpusloom.streaming import ingest


def test_files_are_taken_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    place = [str(tmp_path / x) for x in ("in", "out", "state")]

    def run():
        rows = ingest.accepted(ingest.validated(ingest.arriving(spark, place[0])))
        query = ingest.written(rows, *place[1:])
        query.awaitTermination()
        return sorted(r["target_text"] for r in spark.read.parquet(place[1]).collect())

    (tmp_path / "in/a.tsv").write_text('سلام\t"one\nline"\tn\t1\t1\nسلام\t\tn\t1\t2\nسلام\t"one  line"\tn\t1\t3\n', encoding="utf-8")
    assert run() == ["one line"]
    (tmp_path / "in/b.tsv").write_text("سلام\tone line\tn\t1\t1\nكتاب\ta book\tn\t1\t2\n", encoding="utf-8")
    assert run() == ["a book", "one line"] and run() == ["a book", "one line"]
