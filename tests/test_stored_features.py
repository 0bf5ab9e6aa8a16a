from corpusloom.plans import catalog


def test_distances_read_the_texts_once_and_then_their_features(spark):
    for query in (catalog.register_distance, catalog.written_centroid_distance):
        files = query(spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("documents.parquet" in f for f in files)
