import struct

import xxhash

from corpusloom.llm import sharding


def jump(key, shards):
    """Lamping and Veach's loop."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_those_of_the_loop(spark):
    rows = [(i * 7919 - 500, "x" * (i % 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in sharding.assign(docs, 24).collect()}
    for i, text in rows:
        key = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        assert (got[i]["shard"], got[i]["grown_shard"], got[i]["size"]) == (jump(key, 24), jump(key, 25), len(text) + 8)
    for shard in range(24):
        own = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got.values())
