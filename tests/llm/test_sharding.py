import zlib
from collections import defaultdict

import numpy as np

from corpusloom.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one_and_moves_only_to_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    before = np.zeros(len(keys), np.int64)
    for n in range(1, 30):
        got = sharding.jump_hash(keys, n)
        assert got.tolist() == [jump(int(k), n) for k in keys] if n in (1, 2, 24, 25) else True
        moved = got != before
        assert (got[moved] == n - 1).all() and (n == 1 or abs(moved.mean() - 1 / n) < 0.05)
        before = got


def test_odd_rows_get_gapless_slots(odd_docs):
    rows = sharding.assign(odd_docs).collect()
    texts = sorted((len(t.encode()) + 8, zlib.crc32(t.encode())) for t in ((r["text"] or "") for r in odd_docs.collect()))
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(odd_docs.limit(0)).count() == 0


def test_shards_depend_on_the_id_alone(odd_docs):
    one = {r["doc_id"]: r["shard"] for r in sharding.assign(odd_docs.where("doc_id is not null")).collect()}
    two = {r["doc_id"]: r["shard"] for r in sharding.assign(odd_docs.where("doc_id is not null").selectExpr("doc_id", "'other' AS text").repartition(3)).collect()}
    assert one == two


def test_written_rows_are_whole(spark, odd_docs, tmp_path):
    sharding.write(odd_docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd_docs.count() and set(back.columns) == {*odd_docs.columns, "shard"}
