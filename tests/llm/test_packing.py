import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusloom.llm import packing


def scanned(lengths, capacity):
    """Best-fit decreasing by a look at every open bin: the rooms left."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_packs_as_a_scan_does():
    r = random.Random(3)
    for capacity in (1, 7, 64, 100):
        for n in (0, 1, 50, 300):
            lengths = np.array([r.randint(1, r.choice((3, capacity))) if capacity > 3 else r.randint(1, capacity) for _ in range(n)], np.int64)
            plan, count = packing.best_fit_plan(np.bincount(lengths, minlength=capacity + 1), capacity)
            number = np.array([(lengths[:i] == x).sum() for i, x in enumerate(lengths.tolist())], np.int64)
            bins, offsets = packing.placed(plan, lengths, number)
            used = np.bincount(bins, lengths, minlength=count) if n else np.zeros(0)
            assert sorted((capacity - used).astype(int).tolist()) == scanned(lengths.tolist(), capacity)
            for k in range(count):
                at = np.flatnonzero(bins == k)
                at = at[np.argsort(offsets[at])]
                assert (offsets[at] == np.cumsum(lengths[at]) - lengths[at]).all()


def test_plan_does_not_grow_with_the_table():
    r = np.random.default_rng(4)
    counts = r.integers(0, 50, 257)
    small, large = (packing.best_fit_plan(counts * k, 256)[0] for k in (1, 10**9))
    assert len(large) <= 2 * len(small) + 256


def check(docs, rows, capacity):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d in docs.collect():
        ids = coder.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want.append((str(d["doc_id"]), k, a, len(part), zlib.crc32(part)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_odd_documents_are_packed_whole(odd_docs):
    check(odd_docs, packing.pack(odd_docs).collect(), 2048)
    check(odd_docs, packing.pack(odd_docs, 64).collect(), 64)
    assert packing.pack(odd_docs.limit(0)).count() == 0


def test_table_is_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs.repartition(7)).collect()
    assert check(docs, rows, 2048) == len(scanned([r["length"] for r in rows], 2048))
