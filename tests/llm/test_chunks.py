import hashlib
import random

import numpy as np
import xxhash

from corpusloom.llm import chunks


def ends_by_byte(data):
    """Chunk ends by a rolling hash, one byte after the other."""
    out, begin = [], 0
    while begin < len(data):
        h, end = 0, min(begin + chunks.MAX, len(data))
        for at in range(begin, end):
            h = ((h << 1) + int(chunks.GEAR[data[at]])) & 0xFFFFFFFF
            size = at + 1 - begin
            if size >= chunks.MIN and size < chunks.MAX and not h & int(chunks.HARD if size < chunks.NORMAL else chunks.EASY):
                end = at + 1
                break
        out.append(end)
        begin = end
    return out


def by_byte(data):
    """Digest to length of the chunks, one byte after the other."""
    out, begin = {}, 0
    for end in ends_by_byte(data):
        out[xxhash.xxh64(data[begin:end]).intdigest()] = end - begin
        begin = end
    return out


def written(chunks_of):
    return "".join(format(d, "016x") + format(n, "02x") for d, n in sorted(chunks_of.items()))


def contained(a, b):
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def test_chunk_ends_are_those_of_a_rolling_hash():
    r = random.Random(6)
    texts = [b"", b"a", b"ab" * 600, *(r.randbytes(n) for n in (31, 32, 33, 255, 256, 4000))]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = chunks.chunk_ends(np.frombuffer(b"".join(texts), np.uint8), bounds)
    assert [[e - int(b) for e in own] for own, b in zip(got, bounds)] == [ends_by_byte(t) for t in texts]


def test_an_insertion_leaves_most_chunks():
    r = random.Random(7)
    text = " ".join(f"w{r.randrange(5000)}" for _ in range(2000)).encode()
    whole, moved, other = chunks.fingerprints([text, b"some words in front " + text, r.randbytes(len(text))])
    assert chunks.likeness(whole, moved) > 0.95 and chunks.likeness(whole, other) < 0.01
    assert chunks.decoded(chunks.coded(whole)) == whole


def test_odd_rows_and_their_edits(odd_docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = (by_byte(x.encode()) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), contained(a, b), contained(a, c)))
    assert sorted(map(str, map(tuple, chunks.fingerprint_pairs(odd_docs).collect()))) == sorted(map(str, want))
    assert chunks.fingerprint_pairs(odd_docs.limit(0)).count() == 0
    alone = chunks.fingerprint_pairs(odd_docs.where("doc_id = 8")).first()
    assert alone["near_next"] == 1.0
