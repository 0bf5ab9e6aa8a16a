import random
import struct
from collections import defaultdict

import xxhash

from corpusloom.llm import mixing


def spark_hash(*values):
    """XXH64 of values in a row: strings, 64-bit numbers, and (n,) for 32-bit ones."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def copies_by_loops(rows, max_epochs, block_tokens):
    sources = defaultdict(list)
    for doc_id, text, source in rows:
        sources[source].append((doc_id, text, len(text.split())))
    total = {s: sum(n for _, _, n in own) for s, own in sources.items()}
    tokens = sum(total.values())

    def weights(a):
        p = {s: (t / tokens) ** a for s, t in total.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    def fits(a):
        return all(w * tokens <= max_epochs * total[s] * (1 + 1e-9) for s, w in weights(a).items())

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    else:
        for _ in range(20):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
    out = {}
    for s, own in sources.items():
        quota = round(weights(high)[s] * tokens)
        whole, rest = divmod(quota, total[s])
        n_blocks = max(-(-total[s] // block_tokens), mixing.LEAST_BLOCKS)
        blocks = defaultdict(list)
        for doc_id, text, n in own:
            h = spark_hash(doc_id, text, (mixing.SEED,))
            blocks[h % n_blocks].append((spark_hash(h, (mixing.SEED + 1,)), doc_id, n))
            out[doc_id] = whole
        for block in sorted(blocks, key=lambda b: (spark_hash(s, b, whole, (mixing.SEED,)), b)):
            size = sum(n for _, _, n in blocks[block])
            for _, doc_id, n in sorted(blocks[block]):
                if n > rest:
                    break
                rest -= n
                out[doc_id] += 1
            else:
                continue
            break
        assert size
    return out


def test_copies_are_those_of_loops(spark):
    r = random.Random(4)
    rows = [(1000 * k + i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(1, 40))), f"s{k}") for k, n in enumerate([500, 120, 30, 9]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for max_epochs, block_tokens in ((2.0, 100), (3.3, 1 << 20), (1.2, 50)):
        got = {x["doc_id"]: x["copies"] for x in mixing.schedule(docs, mixing.Target(max_epochs), block_tokens=block_tokens).collect()}
        assert got == copies_by_loops(rows, max_epochs, block_tokens) and len(set(got.values())) > 2
