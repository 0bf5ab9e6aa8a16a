import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import reassembly

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, n=10, idle=2):
    """The contract by loops over batches: what arrives, what is kept, released, closed and rejected."""
    batches = [{} for _ in range(n)]
    first = {}
    for conv, turn, role, text in rows:
        if turn is None:
            continue
        role, text = role or "", text or ""
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        first[conv] = min(turn, first.get(conv, turn))
        for b, r in [(h % n, role)] + ([((h + 5) % n, "user")] if h % 7 < 2 else []):
            here = batches[b].setdefault(conv, {})
            item = (f"{r}|{text}".encode(), r)
            here[turn] = min(item, here.get(turn, item))
    out, kept, released, last, closed = [], {}, {}, {}, set()

    def close(conv, b):
        closed.add(conv)
        own = kept[conv]
        waits = ",".join(str(t) for t in sorted(own) if t >= released[conv])
        missing = max(own) - first[conv] + 1 - len(own)
        breaks = sum(1 for t in own if t - 1 in own and own[t][1] == own[t - 1][1])
        out.append(("close", conv, -1, b, waits, missing, breaks))

    for b in range(n):
        for conv, turns in batches[b].items():
            if conv in closed:
                out.extend(("reject", conv, t, b, p.decode(), None, None) for t, (p, _) in turns.items())
                continue
            last[conv] = b
            own = kept.setdefault(conv, {})
            for t, item in turns.items():
                own.setdefault(t, item)
            released.setdefault(conv, first[conv])
            while released[conv] in own:
                out.append(("release", conv, released[conv], b, own[released[conv]][0].decode(), None, None))
                released[conv] += 1
        for conv in [c for c in kept if c not in closed and b - last[c] >= idle]:
            close(conv, b)
    for conv in [c for c in kept if c not in closed]:
        close(conv, n)
    return sorted(map(str, out))


def found(df, **options):
    return sorted(map(str, map(tuple, reassembly.reassembled(df, **options).collect())))


def conversations():
    r = random.Random(12)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), f"text {c} {t} é") for c in range(40) for t in range(r.randrange(1, 9)) if r.random() < 0.9]
    rows += [(100, t, ("user", "assistant")[t % 2], f"long conversation {t}") for t in range(75)]
    rows += [(101, t, ("user", "assistant")[t % 2], f"with a gap {t}") for t in range(60) if t != 23]
    rows += [(102, t, "user", f"far {t}") for t in (-3, -2, 5, 1000, 1001)]
    # repeated rows, one turn said in several ways, nulls
    rows += rows[:20] + [(3, 1, "zzz", "other"), (3, 1, "assistant", "a"), (3, 1, "assistant|a", "b"), (103, 0, None, None), (103, 1, "user", ""), (None, 4, "user", "no conversation"), (None, 5, "user", None), (7, None, "user", "no turn"), (None, None, None, None)]
    return rows


def test_events_are_those_of_loops_with_blocks_of_a_few_turns(spark, monkeypatch):
    monkeypatch.setattr(reassembly, "GROUP", 3)
    rows = conversations()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit(1), "payload": F.lit("x"), "batch": F.lit("y")})
    want = brute(rows)
    assert found(docs, span=4) == want
    events = [w.split("'")[1] for w in want]
    assert min(events.count(e) for e in ("release", "reject", "close")) > 5


def test_digests_of_one_block_and_an_empty_table(spark):
    rows = conversations()[:60]
    got = sorted(map(str, map(tuple, reassembly.digest(spark.createDataFrame(rows, SCHEMA)).collect())))
    want = sorted(str((*w[:4], hashlib.sha256(w[4].encode()).hexdigest(), *w[5:])) for w in map(eval, brute(rows)))
    assert got == want
    assert reassembly.digest(spark.createDataFrame([(1, None, "user", "x")], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [1, 7])
def test_gates_open_behind_runs_of_full_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(reassembly, "GROUP", size)
    full = [("a", k, (3 * k) % 5) for k in range(20)] + [("b", k, 1) for k in range(20) if k not in (0, 9)] + [("c", k, k) for k in range(9) if k != 8]
    got = {(r["conv"], r["block"]): r["gate"] for r in reassembly.gates(spark.createDataFrame(full, "conv string, block long, batch int")).collect()}
    want = {("a", k + 1): max((3 * j) % 5 for j in range(k + 1)) for k in range(20)} | {("c", k + 1): k for k in range(8)}
    assert got == want


def test_no_state_store_stays_open(spark):
    kind = spark._jvm.Thread.currentThread().getContextClassLoader().loadClass("org.apache.spark.sql.execution.streaming.state.StateStore$")
    held = kind.getDeclaredField("loadedProviders")
    held.setAccessible(True)
    still_open = lambda: held.get(kind.getField("MODULE$").get(None)).size()
    before = still_open()
    rows = [(c, t, "user", f"{c} {t}") for c in range(20) for t in range(5)]
    reassembly.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count()
    assert still_open() <= before
