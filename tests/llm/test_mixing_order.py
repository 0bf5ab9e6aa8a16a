from collections import defaultdict

from corpusloom.llm import mixing


def test_every_epoch_is_a_permutation_of_the_blocks_and_the_last_one_a_part(spark):
    rows = [(1000 * k + i, " ".join(f"w{i}" for _ in range(20)), f"s{k}") for k, n in enumerate([400, 100, 60]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.schedule(docs, mixing.Target(3.5, 1.09), block_tokens=200).collect()
    blocks, runs, taken = defaultdict(set), defaultdict(dict), defaultdict(set)
    for r in got:
        assert [p["epoch"] for p in r["places"]] == list(range(r["copies"]))
        blocks[r["source"]].add(r["block"])
        for p in r["places"]:
            assert runs[r["source"], p["epoch"]].setdefault(r["block"], p["position"]) == p["position"]
            taken[r["source"], p["epoch"]].add((p["position"], r["draw"]))
    for source, own in blocks.items():
        copies = [r["copies"] for r in got if r["source"] == source]
        orders = [runs[source, e] for e in range(max(copies))]
        for order in orders[: min(copies)]:
            assert order.keys() == own and sorted(order.values()) == list(range(len(own)))
        if min(copies) > 1:
            assert len({tuple(sorted(o, key=o.get)) for o in orders[: min(copies)]}) == min(copies)
        if max(copies) > min(copies):  # a prefix of the last epoch's order
            last = taken[source, min(copies)]
            everything = sorted({(p, r["draw"]) for r in got if r["source"] == source and r["block"] in orders[-1] for p in [orders[-1][r["block"]]]})
            assert sorted(last) == everything[: len(last)]
    assert max(len(r["places"]) for r in got) > 2
