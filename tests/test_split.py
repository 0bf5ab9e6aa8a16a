import random
from fractions import Fraction

from corpusloom.operators import split

SCHEMA = "id int, split string, input_key string, output_key string"


def scan(rows):
    kept = {x[0] for x in rows if x[1] == "train"}
    ins, outs = ({x[k] for x in rows if x[1] == "train"} for k in (2, 3))
    for name in ("val", "test"):
        for i, s, a, b in sorted(rows):
            if s == name and a not in ins and b not in outs:
                kept.add(i)
                ins.add(a)
                outs.add(b)
    return kept


def kept(spark, rows):
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    got = [r["id"] for r in split.drop_seen(spark.createDataFrame(shuffled, SCHEMA), ["id"]).select("id").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_long_chains_take_few_steps(spark, monkeypatch):
    rows = [(k, "test", f"x{k // 2}", f"y{(k + 1) // 2}") for k in range(2000)]
    rows += [(9000 - k, "val", f"u{k // 2}", f"v{(k + 1) // 2}") for k in range(301)]  # backwards
    rows += [(20_000 + k, "val", f"p{k // 2}", f"q{(k + 1) // 2}") for k in range(50)] + [(20_100, "val", "p7", "new"), (20_101, "test", "other", "q9"), (20_102, "val", "p7", "q8")]
    made = []
    monkeypatch.setattr(split, "checkpointed", lambda df, own=split.checkpointed: made.append(1) or own(df))
    assert kept(spark, rows) == scan(rows) and len(made) < 60


def test_many_random_edges_and_a_key_with_a_third_of_the_rows(spark):
    r = random.Random(8)
    rows = [(k, r.choice(["val", "test"]), f"i{r.randrange(12_000)}", f"o{r.randrange(12_000)}") for k in range(40_000)]
    rows += [(50_000 + k, "test", "hot", f"o{r.randrange(15_000)}") for k in range(20_000)] + [(80_000, "train", "i5", "o6")]
    assert kept(spark, rows) == scan(rows)


def test_ladders_and_repeated_pairs(spark):
    r = random.Random(9)
    rows = [(k, "val", f"a{k // 3}", f"b{(k + k // 3) % 17}") for k in range(60)] + [(100 + k, "test", f"c{k % 5}", f"d{k % 3}") for k in range(40)]
    rows += [(200 + k, "val", "same", "pair") for k in range(9)] + [(300 + k, "val", f"e{r.randrange(6)}", f"f{k // 4}") for k in range(40)]
    assert kept(spark, rows) == scan(rows)


def test_the_plan_by_sizes_is_the_fold_over_groups():
    r = random.Random(3)
    for trial in range(1500):
        names = r.sample(["train", "val", "test", "a"], r.randrange(1, 5))
        parts = [r.randrange(1, 10) for _ in names]
        sizes = [(s, r.randrange(1, 40)) for s in sorted({r.randrange(1, 12 if trial % 5 else 200) for _ in range(r.randrange(1, 6))}, reverse=True)]
        total = sum(s * m for s, m in sizes)
        goal = {name: Fraction(total * (p / sum(parts) if trial % 3 else 0.25)) for name, p in zip(names, parts)}
        got, want = dict.fromkeys(names, 0), []
        for s, m in sizes:
            for _ in range(m):
                want.append(min(sorted(got), key=lambda name: got[name] - goal[name]))
                got[want[-1]] += s
        plan = split.assignment_plan(sizes, goal)
        assert [order[(k - a) % len(order)] for _, a, b, order in plan for k in range(a, b + 1)] == want and len(plan) <= 8 * len(sizes)


def test_groups_of_many_equal_sizes_go_where_the_fold_puts_them(spark):
    r = random.Random(5)
    rows = [(f"w{g}",) for g in range(700) for _ in range(r.choice([1, 1, 1, 2, 3, 40]))] + [(None,), ("",), ("<unknown>",)] + [("hot",)] * 900
    counts = {}
    for (g,) in rows:
        counts[g or "<unknown>"] = counts.get(g or "<unknown>", 0) + 1
    goal = {"test": len(rows) * 0.1, "train": len(rows) * 0.8, "val": len(rows) * 0.1}
    got, want = dict.fromkeys(goal, 0), []
    for k, (work, n) in enumerate(sorted(counts.items(), key=lambda x: (x[0] != "<unknown>", -x[1], x[0]))):
        name = "train" if work == "<unknown>" else min(got, key=lambda s: got[s] - goal[s])
        got[name] += n
        want.append((work, n, name, k))
    assert sorted(map(tuple, split.assign_groups(spark.createDataFrame(rows, "g string"), "g").collect())) == sorted(want)
    assert split.assign_groups(spark.createDataFrame([], "g string"), "g").count() == 0
