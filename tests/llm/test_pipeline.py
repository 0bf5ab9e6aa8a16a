import random
from collections import Counter, defaultdict

import corpus_pipeline
from corpusloom.llm import mixing, quality, simhash


def planted():
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(n))
    rows = [(i, prose(r.randrange(120, 300)), "en", f"s{i % 3}") for i in range(240)]
    rows += [(300, rows[5][1], "en", "s1"), (301, rows[6][1].upper(), "en", "s2")]
    words = rows[7][1].split()
    rows.append((302, " ".join([*words[:60], "changed", *words[61:]]), "en", "s0"))
    passage = prose(70)
    rows += [(310 + k, f"{prose(150)}\n{passage}\n{prose(150)}", "en", "s1") for k in range(4)]
    rows += [(320, "short text", "en", "s0"), (321, None, None, None), (322, "again and again " * 60, "en", "s0")]
    return [(*x, len(x[1]) if x[1] else None) for x in rows], passage


def test_stages_do_their_work_on_what_the_one_before_kept(spark, table_dir):
    rows, passage = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder, seen = table_dir(documents=docs), []
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        seen.append((docs, got))
        docs = got
    ids = [{r["doc_id"] for r in got.select("doc_id").collect()} for _, got in seen]
    assert all(got.columns == seen[0][0].columns for _, got in seen[:-1])
    everything = {r[0] for r in rows}
    assert ids[0] == everything - {320, 321, 322} == {r["doc_id"] for r in quality.verdicts(seen[0][0]).where("kept").collect()}
    fps = {r["doc_id"]: simhash.fingerprint(r["text"], 5) for r in seen[0][1].collect()}
    first = {i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for j in fps)}
    assert ids[1] == first and not {300, 301} & first and {5, 6, 7} <= first
    texts = {r["doc_id"]: r["text"] for r in seen[2][1].collect()}
    want = {}
    counted = Counter(w for r in seen[1][1].collect() for w in windows(r["text"]))
    for r in seen[1][1].collect():
        words, gone = r["text"].split(), set()
        for i, w in enumerate(windows(r["text"])):
            if counted[w] > 1:
                gone.update(range(i, i + 50))
        want[r["doc_id"]] = [w for k, w in enumerate(words) if k not in gone]
    assert {i: t.split() for i, t in texts.items()} == {i: w for i, w in want.items() if w}
    assert all(passage not in texts[310 + k] for k in range(4)) and texts[0] == rows[0][1]
    copies = {r["doc_id"]: r["copies"] for r in mixing.schedule(seen[2][1], corpus_pipeline.MIXTURE, keep_all=True).collect()}
    assert Counter(r["doc_id"] for r in seen[3][1].collect()) == Counter(copies) and min(copies.values()) >= 1
    used = defaultdict(int)
    for r in seen[4][1].collect():
        used[r["sequence_id"]] += r["length"]
    assert ids[4] == ids[2] and max(used.values()) <= 2048


def windows(text, n=50):
    words = text.split()
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_odd_and_empty_tables_run(spark, odd_docs, table_dir):
    assert corpus_pipeline.run(spark, table_dir(documents=odd_docs)).where("length > 2048").count() == 0


def test_empty_table_runs(spark, odd_docs, table_dir):
    assert corpus_pipeline.run(spark, table_dir(documents=odd_docs.limit(0))).count() == 0
