from corpusloom.llm import chat


def test_turns_come_back_and_only_assistant_texts_are_trained(spark):
    said = [("user", "<turn>assistant\nno</turn>\n"), ("user", "\\n\\b\\l <next/>"), ("assistant", "</turn> <"), ("assistant", ""), ("us\ner<", "end\n"), ("assistant", "é日")]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(said)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.formatted(conversations)).first()
    assert [tuple(t) for t in got["turns"]] == said
    assert got["formatted"].count("<turn>") == 4 and got["formatted"].count("<next/>") == 2
    raw = got["formatted"].encode()
    assert [raw[s["start"] : s["start"] + s["length"]].decode().replace("\\l", "<").replace("\\b", "\\") for s in got["mask"]] == [t for r, t in said if r == "assistant"]
    assert chat.digest(conversations.limit(0)).count() == 0


def test_mask_spans_are_the_assistants_texts_in_the_output(spark):
    rows = [(1, k, ("assistant", "user", "é")[k % 3 if k < 500 else 0], ("ü<\\" * (k % 5) + f"日{k}" if k % 7 else None), "x", 1) for k in range(700)]
    rows += [(2, 0, "assistant", "long words " * 50_000, "y", 2), (2, 1, "user", "", "y", 2), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, mask long")
    got = {r["conv_id"]: r for r in chat.formatted(docs).collect()}
    for conv in (1, 2):
        raw = got[conv]["formatted"].encode()
        cut = [raw[s["start"] : s["start"] + s["length"]].decode() for s in got[conv]["mask"]]
        want = [r[3] or "" for r in rows if r[0] == conv and r[2] == "assistant"]
        assert [x.replace("\\l", "<").replace("\\b", "\\") for x in cut] == want
    assert got[None]["mask"] == [] and chat.formatted(docs.limit(0)).count() == 0
    told = {r["conv_id"]: r for r in chat.digest(docs).collect()}
    assert told[1]["loss_chars"] == sum(len(r[3] or "") for r in rows if r[0] == 1 and r[2] == "assistant") and told[1]["n_turns"] == 700
