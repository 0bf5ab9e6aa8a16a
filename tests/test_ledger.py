import os as files
from collections import Counter

import pytest

from corpusloom.operators import generate


def made(folder):
    return Counter(line.strip() for name in files.listdir(folder) for line in open(files.path.join(folder, name)))


def test_no_recorded_call_is_made_again(spark, tmp_path, monkeypatch):
    import os  # of the client, in the workers

    def counting_client(folder, poison):
        """Writes a line a call into files of its own, and breaks off at a prompt as long as a file says so."""

        def call(system, prompt):
            with open(os.path.join(folder, f"{os.getpid()}.txt"), "a") as f:
                f.write(f"{prompt}\n")
            if prompt == "p31" and os.path.exists(poison):
                raise RuntimeError("killed")
            return f"answer to {prompt}", 1, 2

        return call

    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    poison = tmp_path / "poison"
    poison.touch()
    prompts = [f"p{k}" for k in range(60)] + ["p7"] * 40 + [None]
    rows = spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string")
    monkeypatch.setitem(generate.CLIENTS, "broken", lambda: counting_client(str(calls), str(poison)))
    with pytest.raises(Exception, match="killed"):
        generate.answered_once(rows, "broken", ledger, calls_per_task=5, batch_calls=1)
    recorded = {r["prediction"].removeprefix("answer to").strip() for r in spark.read.schema(generate.LEDGER).parquet(ledger).collect()}
    before = made(calls)
    assert 0 < len(recorded) < 61 and "p31" not in recorded
    poison.unlink()
    got = {r["id"]: r["prediction"] for r in generate.answered_once(rows, "broken", ledger, calls_per_task=5, batch_calls=1).collect()}
    assert got == {k: f"answer to {p or ''}".strip() for k, p in enumerate(prompts)}
    again = made(calls)
    assert all(again[p] == before[p] for p in recorded) and sum(again.values()) - sum(before.values()) == 61 - len(recorded)
    # All is recorded now: no call at all.
    assert generate.answered_once(rows, "broken", ledger).count() == 101 and made(calls) == again
    assert generate.answered_once(rows.limit(0), "broken", ledger).count() == 0
