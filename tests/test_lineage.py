import os
import threading

from corpusloom.operators import lineage


def test_a_block_deletes_its_own_tables_only(spark):
    inside, stored, go_on = threading.Event(), threading.Event(), threading.Event()
    found = {}

    def other():
        inside.wait()
        with lineage.scratch_until_here(spark):
            found["table"] = lineage.checkpointed(spark.range(7))
            stored.set()
            go_on.wait()
            found["n"] = found["table"].count()

    thread = threading.Thread(target=other)
    thread.start()
    with lineage.scratch_until_here(spark):
        own = lineage.checkpointed(spark.range(3))
        inside.set()
        stored.wait()
        with lineage.scratch_until_here(spark):
            deep = lineage.checkpointed(spark.range(2))
        assert own.count() == 3 and not os.path.exists(deep._path)
    assert not os.path.exists(own._path) and os.path.exists(found["table"]._path)
    go_on.set()
    thread.join()
    assert found["n"] == 7 and not os.path.exists(found["table"]._path)
    kept = lineage.checkpointed(spark.range(4))
    assert kept.count() == 4
    lineage.discard(kept)
    assert not os.path.exists(kept._path)
