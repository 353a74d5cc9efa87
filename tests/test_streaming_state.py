"""Streams with state: changed, removed and replayed files, conversations in any order, restart from the checkpoint."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexhaul.operators import ranking
from lexhaul.operators.index import IndexStore
from lexhaul.streaming import state

LISTING = "path string, sha256 string, text string, error string, seq long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def embed(c):
    return F.array(F.length(c).cast("double"), F.lit(1.0))


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def run(query):
    assert query.awaitTermination(60) and query.exception() is None


def test_an_index_follows_changed_removed_and_replayed_files(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "in", IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    stream = lambda: spark.readStream.schema(LISTING).json(str(folder))
    go = lambda: run(state.follow_files(stream(), store, embed, f"{tmp_path}/cp"))
    texts = lambda: {r.text for r in store.read("chunks").collect()}
    look = lambda seq, **files: [(f"{p}.md", t and f"h{t}", t, None, seq) for p, t in files.items()]
    put(spark, folder, look(1, a="eins", b="zwei", c="drei"), LISTING)
    go()
    assert texts() == {"eins", "zwei", "drei"}
    before = {r.path: r.id for r in store.read("documents").collect()}
    put(spark, folder, look(2, a="eins", b="neu", c=None), LISTING)  # a new query: it goes on from the checkpoint
    go()
    after = {r.path: r.id for r in store.read("documents").collect()}
    assert texts() == {"eins", "neu"} and after["a.md"] == before["a.md"] and after["b.md"] > max(before.values())
    snapshot = store.log.pointers()[-1]
    put(spark, folder, look(1, a="eins", b="zwei", c="drei") + look(2, a="eins", b="neu"), LISTING)  # an old listing comes again
    go()
    assert store.log.pointers()[-1] == snapshot
    put(spark, folder, look(3, c="wieder") + look(4, c="da") + look(5, b=None), LISTING)

    def crash(self, paths):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(IndexStore, "forget", crash)
        query = state.follow_files(stream(), store, embed, f"{tmp_path}/cp")
        with pytest.raises(Exception, match="lost"):
            query.awaitTermination(120)
    assert texts() == {"eins", "neu", "da"}  # half of the batch is done, and the batch runs again
    go()
    assert texts() == {"eins", "da"}
    ids = [r.id for r in store.read("documents").collect()]
    assert len(ids) == len(set(ids)) == 2 == store.read("vectors").count()


def test_status_of_each_path(spark, tmp_path):
    folder, seen = tmp_path / "in", []

    def go(ttl_ms=None):
        seen.clear()
        writer = state.file_changes(spark.readStream.schema(LISTING).json(str(folder)), ttl_ms).writeStream.foreachBatch(lambda df, n: seen.extend((r.path, r.status, r.text) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp-{ttl_ms}")
        if ttl_ms is None:
            run(writer.trigger(availableNow=True).start())
        else:  # time makes batches without end
            query, until = writer.start(), time.time() + 60
            while not seen and time.time() < until:
                time.sleep(0.2)
            query.stop()
        return sorted(seen)

    put(spark, folder, [("a", "1", "x", None, 1), ("b", None, None, None, 1)], LISTING)
    assert go() == [("a", "neu", "x")] == go(ttl_ms=3_600_000)
    put(spark, folder, [("a", "3", "z", None, 3), ("a", None, None, None, 2), ("b", "2", "y", None, 2)], LISTING)
    assert go() == [("a", "aktualisiert", "z"), ("b", "neu", "y")]


def test_held_sources_equal_the_batch_order_however_turns_arrive(spark, tmp_path):
    r = random.Random(8)
    shape = "conv_id long, turn long, pos long, chunk_id long"
    rows = [(c, t, p, r.randrange(6)) for c in range(5) for t in range(6) for p in range(3)]
    want = {}
    for x in ranking.reusable_hits(spark.createDataFrame(rows, shape)).collect():
        want.setdefault(x.conv_id, []).append((x.reuse_rank, x.chunk_id, x.turn, x.pos))
    r.shuffle(rows)
    folder, last = tmp_path / "in", {}

    def each(df, n):
        found = {}
        for x in df.collect():
            found.setdefault(x.conv_id, []).append((x.reuse_rank, x.chunk_id, x.turn, x.pos))
        last.update(found)

    for k in range(3):  # each part by a query of its own, the last with repeats
        put(spark, folder, rows[30 * k : 30 * k + 30] + (rows[:10] if k == 2 else []), shape)
        run(state.held_sources(spark.readStream.schema(shape).json(str(folder))).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    assert {c: sorted(v) for c, v in last.items()} == {c: sorted(v) for c, v in want.items()}
