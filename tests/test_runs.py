"""Log-structured tables: merge on read, compaction, crashes at each step, readers and writers at once."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lexhaul.operators import index, runs, vectors
from lexhaul.operators.index import IndexStore
from lexhaul.operators.runs import Pointers, RunStore, WriteConflict


def store_at(spark, path):
    return RunStore(spark, f"{path}", {"t": ("k long, v string", "k")})


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def content(df):
    return sorted((r.k, r.v) for r in df.collect())


def put(s, rows, also=()):
    """Replaces rows by key and deletes the keys of `also`."""
    df = frame(s.spark, rows)
    return s.append({"t": df}, df.select(F.col("k").alias("key")).union(s.spark.createDataFrame([(k,) for k in also], "key long")))


def test_random_writes_and_compactions_equal_a_dictionary(spark, tmp_path):
    s, r, want, old = store_at(spark, tmp_path / "s"), random.Random(1), {}, []
    for step in range(12):
        rows = {k: f"{step}.{k}" for k in r.sample(range(40), r.randint(0, 6))}
        gone = [k for k in r.sample(range(40), 5) if k not in rows]
        put(s, list(rows.items()), gone)
        want = {k: v for k, v in want.items() if k not in gone} | rows
        if step == 6:
            old.append((s.read("t"), sorted(want.items())))
        if step % 4 == 3:
            before = len(s.log.current()["runs"])
            n = s.compact(r.choice([2, 3, before]))
            assert len(s.log.current()["runs"]) == before - n + 1
        assert content(s.read("t")) == sorted(want.items())
    s.compact(100)
    only = s.log.current()["runs"]
    assert len(only) == 1 and not only[0]["rows"].get("deleted") and only[0]["rows"]["t"] == len(want)
    assert content(s.read("t")) == sorted(want.items())
    assert content(old[0][0]) == old[0][1]  # a reader from before the compaction still has its rows
    assert s.vacuum(min_age_s=3600) == [] and len(s.vacuum(min_age_s=0)) > 10
    assert content(store_at(spark, tmp_path / "s").read("t")) == sorted(want.items())


def test_sizes_decide_what_is_merged(spark, tmp_path):
    s = store_at(spark, tmp_path / "s")
    run = lambda n: {"rows": {"t": n}}
    assert s.due([run(1)] * 7) == 0 and s.due([run(1)] * 8) == 8
    assert s.due([run(10**6), *[run(3)] * 8]) == 8 and s.due([run(10**6), run(500), *[run(3)] * 7]) == 0
    assert s.due([run(10**6), *[run(500)] * 7, *[run(3)] * 8]) == 8


def test_a_write_costs_what_changes(spark, tmp_path):
    base = str(tmp_path / "i")
    store = IndexStore(spark, base, "stub", 2)
    n = 100_000
    ids = spark.range(1, n + 1)
    docs = ids.select("id", F.format_string("/d/%06d.md", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit(".md").alias("format"), F.lit(1).alias("page_count"), F.lit(9).cast("long").alias("char_count"), F.lit(False).alias("ocr_used"), F.lit(1).alias("chunk_count"), F.current_timestamp().alias("ingested_at"))
    chunks = ids.select("id", F.col("id").alias("document_id"), F.lit(0).alias("ordinal"), F.concat(F.lit("text "), "id").alias("text"), F.array().cast("array<string>").alias("heading_path"), F.lit("prosa").alias("kind"), F.lit(2).alias("token_count"))
    store.commit(docs, chunks, ids.select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding")), {"documents": n, "chunks": n})

    def all_files():
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names}

    before = all_files()
    one = spark.createDataFrame([("/d/000007.md", "anders", "ein neuer Text", None)], "path string, sha256 string, text string, error string")
    assert [r.status for r in store.ingest(one, lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))).collect()] == [index.UPDATED]
    after = all_files()
    assert all(after[f] == size for f, size in before.items() if "CURRENT" not in f)
    assert sum(size for f, size in after.items() if f not in before) < 0.05 * sum(before.values())
    assert store.read("documents").count() == store.read("chunks").count() == store.read("vectors").count() == n
    assert store.read("chunks").filter("text = 'text 7'").isEmpty() and store.read("documents").filter("path = '/d/000007.md'").first().id == n + 1


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["add_run", "publish", "after"])
@pytest.mark.parametrize("what", ["ingest", "compact", "rebuild"])
def test_a_crash_at_any_step_leaves_the_old_or_the_new_rows(spark, tmp_path, monkeypatch, step, what):
    texts = lambda rows: spark.createDataFrame([(p, t, t, None) for p, t in rows], "path string, sha256 string, text string, error string")
    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    store = IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    store.ingest(texts([("a.md", "eins"), ("b.md", "zwei")]), embed)
    store.ingest(texts([("a.md", "anders")]), embed)
    state = lambda: sorted((r.document_id, r.text) for r in IndexStore(spark, f"{tmp_path}/i", "stub", 2).read("chunks").collect())
    old = state()
    do = {"ingest": lambda s: s.ingest(texts([("b.md", "neu"), ("c.md", "drei")]), embed), "compact": lambda s: s.compact(2), "rebuild": lambda s: s.rebuild(texts([("c.md", "drei")]), embed)}[what]
    real = {"add_run": IndexStore.add_run, "publish": Pointers.publish}

    def crash(self, *args, **how):
        if step == "add_run":
            real["add_run"](self, *args, **how)  # the run is written, nothing names it
        if step == "after":
            real["publish"](self, *args, **how)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(*((IndexStore, "add_run") if step == "add_run" else (Pointers, "publish")), crash)
        with pytest.raises(Crash):
            do(store)
    left = state()
    if step == "after":
        assert (left == old) == (what == "compact")
    else:
        assert left == old
        do(IndexStore(spark, f"{tmp_path}/i", "stub", 2))
    ids = [r.id for r in store.read("documents").collect()]
    assert len(ids) == len(set(ids)) and store.read("chunks").count() == store.read("vectors").count() == len(ids)
    store.vacuum(min_age_s=0)
    assert store.read("chunks").count() == len(ids) and not os.listdir(tmp_path / "i" / "work")


def test_readers_and_writers_at_once(spark, tmp_path):
    """A reader of another session keeps its rows while a writer replaces them; of two writers one wins and nothing is lost."""
    one, other = store_at(spark, tmp_path / "s"), store_at(spark.newSession(), tmp_path / "s")
    put(one, [(1, "a"), (2, "b")])
    reading = other.read("t")
    number, state = other.log.latest()
    put(one, [(1, "c")], [2])
    one.compact(10)
    assert content(reading) == [(1, "a"), (2, "b")] and content(other.read("t")) == [(1, "c")]
    run = other.add_run(state, {"t": frame(other.spark, [(9, "late")])})
    with pytest.raises(WriteConflict):
        other.publish({**state, "runs": [*state["runs"], run]}, number)
    put(other, [(9, "late")])
    assert content(one.read("t")) == [(1, "c"), (9, "late")]


def test_a_pointer_that_is_not_whole_is_not_read_and_keeps_its_number(spark, tmp_path):
    s = store_at(spark, tmp_path / "s")
    put(s, [(1, "a")])
    broken = tmp_path / "s" / "CURRENT-000000000002"
    broken.write_text('{"runs": [')
    assert content(s.read("t")) == [(1, "a")]
    with pytest.raises(WriteConflict):
        put(s, [(2, "b")])
    then = time.time() - 2 * runs.PATIENCE_S
    os.utime(broken, (then, then))
    put(s, [(2, "b")])
    assert content(s.read("t")) == [(1, "a"), (2, "b")] and s.log.pointers()[-1][0] == 3


def test_what_does_not_fit_is_not_written(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    texts = lambda rows: spark.createDataFrame([(p, t, t, None) for p, t in rows], "path string, sha256 string, text string, error string")
    with pytest.raises(index.DataError, match="dimensions"):
        store.ingest(texts([("a.md", "eins")]), lambda c: F.array(F.lit(1.0)))
    with pytest.raises(index.DataError, match="twice"):
        store.ingest(texts([("a.md", "eins"), ("a.md", "zwei")]), lambda c: F.array(F.lit(1.0), F.lit(2.0)))
    assert store.current() is None
    store.ingest(texts([("a.md", "eins"), ("a.md", "eins")]), lambda c: F.array(F.lit(1.0), F.lit(2.0)))
    assert store.read("chunks").count() == 1


def test_a_vector_table_replaces_deletes_and_adds_again(spark, tmp_path):
    t = vectors.VectorTable(spark, f"{tmp_path}/v", 2)
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id long, embedding array<float>")
    ids = lambda *r: spark.createDataFrame([(i,) for i in r], "chunk_id long")
    t.add(rows((1, [1.0, 0.0]), (2, [0.0, 1.0])))
    t.delete(ids(1))
    assert {r.chunk_id for r in t.read().collect()} == {2}
    t.add(rows((1, [0.5, 0.5]), (2, [1.0, 1.0])))
    for _ in range(2):
        assert sorted((r.chunk_id, list(r.embedding)) for r in t.read().collect()) == [(1, [0.5, 0.5]), (2, [1.0, 1.0])]
        t.store.compact(10)
    with pytest.raises(ValueError, match="twice"):
        t.add(rows((3, [1.0, 0.0]), (3, [0.0, 1.0])))
    t.drop()
    assert t.count() == 0


def test_numbers_are_dense_and_do_not_depend_on_the_parts(spark):
    rows = spark.createDataFrame([(f"p{k % 37:02d}", k // 37) for k in range(500)], "path string, n int").repartition(5)
    want = sorted((r.path, r.n) for r in rows.collect())
    for parts in (1, 3, 40, None):
        got = {(r.path, r.n): r.id for r in index.numbered(rows, ["path", "n"], 10, parts=parts).collect()}
        assert [got[x] for x in want] == list(range(11, 511))
    ids = [sorted((r.path, r.n, r.id) for r in index.assign_ids(rows, ["path", "n"], 7, parts=p).collect()) for p in (2, 9)]
    assert ids[0] == ids[1] and sorted(x[2] for x in ids[0]) == list(range(8, 508))
    assert index.numbered(rows.limit(0), ["path"], 3).count() == 0
