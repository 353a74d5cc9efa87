"""What a crash between two steps leaves behind, rebuilding, and plans that have to hold at size."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from lexhaul.operators import evaluation, index, vectors
from lexhaul.operators.index import IndexStore


def embed(c):
    return F.array(F.length(c).cast("double"), F.lit(1.0))


def files(spark, rows):
    return spark.createDataFrame([(p, str(hash(t)), t, None) for p, t in rows], "path string, sha256 string, text string, error string")


class Crash(Exception):
    pass


def test_a_crash_before_the_pointer_leaves_the_old_index(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    store.ingest(files(spark, [("a.md", "eins zwei"), ("b.md", "drei")]), embed)
    before = store.read("documents").orderBy("id").collect()

    def crash(self, to, after=None):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(IndexStore, "point", crash)
        with pytest.raises(Crash):
            store.ingest(files(spark, [("a.md", "neu"), ("c.md", "vier")]), embed)
    again = IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    assert again.read("documents").orderBy("id").collect() == before
    again.ingest(files(spark, [("c.md", "vier")]), embed)
    ids = {r.path: r.id for r in again.read("documents").collect()}
    assert len(set(ids.values())) == 3 and ids["c.md"] > max(r.id for r in before)


def test_pointers_are_never_replaced_and_two_writers_cannot_both_win(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    for k in range(4):
        store.ingest(files(spark, [(f"{k}.md", f"text {k}")]), embed)
    numbers = [n for n, _ in store.pointers()]
    assert numbers == [3, 4] and store.read("documents").count() == 4
    monkeypatch.setattr(IndexStore, "pointers", lambda self: [(3, "")])  # this writer has not seen pointer 4
    with pytest.raises(OSError, match="another writer"):
        store.point({})


def test_rebuild_makes_a_new_index_and_keeps_the_old_until_it_is_whole(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    rows = [("a.md", "eins zwei"), ("b.md", "drei")]
    store.ingest(files(spark, rows), embed)
    old = {r.id for r in store.read("documents").collect()}
    bad = files(spark, rows).withColumn("error", F.when(F.col("path") == "b.md", "weg"))
    store.rebuild(bad, embed, accept=False)
    assert {r.id for r in store.read("documents").collect()} == old
    got = {r.path: r.status for r in store.rebuild(files(spark, rows), embed).collect()}
    new = {r.id for r in store.read("documents").collect()}
    assert got == {"a.md": index.NEW, "b.md": index.NEW} and not new & old and store.read("vectors").count() == store.read("chunks").count() == 2


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_passages_are_found_by_words_and_verified(spark):
    texts = {1: "alpha beta gamma delta epsilon zeta eta", 2: "xalpha beta  gamma delta epsilon zeta", 3: "eta theta", 4: None, 5: "alpha beta\ngamma delta epsilon zeta eta"}
    passages = {1: "alpha beta gamma delta epsilon zeta", 2: "pha beta gamma delta epsilon ze", 3: "theta", 4: "eta", 5: " beta gamma delta epsilon zeta ", 6: None, 7: "", 8: "no such words anywhere here now", 9: "beta gamma delta epsilon zeta"}
    docs, items = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(passages.items()), "item_id long, text string")
    got = {r.question_id: (r.dokumente, r.typ) for r in evaluation.gold_from_passages(items, docs).collect()}
    for i, p in passages.items():
        want = sorted(d for d, t in texts.items() if p and t and p in t)
        assert got[i] == (want, "ohne_antwort" if not want else "eindeutig" if len(want) == 1 else "mehrdeutig")
    assert not re.search("NestedLoop|Cartesian", plan(evaluation.gold_from_passages(items, docs)))
    small = {r.question_id: (r.dokumente, r.typ) for r in evaluation.gold_from_passages(items, docs, most_chars=20).collect()}
    assert small == got  # several automata
    assert evaluation.gold_from_passages(items.limit(0), docs).count() == 0


def test_many_queries_meet_all_rows_in_blocks(spark):
    r = [[float((k * 7 + j * 3) % 11 - 5) for j in range(4)] for k in range(60)]
    v = spark.createDataFrame([(k, x) for k, x in enumerate(r)] + [(60, [0.0] * 4), (61, None)], "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as query")
    rows = lambda df: sorted((x.query_id, x["rank"], x.vec_id, round(x.distance, 6)) for x in df.collect())
    whole, blocks = vectors.knn_batch(v, q, 4), vectors.knn_batch(v, q, 4, block=3, rows_per_block=10)
    assert rows(whole) == rows(blocks) and "Cartesian" not in plan(blocks)
    assert len(re.findall(r"^\(\d+\) Generate", plan(blocks), re.M)) == 2  # in the first and the final plan: only queries are copied


def test_texts_of_an_ingest_are_written_as_pieces_only(spark, tmp_path):
    """Ids are made from paths and counts; the numbers are those of all chunks in the order of their documents."""
    store = IndexStore(spark, f"{tmp_path}/i", "stub", 2)
    rows = [(f"{k}.md", f"# a\ntext {k}\n# b\nmore") for k in range(20)]
    store.ingest(files(spark, [*rows, rows[3]]).repartition(3), embed)
    work = [p for p in (tmp_path / "i" / "work").iterdir() if p.is_dir()]
    assert [p.name.rpartition("-")[2] for p in work if "text" in spark.read.parquet(str(p)).columns] == ["pieces"]
    found = store.read("chunks").join(store.read("documents").select(F.col("id").alias("document_id"), "path"), "document_id").withColumn("hash", index.id_order(F.col("path"))).orderBy("hash", "path", "ordinal").collect()
    assert [r.id for r in found] == list(range(1, len(found) + 1)) and len(found) > 20
    numbers = index.numbered(spark.createDataFrame([(k, k % 3) for k in range(30)], "k long, w int"), ["k"], 5, folder=str(tmp_path), parts=4, weight="w").orderBy("k").collect()
    assert [(r.id, r.before) for r in numbers] == [(6 + k, sum(j % 3 for j in range(k))) for k in range(30)]
