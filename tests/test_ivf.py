"""Approximate search: recall against exact search, exact distances, pruned files, odd rows and hot lists."""

import contextlib
import io
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexhaul.operators import ivf, vectors

SF = "/root/testdata/sf0.1"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def asked(df, every):
    return df.filter(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def hits(df):
    return sorted((r.query_id, r["rank"], r["id"] if "id" in df.columns else r.vec_id, round(r.distance, 6)) for r in df.collect())


def test_recall_of_every_fiftieth_row_against_all(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = ivf.IvfIndex(spark, f"{tmp_path}/i")
    index.build(e)
    state = index.log.current()
    assert state["rows"] == e.count() and 1 < state["probes"] < len(state["parts"])
    q = asked(e, 50)
    want, got = {}, {}
    for x in vectors.knn_batch(e, q, 10).collect():
        want.setdefault(x.query_id, {})[x.vec_id] = round(x.distance, 6)
    for x in index.search(q, 10).collect():
        got.setdefault(x.query_id, {})[x["id"]] = round(x.distance, 6)
    assert sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.9 * sum(map(len, want.values()))
    assert all(d == want[i][v] for i in want for v, d in got[i].items() if v in want[i])


def test_all_lists_and_all_rows_give_the_exact_result(spark, tmp_path):
    """With copies of one vector as a third of all rows, parts of lists and blocks of queries."""
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=9).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 9) for i in range(150)]
    rows += [(2000, None), (2050, [0.0] * 9), (2100, [1.0] * 8), (2150, [float("nan")] * 9), (None, [0.25] * 9)]
    df = rows_of(spark, rows)
    index = ivf.IvfIndex(spark, f"{tmp_path}/i")
    index.build(df, lists=7, spaces=4, rows_per_part=40)
    q = asked(df.filter("vec_id <> 2100"), 50)
    known = df.filter("vec_id IS NOT NULL")
    index.build(known, lists=7, spaces=4, rows_per_part=40)
    assert max(p for _, p in index.log.current()["parts"]) > 3
    assert hits(index.search(q, 5, probes=7, rescore=200, queries_per_block=2)) == hits(vectors.knn_batch(known.filter("size(embedding) = 9"), q, 5))


def test_searches_read_the_probed_lists_only(spark, tmp_path):
    r = np.random.default_rng(6)
    centers = r.normal(size=(20, 8)) * 5
    df = rows_of(spark, [(i, (centers[i % 20] + r.normal(size=8) * 0.1).tolist()) for i in range(2000)])
    index = ivf.IvfIndex(spark, f"{tmp_path}/i")
    index.build(df, lists=20, spaces=4)
    found = index.search(df.filter("vec_id = 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3, probes=2)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain("formatted")
    filters = re.findall(r"PartitionFilters: \[([^\n]*)\]", out.getvalue())
    assert any(re.search(r"list#\d+ IN \(\d+,\d+\)", f) for f in filters), filters
    assert "Cartesian" not in out.getvalue() and "NestedLoop" not in out.getvalue()
    read = index.rows(index.log.current(), [3, 5], "id long")
    assert {re.search(r"list=(\d+)", f)[1] for f in read.inputFiles()} <= {str(k) for k in range(20)} and {r[0] for r in read.select("list").distinct().collect()} <= {3, 5}
    assert hits(found)[0][2] == 40


def test_empty_and_tiny_tables(spark, tmp_path):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    index = ivf.IvfIndex(spark, f"{tmp_path}/i")
    assert index.search(q, 3).count() == 0
    index.build(rows_of(spark, []))
    assert index.search(q, 3).count() == 0
    index.build(rows_of(spark, [(5, [1.0, 1.0])]))
    assert hits(index.search(q, 3)) == [(1, 1, 5, 0.292893)]
    index.build(rows_of(spark, [(6, [0.0, 0.0])]))
    assert index.search(q, 3).count() == 0


def test_batches_stay_small_however_many_lists_are_probed(monkeypatch):
    """Steps of any size give the same lists, and no batch of copies of queries grows with lists or probes."""
    r = np.random.default_rng(2)
    x, centers = r.normal(size=(500, 8)), r.normal(size=(90, 8))
    x[7] = 0
    model = ivf.Quantizer(centers, [])
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(x.tolist())], ["q", "v"])
    want = ((x[:, None] - centers) ** 2).sum(2)
    for held in (1, 1000, 1 << 20):
        monkeypatch.setattr(ivf, "HELD", held)
        assert np.array_equal(ivf.nearest(x, centers), want.argmin(1)) and np.array_equal(model.probe(x, 9), want.argsort(axis=1)[:, :9])
        out = list(ivf.asking(model, batch, 60, "q"))
        assert all(b.num_rows * 8 <= max(held, 60 * 8) for b in out)
        unit, good = ivf.unit(x)
        near = model.probe(unit, 60)
        assert [(q, k) for b in out for q, k in zip(b["q"].to_pylist(), b["list"].to_pylist(), strict=True)] == [(q, k) for q in range(500) if good[q] for k in near[q]]
    assert len(ivf.nearest(x[:0], centers)) == 0 and model.probe(x[:0], 9).shape == (0, 9)
