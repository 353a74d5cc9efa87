"""The stages against brute force on the smallest tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from lexhaul.llm.common import Scratch

from .test_decontam import brute as brute_hits
from .test_dedup import brute_classes, brute_exact

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    text = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    found = stages["language_id"](spark, docs, SF)
    assert found.columns == docs.columns and found.count() >= 0.99 * docs.count()
    once = stages["exact_dedup"](spark, found, SF)
    assert ids(once) == Counter(k[0] for k in brute_exact(text(found)).elements() if k[3])
    apart = stages["jaccard_join"](spark, once, SF)
    assert ids(apart) == Counter(k[0] for k in brute_classes(text(once)).elements() if k[0] == k[2])
    clean = stages["decontamination"](spark, apart, SF)
    assert clean.columns == docs.columns and ids(clean) == Counter(k[0] for k in brute_hits(text(apart), bench).elements() if not k[5])
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == set(ids(clean))


@pytest.fixture
def stored(spark, frame, tmp_path):
    """A folder with tables documents and benchmark of the given rows."""

    def make(rows, items):
        frame([(i, t, "xx") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id string, text string, doc_id long, _gone string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_odd_rows_in_every_stage(spark, corpus, stored):
    """Nulls in any column, blank and very long texts, copies, repeated ids and rows, clashing columns, through all stages."""
    base = dict(corpus[:60])
    source = next(t for t in base.values() if len(t.split()) > 80)
    items = [("a", " ".join(source.split()[20:40]), 1, "x"), ("b", None, None, None), ("c", "", 0, None), ("a", " ".join(source.split()[20:40]), 1, "x")]
    sf = stored([*corpus, *corpus[:3], (508, source)], items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    text = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    bench = [(i, t) for i, t, *_ in items]
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark)
    found = scratch.write(stages["language_id"](spark, docs, sf), "stage")
    assert found.columns == docs.columns
    prose = Counter(i for i, t in text(docs) if t and len(t.split()) >= 30)
    assert prose <= ids(found) and not ids(found).keys() & {500, 501, 502}
    once = scratch.write(stages["exact_dedup"](spark, found, sf), "stage")
    assert once.columns == docs.columns and ids(once) == Counter(k[0] for k in brute_exact(text(found)).elements() if k[3])
    apart = scratch.write(stages["jaccard_join"](spark, once, sf), "stage")
    assert apart.columns == docs.columns and ids(apart) == Counter(k[0] for k in brute_classes(text(once)).elements() if k[0] == k[2])
    clean = scratch.write(stages["decontamination"](spark, apart, sf), "stage")
    assert clean.columns == docs.columns and ids(clean) == Counter(k[0] for k in brute_hits(text(apart), bench).elements() if not k[5])
    assert ids(clean) != ids(apart)
    packed = stages["packing"](spark, clean, sf)
    assert Counter(r.doc_id for r in packed.collect() if r.piece == 0) == ids(clean)


def test_empty_tables_in_every_stage(spark, stored):
    sf = stored([], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
