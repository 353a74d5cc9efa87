"""op11 to op13 over whole tables: contract columns and types, and the contract recomputed plainly."""

import os

import pytest

from lexhaul.llm.queries import QUERIES

from .test_align import naive as naive_alignment
from .test_vectors_exact import naive_clusters, naive_top

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*(("doc_id", "text") if name == "documents" else ("vec_id", "embedding"))).collect()]


def test_alignment_of_all_documents(spark):
    df = QUERIES["op11_tokenizer_alignment"](spark, SF)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [(c, dict(df.dtypes)[c]) for c in names] == [(c, "bigint") for c in names[:-1]] + [("groups_sha256", "string")]
    assert sorted(map(tuple, df.select(names).collect()), key=str) == naive_alignment(rows(spark, "documents"))[0]


def test_top_products_of_all_vectors(spark):
    df = QUERIES["op12_exact_topk"](spark, SF)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[:2]) == naive_top(rows(spark, "embeddings"), 20)


def test_clusters_of_all_vectors(spark):
    df = QUERIES["op13_centroid_clustering"](spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == naive_clusters(rows(spark, "embeddings"), 8, 10, 64)
