"""Every registered engine query against its DuckDB counterpart, on the smallest tables."""

import os

import duckdb
import pytest

from lexhaul.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name, tmp_path):
    df = QUERIES[name](spark, SF)
    df.write.parquet(f"{tmp_path}/o")
    if name not in ORACLES:
        assert spark.read.parquet(f"{tmp_path}/o").count() > 0
        return
    cols = ", ".join(sorted(df.columns))
    a, b = f"(SELECT {cols} FROM '{tmp_path}/o/*.parquet')", f"(SELECT {cols} FROM ({ORACLES[name]}))"
    for x, y in ((a, b), (b, a)):
        assert duck.sql(f"FROM {x} EXCEPT ALL FROM {y}").fetchall() == []
