"""Blocks as a scan over lines, against the chunker's own walk, with segments so short that every state crosses them."""

import random

import pytest
from pyspark.sql import functions as F

from lexhaul.operators import blocks as B
from lexhaul.operators import chunking as C

PARTS = ["# T", "## T ##", "####### seven", "#none", "text", " more text ", "| a | b |", "|-|-|  ", "|x", "```", "```py", "  ```  ", "~~~", "~~~~", "", "  ", "\t", "x | y |", "```` four", "# ", "#  ## #", "end ```", " | a |"]
BREAKS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x85", " "]
LITERAL = ["", "\n", "a", "a\n", "```\ncode\n\n# no\n~~~\n```\nafter", "~~~\n```\n~~~\n```\nx", "```\nopen to the end\n| a |", "| a |\n|---|\n| 1 |\ntext\n\n| b |", "p\n# h\np", "# a\n# b"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return LITERAL + ["".join(r.choice(PARTS) + r.choice(BREAKS) for _ in range(r.randint(1, 40))) for _ in range(150)]


@pytest.mark.parametrize("segment", [1, 3, 2048])
def test_blocks_equal_a_walk_over_lines(spark, texts, segment):
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string").repartition(3)
    got = {}
    for r in B.blocks(df, "doc_id", "text", segment).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.block, r.kind, r.level, r.text))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [(k, p.kind, p.level, p.text) for k, p in enumerate(C.blocks(t))], (i, t)
    assert 9999 not in got


def test_states_compose(spark):
    rows = spark.createDataFrame([(s, m) for s in range(3) for m in (1, 2)], "s int, m int").withColumn("t", B.follow(F.col("s"), F.col("m")))
    assert {(r.s, r.m): r.t for r in rows.collect()} == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 1, (2, 1): 2, (2, 2): 0}


def test_lines_of_texts_of_one_segment_are_not_shuffled(spark, texts):
    """No window over lines, and what is exchanged are segments of texts that have several."""
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    plan = B.blocks(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    first, second = plan.split("\n:- ")[1].split("\n+- ")
    assert "Window" not in plan and not any(x in first for x in ("Join", "Aggregate [", "Sort", "Repartition")) and "Join" in second
