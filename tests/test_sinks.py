"""Files as a sink: failed, repeated and refused writes."""

import os

import pytest
from pyspark.sql import functions as F

from lexhaul.sources import sinks


def content(folder):
    return {n: open(os.path.join(folder, n), encoding="utf-8", newline="").read() for n in sorted(os.listdir(folder)) if not n.startswith(".staged-")}


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "name string, text string").repartition(4)
    at = str(tmp_path / "out")
    many = spark.range(200).select(F.concat(F.lit("f"), "id", F.lit(".md")).alias("name"), F.concat(F.lit("Täxt\r\n"), "id").alias("text"))
    sinks.write_files(many, at)
    want = {f"f{k}.md": f"Täxt\r\n{k}" for k in range(200)}
    assert content(at) == want
    bad = many.withColumn("name", F.concat(F.lit("g"), "name")).withColumn("text", F.when(F.col("name") == "gf150.md", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    for df, why in ((bad, "lost"), (rows(("a.md", "1"), ("../b.md", "2")), "file name"), (rows(("a.md", "1"), ("a.md", "2")), "twice"), (rows(("a.md", "1"), ("f3.md", "2")), "already")):
        with pytest.raises(Exception, match=why):
            sinks.write_files(df, at)
        assert content(at) == want
    sinks.write_files(rows(("f3.md", "neu"), (".hidden", None)), at, overwrite=True)
    assert content(at) == want | {"f3.md": "neu", ".hidden": ""}


def test_only_what_successful_attempts_report_is_moved(tmp_path):
    writer = sinks.FileWriter(str(tmp_path), False)
    row = lambda n, t: {"name": n, "text": t}
    writer.write(iter([row("a", "first attempt"), row("b", "lost")]))  # its message never arrives
    writer.commit([writer.write(iter([row("a", "second")])), None])
    assert content(tmp_path) == {"a": "second"}
