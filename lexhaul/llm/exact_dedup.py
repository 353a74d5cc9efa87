"""Exact duplicates: 128-bit content hash groups, bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch, broadcast_if, without_ascii_space


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_ascii_space,
    content_hash: Callable[[Column], Column] = lambda t: F.unhex(F.md5(t)),
) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Rows with equal normalised text form a group; the row with the most code points in its original
    text, then the smallest id, stays. Groups are formed by a 128-bit hash (MD5). collect_set keeps the
    distinct byte strings of each hash: one, unless two texts collide, and those rows are then grouped
    by the text itself. Both aggregations combine in each map task first, so a text with a third of all
    rows sends one row for each task. The rows meet their group in a join of narrow rows whose skewed
    partitions AQE splits.

    Null text counts as empty, all empty texts are one group. A repeated id with equal text counts each
    time in group_size; if it is the one to stay, only the copies of that id are kept. A null id sorts
    last and stays only in a group of null ids. An empty table gives an empty result. Other columns of
    `docs` are not read, whatever their names.
    """
    text = docs[text_col]
    base = docs.select(docs[id_col].alias("_id"), normalise(text).alias("_norm"), F.char_length(F.coalesce(text, F.lit(""))).alias("_chars"))
    rows = base.select("_id", "_chars", content_hash(F.col("_norm")).alias("_h"), F.sha2("_norm", 256).alias("text_sha256"))
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("id")))["id"].alias("keep_id")
    size = F.count(F.lit(1)).alias("group_size")
    scratch = Scratch(docs.sparkSession)
    groups = scratch.write(
        base.withColumn("_h", content_hash(F.col("_norm")))
        .groupBy("_h")
        .agg(best, size, (F.size(F.collect_set("_norm")) > 1).alias("_collided")),
        "groups",
    )
    out = [F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    collided = groups.filter("_collided").select("_h")
    clean = rows.join(groups.filter("NOT _collided"), "_h").select(*out)
    if collided.isEmpty():
        return clean
    mixed = base.withColumn("_h", content_hash(F.col("_norm"))).join(collided, "_h", "left_semi")
    exact = mixed.groupBy("_norm").agg(best, size)
    return clean.unionByName(mixed.withColumn("text_sha256", F.sha2("_norm", 256)).join(exact, "_norm").select(*out))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with only the row of each group that stays, all columns as they were.

    Rows that repeat both id and text of the one that stays are kept with it, as exact_dedup marks them.
    """
    scratch = Scratch(docs.sparkSession)
    found = exact_dedup(docs, id_col, text_col)
    gone = scratch.write(found.filter("NOT kept").select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha")).distinct(), "gone")
    sha = F.sha2(without_ascii_space(docs[text_col]), 256)
    return docs.join(broadcast_if(gone, gone.count(), 100_000), docs[id_col].eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti")
