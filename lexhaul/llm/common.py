"""Shared pieces: tables, scratch tables in the cluster's shared folder, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions that name none, by application.
LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a temporary folder; on a cluster that is an error, as executors would each write to a disk of their own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='lexhaul-')}")


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive any executor.

    write() materialises a frame once and returns it as read again. drop() removes tables that
    nothing needs any more; the table behind a returned result has to stay.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/lexhaul-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.base}/{self.made:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.scratch_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            p = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            p.getFileSystem(conf).delete(p, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def without_ascii_space(text: Column) -> Column:
    """`text` without the characters of [\\x20\\x09-\\x0D]: byte-wise replaces, cheaper than a regex; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough partitions to hold at most about `per_task` rows each."""
    return max(1, -(-rows // per_task))


def broadcast_if(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint only for counted, narrow rows within `limit`; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def beside_leader(docs: DataFrame, pairs: DataFrame, prepare: Callable, compare: Callable, columns: str, id_col: str, text_col: str, per_group: int = 2000) -> DataFrame:
    """compare(prepare(text of a), prepare(text of b)) for each row of `pairs` (a, b and nothing else), whole texts.

    Returns a, b and the values of `columns` (a DDL string) that compare yields, any number of rows for a pair.
    Members travel to their leader once for each pair; a leader with many members is sent to several
    groups of about `per_group`, so no task holds more than one leader and one member at a time.
    """
    scratch = Scratch(docs.sparkSession)
    text = docs.select(docs[id_col].alias("_d"), docs[text_col].alias("_t"))
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_group).cast("int").alias("_n"))
    heads = groups.select(F.col("a").alias("_d"), "a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"), F.lit(None).cast("long").alias("b"))
    members = pairs.join(groups, "a").select(F.col("b").alias("_d"), "a", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int").alias("_s"), "b")
    ways = scratch.write(heads.unionByName(members), "ways")  # which texts go where
    dealt = text.join(broadcast_if(ways, ways.count(), 500_000), "_d").repartition("a", "_s").sortWithinPartitions("a", "_s", F.col("b").asc_nulls_first())
    names = [f.split()[0] for f in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            out = []
            for a, s, b, t in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if key != (a, s):
                    key, heads = (a, s), []
                thing = prepare(t.as_py() or "")
                if b is None:
                    heads.append(thing)
                else:
                    out += [(a, b, *found) for head in heads for found in compare(head, thing)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(["a", "b", *names], o, strict=True)) for o in out], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"a long, b long, {columns}"
    shape = to_arrow_schema(StructType.fromDDL(ddl))
    return map_arrow(dealt.select("a", "_s", "b", "_t"), run, ddl)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the rows (u, v): node, component, the smallest node that can be reached.

    Alternating large-star and small-star rounds; each is an aggregation and a join on narrow rows,
    written to the shared folder. No links are gathered in one place. Loops and nulls are ignored.
    """

    def stored(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        """A written set of edges, and a count and sums that tell it from another."""
        out = scratch.write(df.filter("u <> v").distinct(), name)
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())

    edges, mark = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.write(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, last = edges, mark
        edges, mark = stored(small, "small")
        scratch.drop(before, large)
        if mark == last:
            return scratch.write(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches of few rows: whole texts are long, and a batch is held twice, in the JVM and in Python."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 512:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return df.mapInArrow(run, schema)
