"""Incremental ingest as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexhaul.operators.index import IndexStore
from lexhaul.sources.files import SUPPORTED, convert, probe, suffix


def watch(spark: SparkSession, folder: str, store: IndexStore, embed: Callable[[Column], Column], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feeds new files below `folder` to the store, a snapshot for each micro-batch.

    A batch that runs again after a failure finds its hashes stored and writes nothing.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        found = convert(probe(batch.filter(suffix(F.col("path")).isin(*SUPPORTED)).select("path", "length", "content")))
        store.ingest(found.select("path", "sha256", "text", "error"), embed)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
