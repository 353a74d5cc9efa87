"""State over streams: what has changed of a set of files, and which sources a conversation holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexhaul.operators.index import NEW, UNCHANGED, UPDATED, IndexStore

#: Result word for a file that is no longer there.
REMOVED = "entfernt"


def needs_state(spark: SparkSession) -> None:
    """transformWithState keeps several variables for each key, which the RocksDB store can."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FileState(StatefulProcessor):
    """For each path the hash and the place in order of what was last seen."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sha256 string, seq long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        sha, seq = (held[0], held[1]) if held else (None, None)
        before, text, error = sha, None, None
        for r in sorted(rows, key=lambda r: r["seq"]):
            if seq is None or r["seq"] > seq:  # a listing that comes again or late changes nothing
                sha, seq, text, error = r["sha256"], r["seq"], r["text"], r["error"]
        if not held and seq is None:
            return
        self.last.update((sha, seq))
        status = REMOVED if sha is None else NEW if before is None else UNCHANGED if sha == before else UPDATED
        if sha is not None or before is not None:
            yield Row(path=key[0], status=status, sha256=sha, text=text if status in (NEW, UPDATED) else None, error=error)

    def close(self) -> None:
        pass


def file_changes(listing: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """[2.11] path, status (neu, aktualisiert, unverändert, entfernt), sha256, text, error of each path of a micro-batch.

    listing: a stream of path, sha256 (null: the file is gone), text, error, seq, a number that grows with each look at a file. Of several
    rows of a path the last one counts; rows that are not newer than what the state holds are ignored, so a
    replayed listing gives no change. With `ttl_ms` a path that is not listed for so long is forgotten, and new when it comes again. One
    value for each path is all that is kept; texts are not.
    """
    needs_state(listing.sparkSession)
    return listing.groupBy("path").transformWithState(FileState(ttl_ms), "path string, status string, sha256 string, text string, error string", "Update", "ProcessingTime" if ttl_ms else "None")


def follow_files(listing: DataFrame, store: IndexStore, embed: Callable[[Column], Column], checkpoint: str, ttl_ms: int | None = None, compact: bool = True) -> StreamingQuery:
    """Keeps an index in step with a stream of listings: each micro-batch writes what has changed, one run, and deletes what is gone.

    A batch that runs again after a failure finds its hashes stored and its removed paths gone, and writes nothing.
    Without `ttl_ms` the query ends when all that is there has been read; with it time itself makes batches, and it runs until it is stopped.
    """

    def each(batch: DataFrame, number: int) -> None:
        changed = store.kept(batch.filter(F.col("status") != UNCHANGED), "changes")
        if changed.isEmpty():
            return
        store.ingest(changed.filter(F.col("status") != REMOVED).select("path", "sha256", "text", "error"), embed)
        store.forget(changed.filter(F.col("status") == REMOVED).select("path"))
        if compact:
            store.compact()

    writer = file_changes(listing, ttl_ms).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if ttl_ms else writer.trigger(availableNow=True)).start()


class SourceState(StatefulProcessor):
    """For each chunk of a conversation the newest turn that used it, and its place there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "chunk_id long", "turn long, pos long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for r in rows:
            chunk = (r["chunk_id"],)
            known = self.held.getValue(chunk) if self.held.containsKey(chunk) else None
            if known is None or (-r["turn"], r["pos"]) < (-known[0], known[1]):
                self.held.updateValue(chunk, (r["turn"], r["pos"]))
        found = sorted((-v[0], v[1], k[0]) for k, v in self.held.iterator())
        for n, (turn, pos, chunk_id) in enumerate(found):
            yield Row(conv_id=key[0], chunk_id=chunk_id, turn=-turn, pos=pos, reuse_rank=n + 1)

    def close(self) -> None:
        pass


def held_sources(sources: DataFrame) -> DataFrame:
    """[R4, 2.11] For each conversation that a micro-batch adds to: all its chunks at their newest turn, in the order of ranking.reusable_hits().

    sources: a stream of conv_id, turn, pos, chunk_id. The order does not depend on how turns are dealt to batches, or on
    turns that come late or twice. What is kept is one entry for each chunk of a conversation.
    """
    needs_state(sources.sparkSession)
    rows = sources.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("pos").cast("long").alias("pos"), F.col("chunk_id").cast("long").alias("chunk_id"))
    return rows.groupBy("conv_id").transformWithState(SourceState(), "conv_id long, chunk_id long, turn long, pos long, reuse_rank int", "Update", "None")
