"""The index as Parquet snapshots: incremental ingest, replacement, pruning, ids, statistics."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhaul.operators.runs import RunStore, file_system
from lexhaul.session import shared_folder

SCHEMA_VERSION = 2
DOCUMENTS = "id long, path string, sha256 string, format string, page_count int, char_count long, ocr_used boolean, chunk_count int, ingested_at timestamp"
CHUNKS = "id long, document_id long, ordinal int, text string, heading_path array<string>, kind string, token_count int"
VECTORS = "chunk_id long, embedding array<float>"
#: Result words of an ingest, fixed by the data model.
NEW, UPDATED, UNCHANGED, EMPTY, FAILED = "neu", "aktualisiert", "unverändert", "leer", "fehler"


def ingest_status(listing: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """[D1, J3, P3] path, status, chunk_count of each listed file (path, sha256, and optionally error, n_chunks).

    A missing or unreadable file has an error; a file with the stored hash is unchanged unless forced and
    keeps its stored chunk count; one without chunks is empty, and its old chunks stay.
    """
    has = {c: F.col(f"l.{c}") if c in listing.columns else None for c in ("error", "n_chunks")}
    error = has["error"] if has["error"] is not None else F.lit(None).cast("string")
    n = has["n_chunks"] if has["n_chunks"] is not None else F.lit(None).cast("int")
    known = F.col("d.path").isNotNull()
    status = (
        F.when(error.isNotNull(), FAILED)
        .when(known & (F.col("d.sha256") == F.col("l.sha256")) & ~F.lit(force), UNCHANGED)
        .when(n == 0, EMPTY)
        .when(known, UPDATED)
        .otherwise(NEW)
    )
    joined = listing.alias("l").join(documents.alias("d"), F.col("l.path") == F.col("d.path"), "left")
    return joined.select(F.col("l.path").alias("path"), status.alias("status"), F.when(status == UNCHANGED, F.col("d.chunk_count")).otherwise(n).alias("chunk_count"))


def replace_rows(existing: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """[D3, D4, S15] Whole replacement by key: what is not in `changed` stays, all of `changed` comes in."""
    return existing.join(changed.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(changed.select(*existing.columns))


def missing(documents: DataFrame, present: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """[D5, J4, P9] Documents neither in the run nor on disk."""
    gone = documents.join(present.select("path").distinct(), "path", "left_anti")
    return gone if on_disk is None else gone.join(on_disk.select("path").distinct(), "path", "left_anti")


def id_order(path: Column) -> Column:
    return F.substr(F.sha2(path, 256), F.lit(1), F.lit(2))


def numbered(rows: DataFrame, order: list[str], start: int = 0, out: str = "id", folder: str | None = None, parts: int | None = None, weight: str | None = None, before: str = "before") -> DataFrame:
    """[D6] Dense numbers from `start` + 1 on, in the order of the columns `order`.

    Rows are dealt to `parts` ranges of about equal size by sampled bounds and written once to `folder` (default: the
    shared one); each range is numbered on its own and moved by the sizes of those before it, which are all that the driver sees. So no
    task sees all rows, and a second run, also with another number of parts, gives the same numbers if `order` is unique.
    With `weight` (a column) the column `before` is added: the sum of the weights of all rows before.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{folder or shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    total = F.coalesce(F.sum(F.col(weight).cast("long") if weight else F.lit(0)), F.lit(0)).cast("long")
    at, sums, moved = start, 0, []
    for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), total.alias("w")).orderBy("_part").collect():
        moved += [F.lit(r["_part"]), F.struct(F.lit(at).cast("long").alias("n"), F.lit(sums).cast("long").alias("w"))]
        at, sums = at + r["n"], sums + r["w"]
    base = F.element_at(F.create_map(*moved), F.col("_part")) if moved else F.lit(None).cast("struct<n:long,w:long>")
    own = Window.partitionBy("_part").orderBy(*order)
    found = {out: (base["n"] + F.row_number().over(own)).cast("long")}
    if weight:
        found[before] = base["w"] + F.coalesce(F.sum(F.col(weight).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumns(found).drop("_part")


def assign_ids(rows: DataFrame, order: list[str], high_water: int, out: str = "id", folder: str | None = None, parts: int | None = None, weight: str | None = None, before: str = "before") -> DataFrame:
    """[D6] Dense ids above the high-water mark, in order of the first two hash digits of the first column, then of `order`; see numbered()."""
    return numbered(rows.withColumn("_hash", id_order(F.col(order[0]))), ["_hash", *order], high_water, out, folder, parts, weight, before).drop("_hash")


def stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """[D9, A1] One row: documents, chunks, tokens, and vectors if given."""
    out = documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens")))
    return out if vectors is None else out.crossJoin(vectors.agg(F.count(F.lit(1)).alias("vectors")))


def report(results: DataFrame) -> DataFrame:
    """[D10, A2] status, files, chunks."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))


class CompatibilityError(ValueError):
    """The stored index belongs to another schema, model, dimension or backend."""


class DataError(ValueError):
    """What is to be written does not fit together."""


class IndexStore(RunStore):
    """[§1.4, D2, D3, D7, D8, S13, S15] Documents, chunks and vectors as log-structured tables; see RunStore.

    Each ingest adds one run with the rows of new and changed files, and the ids of the documents that they replace
    as deletions, so its cost follows the change. A crash at any point leaves the old or the new index; of two
    writers at once one gets a WriteConflict and may repeat.
    """

    def __init__(self, spark: SparkSession, base: str, embedder: str, dimensions: int, backend: str = "parquet", profile: str = "default") -> None:
        super().__init__(spark, base, {"documents": (DOCUMENTS, "id"), "chunks": (CHUNKS, "document_id"), "vectors": (f"{VECTORS}, document_id long", "document_id")})
        self.meta = {"schema_version": str(SCHEMA_VERSION), "embedder": embedder, "dimensions": str(dimensions), "vector_backend": backend, "embedder_profile": profile}

    def fresh(self) -> dict:
        return {**super().fresh(), "meta": self.meta, "high_water": {"documents": 0, "chunks": 0}}

    def pointers(self) -> list[tuple[int, str]]:
        return self.log.pointers()

    def current(self) -> dict | None:
        return self.log.current()

    def point(self, to: dict, after: int | None = None) -> None:
        """Makes `to` current; `after` is the pointer that it was made from, by default the last one."""
        self.log.publish(to, self.pointers()[-1][0] if after is None else after)

    def publish(self, state: dict, after: int) -> None:
        self.point(state, after)

    def check(self) -> None:
        found = (self.current() or {}).get("meta", self.meta)
        for key in ("schema_version", "embedder", "dimensions", "vector_backend"):
            if found.get(key) != self.meta[key]:
                raise CompatibilityError(f"{key}: the index has {found.get(key)!r}, asked for {self.meta[key]!r}")

    def read(self, name: str) -> DataFrame:
        found = super().read(name)
        return found.drop("document_id") if name == "vectors" else found

    def commit(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], high_water: dict[str, int], deleted: DataFrame | None = None, replace: bool = False) -> None:
        """Adds one run: whole documents with all their chunks and vectors, and the ids of deleted documents (a column key).

        vectors: rows of chunk_id and embedding, or a function from the chunks as they are written to these and document_id, so that no vector moves.
        Nothing becomes current if a chunk has no vector, a vector no chunk, or a vector another dimension.
        """
        number, state = self.log.latest()
        state = state or self.fresh()
        owned = vectors if callable(vectors) else vectors.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id", "left").select("chunk_id", "embedding", "document_id")
        rows = {"documents": documents, "chunks": chunks, "vectors": (lambda written: owned(written["chunks"])) if callable(owned) else owned}
        run = self.add_run(state, rows, deleted)
        held = self.scan("vectors", self.tables["vectors"][0], [run])
        wrong = held.filter((F.coalesce(F.size("embedding"), F.lit(-1)) != int(self.meta["dimensions"])) | F.col("document_id").isNull()).count()
        if wrong or run["rows"]["chunks"] != run["rows"]["vectors"]:
            raise DataError(f"{run['rows']['chunks']} chunks, {run['rows']['vectors']} vectors, of which {wrong} have no chunk or not {self.meta['dimensions']} dimensions")
        self.publish({**state, "meta": self.meta, "high_water": high_water, "snapshot": run["run"], "runs": [*([] if replace else state["runs"]), run], "next": state["next"] + 1}, number)

    def rebuild(self, files: DataFrame, embed, chunker=None, accept: bool = True) -> DataFrame:
        """[D8] A new index of all of `files` in the place of the old one, with this store's schema, model and dimensions; returns path, status, chunk_count.

        The old rows stay current until the new ones are whole; ids go on from the old marks, so none is used
        twice. With `accept` false nothing becomes current if a file failed. vacuum() removes the old rows later.
        """
        return self._ingest(files, embed, None, False, chunker, rebuild=True, accept=accept)

    def ingest(self, files: DataFrame, embed, prune_against: DataFrame | None = None, force: bool = False, chunker=None) -> DataFrame:
        """[D2] files: path, sha256, text, error. Returns path, status, chunk_count. embed: column of text to column of vector.

        A path that is given twice counts once; with two different contents it is an error. Documents that are neither
        in `prune_against` (a column path) nor among the files go, if it is given.
        """
        self.check()
        return self._ingest(files, embed, prune_against, force, chunker)

    def _ingest(self, files: DataFrame, embed, prune_against, force: bool, chunker, rebuild: bool = False, accept: bool = True) -> DataFrame:
        from lexhaul.functions.text import embed_text
        from lexhaul.operators.chunking import chunk_documents

        now = self.current() or self.fresh()
        marks, old_docs = now["high_water"], self.live("documents", {**now, "runs": [] if rebuild else now["runs"]})
        # texts stay where they are while paths and hashes tell what is to be done; they move once, as pieces to their document's ids
        several = files.groupBy("path", "sha256").count().groupBy("path").agg(F.count(F.lit(1)).alias("contents"), F.max("count").alias("n")).filter("contents > 1 OR n > 1")
        several = self.kept(several, "several")
        if twice := several.filter("contents > 1").limit(3).collect():
            raise DataError(f"given twice with different contents: {', '.join(r['path'] for r in twice)}")
        if not several.isEmpty():
            files = files.dropDuplicates(["path", "sha256"])
        heads = self.kept(files.select("path", "sha256", "error"), "heads")
        due = heads.join(old_docs.select("path", F.col("sha256").alias("_sha")), "path", "left").select("path", (F.col("error").isNull() & (F.lit(force) | F.col("_sha").isNull() | (F.col("_sha") != F.col("sha256")))).alias("_w"))
        due = self.kept(due.filter("_w"), "due")
        todo = files.filter(F.col("error").isNull())
        if due.count() < heads.filter("error IS NULL").count():
            todo = todo.join(due.select("path"), "path", "left_semi")
        pieces = (chunker or (lambda d: chunk_documents(d, "path", "text")))(todo.select("path", "text"))
        pieces = self.kept(pieces, "pieces")
        counts = pieces.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
        listing = heads.join(counts, "path", "left").join(due, "path", "left")
        listing = listing.withColumn("n_chunks", F.when(F.col("_w"), F.coalesce("n_chunks", F.lit(0)))).drop("_w")
        result = self.kept(ingest_status(listing, old_docs, force), "result")
        columns = [c.split()[0] for c in DOCUMENTS.split(", ")]
        sized = todo.select("path", "sha256", F.length("text").cast("long").alias("char_count"))
        fresh = sized.join(counts, "path").select("path", "sha256", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"), F.lit(1).alias("page_count"), "char_count", F.lit(False).alias("ocr_used"), F.col("n_chunks").alias("chunk_count"), F.current_timestamp().alias("ingested_at"))
        placed = assign_ids(fresh, ["path"], marks["documents"], folder=f"{self.base}/work", weight="chunk_count")
        fresh = placed.select(*columns)
        replaced = old_docs.join(fresh.select("path"), "path", "left_semi").select(F.col("id").alias("key"))
        if prune_against is not None:
            replaced = replaced.union(missing(old_docs.join(fresh.select("path"), "path", "left_anti"), prune_against).select("id"))
        replaced = self.kept(replaced, "replaced")
        n_new, failed = fresh.count(), not accept and not result.filter(F.col("status") == FAILED).isEmpty()
        if not failed and (rebuild or n_new or not replaced.isEmpty()):
            # a document's chunks are numbered on from those of all documents before it
            within = F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))
            chunks = pieces.join(placed.select("path", F.col("id").alias("document_id"), "before"), "path").withColumn("id", (F.lit(marks["chunks"]) + F.col("before") + within).cast("long"))
            chunks = chunks.select(*[c.split()[0] for c in CHUNKS.split(", ")])
            vectors = lambda c: c.select(F.col("id").alias("chunk_id"), embed(embed_text(F.col("text"), F.col("heading_path"))).cast("array<float>").alias("embedding"), "document_id")
            n_chunks = fresh.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n")).first()["n"]
            high = {"documents": marks["documents"] + n_new, "chunks": marks["chunks"] + n_chunks}
            self.commit(fresh, chunks, vectors, high, None if rebuild else replaced, rebuild)
        return result

    def forget(self, paths: DataFrame) -> int:
        """[D5] Deletes the documents of `paths` (a column path) with all they hold; returns how many there were."""
        now = self.current() or self.fresh()
        gone = self.kept(self.live("documents", now).join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("key")), "gone")
        if n := gone.count():
            self.append({}, gone)
        return n

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written once beside the index, so a lost executor changes neither ids nor counts; vacuum() removes it."""
        path = f"{self.base}/work/{uuid.uuid4().hex}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self, min_age_s: float = 86_400.0) -> list[str]:
        gone = super().vacuum(min_age_s)
        fs, at = file_system(self.spark, f"{self.base}/work/*")
        for s in fs.globStatus(at) or []:
            if time.time() - s.getModificationTime() / 1000 >= min_age_s:
                gone.append(s.getPath().toString())
                fs.delete(s.getPath(), True)
        return gone

    def stats(self) -> DataFrame:
        return stats(self.read("documents"), self.read("chunks"), self.read("vectors"))
