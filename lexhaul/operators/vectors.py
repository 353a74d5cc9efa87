"""Exact vector search over one table of (id, vector) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BACKENDS = ("parquet", "sqlite-vec", "lancedb", "chroma", "qdrant")
#: Decimals that distances are compared with, so that equal vectors tie however they were summed.
DECIMALS = 9


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; rows of another length or with nulls become zero vectors."""
    out = np.zeros((len(column), dim))
    flat, size = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if (size == dim).all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            out[i] = v
    return out


class Nearest:
    """The k nearest of the rows seen so far for each query of a block, ties by id."""

    def __init__(self, ids: list, queries: np.ndarray, k: int, id_type: pa.DataType) -> None:
        norm = np.linalg.norm(queries, axis=1)
        self.ids, self.dim, self.k = [i for i, n in zip(ids, norm, strict=True) if n > 0], queries.shape[1], k
        self.q = (queries[norm > 0] / norm[norm > 0, None]).T
        self.held = pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], id_type)], ["q", "d", "id"])

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        x = matrix(vectors, self.dim)
        n = np.linalg.norm(x, axis=1)
        if not self.ids or not (n > 0).any():
            return
        d = np.round(1 - (x[n > 0] / n[n > 0, None]) @ self.q, DECIMALS)
        near = d <= np.partition(d, self.k - 1, axis=0)[self.k - 1] if len(d) > self.k else np.ones(d.shape, bool)
        row, col = np.nonzero(near)
        new = pa.table([pa.array(col), pa.array(d[row, col]), ids.take(pa.array(np.flatnonzero(n > 0)[row]))], ["q", "d", "id"])
        self.held = pa.concat_tables([self.held, new])
        if self.held.num_rows > 4 * self.k * len(self.ids):
            self.cut()

    def cut(self) -> None:
        rows = self.held.sort_by([("q", "ascending"), ("d", "ascending"), ("id", "ascending")])
        q = rows["q"].to_numpy()
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(q) else q
        self.held = rows.filter(pa.array(place < self.k))

    def rows(self, arrow: pa.Schema) -> pa.Table:
        self.cut()
        return pa.table([pa.array([self.ids[k] for k in self.held["q"].to_pylist()], arrow.field(0).type), self.held["id"].cast(arrow.field(1).type), self.held["d"]], arrow.names)


def stacked(vectors: list, dim: int | None = None) -> np.ndarray:
    if len({len(v) for v in vectors} | ({dim} if dim else set())) > 1:
        raise ValueError("queries differ in dimension")
    return np.array(vectors, float)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_col: str = "query", block: int = 2000, rows_per_block: int = 200_000) -> DataFrame:
    """[V2, V8, J7] query_id, id, distance, rank of the k nearest rows of each query by cosine distance, ties by id.

    Up to `block` queries, counted, go to all tasks. Else the rows are dealt once, to parts of about `rows_per_block`,
    and only the queries are copied, to each part, where they pass by the part's rows in blocks; so neither the driver nor a
    task holds more than one part and one block. In both ways a task multiplies rows and queries as matrices and keeps
    the best k for each query, so what is shuffled on is at most k rows for each query and task; a window ranks
    those. Zero vectors, nulls and wrong lengths have no distance.
    """
    spark = vectors.sparkSession
    id_type, q_type = vectors.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    shape = f"{query_id} {q_type}, {id_col} {id_type}, distance double"
    arrow = to_arrow_schema(StructType.fromDDL(shape))
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_col).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull())
    rows, n = vectors.select(F.col(id_col).alias("_q"), F.col(vector_col).alias("_v")), asked.count()
    if n == 0:
        out = spark.createDataFrame([], shape)
    elif n <= block:
        found = asked.collect()
        held = spark.sparkContext.broadcast(([r["_q"] for r in found], stacked([r["_v"] for r in found])))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(*held.value, k, arrow.field(1).type)
            for b in batches:
                best.add(b.column(0), b.column(1))
            yield from best.rows(arrow).to_batches()

        out = rows.mapInArrow(nearest, shape)
    else:
        dims = asked.agg(F.min(F.size("_v")).alias("a"), F.max(F.size("_v")).alias("b")).first()
        if dims["a"] != dims["b"]:
            raise ValueError("queries differ in dimension")
        parts = max(1, -(-vectors.count() // rows_per_block))
        sides = rows.select("_q", F.lit(None).cast(q_type).alias("_a"), F.col("_v").cast("array<double>").alias("_v"), F.lit(0).alias("_side"), F.pmod(F.xxhash64("_q", "_v"), F.lit(parts)).cast("int").alias("_p"))
        asking = asked.select(F.lit(None).cast(id_type).alias("_q"), F.col("_q").alias("_a"), "_v", F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                side = b.column(3).to_numpy()
                first = int(np.searchsorted(side, 1))  # rows come before queries
                if first:
                    held.append(b.slice(0, first))
                for at in range(first, b.num_rows, block):
                    some = b.slice(at, block)
                    best = Nearest(some.column(1).to_pylist(), stacked(some.column(2).to_pylist()), k, arrow.field(1).type)
                    for r in held:
                        best.add(r.column(0), r.column(2))
                    yield from best.rows(arrow).to_batches()

        dealt = sides.unionByName(asking).repartitionById(parts, F.col("_p")).sortWithinPartitions("_side")
        out = dealt.select("_q", "_a", "_v", "_side").mapInArrow(meet, shape)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_col))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """[V2] One query: id, distance, rank."""
    one = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, query array<double>")
    return knn_batch(vectors, one, k, id_col, vector_col).drop("query_id")


def search(vectors: DataFrame, texts: DataFrame, queries: DataFrame, k: int, id_col: str, text_id: str, **how) -> DataFrame:
    """[V4, V5, J1, J2] k nearest first, text joined for those rows only; ids without text drop out."""
    hits = knn_batch(vectors, queries, k, id_col, **how)
    return hits.join(texts, hits[id_col] == texts[text_id])


def reconcile(vectors: DataFrame, texts: DataFrame, id_col: str, text_id: str) -> DataFrame:
    """[J9] ids on one side only, and which side."""
    a, b = vectors.select(F.col(id_col).alias("id")), texts.select(F.col(text_id).alias("id"))
    return a.join(b, "id", "left_anti").select("id", F.lit("vector_without_text").alias("problem")).unionByName(b.join(a, "id", "left_anti").select("id", F.lit("text_without_vector").alias("problem")))


class VectorTable:
    """[V1, V3, V6, V7] The backend contract over one log-structured table; backend names are kept as metadata only.

    add() replaces vectors whose id is there already. Readers keep what they have begun with; see RunStore.
    """

    def __init__(self, spark, path: str, dim: int, backend: str = "parquet") -> None:
        from lexhaul.operators.runs import RunStore

        if backend not in BACKENDS:
            raise ValueError(f"unknown vector backend {backend!r}; known: {', '.join(BACKENDS)}")
        self.spark, self.path, self.dim, self.backend = spark, path, dim, backend
        self.store = RunStore(spark, path, {"vectors": ("chunk_id long, embedding array<float>", "chunk_id")})

    def read(self) -> DataFrame:
        return self.store.read("vectors")

    def add(self, rows: DataFrame) -> None:
        """Ids that come twice in `rows` are an error, as are other dimensions."""
        rows = rows.select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<float>"))
        bad = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim).alias("wrong")).filter("n > 1 OR wrong").first()
        if bad:
            raise ValueError(f"vectors must have {self.dim} dimensions" if bad["wrong"] else f"vector {bad['chunk_id']} comes twice")
        self.store.append({"vectors": rows}, rows.select(F.col("chunk_id").alias("key")))

    def delete(self, ids: DataFrame) -> None:
        self.store.append({}, ids.select(F.col("chunk_id").alias("key")))

    def drop(self) -> None:
        self.store.append({}, replace=True)

    def compact(self) -> int:
        return self.store.compact()

    def count(self) -> int:
        return self.read().count()

    def search(self, query: list[float], k: int) -> DataFrame:
        if len(query) != self.dim:
            raise ValueError(f"query has {len(query)} dimensions, the table {self.dim}")
        return knn(self.read(), query, k, "chunk_id", "embedding")
