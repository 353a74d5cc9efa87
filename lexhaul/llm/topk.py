"""Exact top-k inner products of many queries with many rows: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch

#: Rows and queries of one matrix product.
WIDE, HIGH = 8192, 1024


def scaled(vector: Column, scale: int, bits: int = 62) -> Column:
    """floor(scale * x) of each component as a long, x as double; null for a null vector or one with a null, NaN or infinite component.

    A component beyond 2^`bits` is an error.
    """
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    big = F.raise_error(F.lit(f"a component is beyond 2^{bits} after scaling")).cast("double")
    part = lambda x: F.when(F.abs(x) <= float(1 << bits), x).otherwise(big)
    return F.when(ok, F.transform(vector, lambda x: F.floor(part(x.cast("double") * scale))))


def narrow(largest: int) -> str:
    """The smallest whole-number type for components of this size: tiles travel in it."""
    return "smallint" if largest < 1 << 15 else "int" if largest < 1 << 31 else "bigint"


def product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products. By Cauchy and Schwarz no sum on the way is larger than the product of the norms, so the narrowest type that holds it exactly is used."""
    norm = [float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0))) for x in (queries, rows)]
    bound = norm[0] * norm[1] * 1.001
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 39 else object
    return queries.astype(kind) @ rows.astype(kind).T


def best_of_tile(scores: np.ndarray, k: int, least: np.ndarray, barred: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) that can be among the k best: the k first by score, then by row, as far as they are above `least` of their query.

    `barred`: query, first and last row that are the query's own.
    """
    if scores.dtype == object:
        for q, a, b in barred:
            scores[q, a:b] = None
        found = [(q, r) for q, own in enumerate(scores) for r in sorted((r for r, s in enumerate(own) if s is not None and s > least[q]), key=lambda r, own=own: (-own[r], r))[:k]]
        return np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
    for q, a, b in barred:
        scores[q, a:b] = -np.inf
    above = scores > least.astype(float)[:, None]
    if above.sum() > 4 * k * len(scores):  # many: a partial selection by score and row, all keys different and exact
        n = scores.shape[1]
        key = scores.astype(np.float64) * WIDE - np.arange(n)
        place = np.argpartition(-key, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), scores.shape)
        keep = np.take_along_axis(above, place, 1)
        return np.nonzero(keep)[0], place[keep]
    return np.nonzero(above)


class Lists:
    """The k best (score, id) of each query so far; higher scores first, then smaller ids, null ids last."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.q, self.score, self.id, self.null = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.full(n, -np.inf, object)  # the k-th score, once there are k

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        q, score, ids, null = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.q, self.score, self.id, self.null = q[place < self.k], score[order], ids[order], null[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.q[full]] = self.score[full]


class Shard:
    """The rows of a shard by dimension, in order of their ids."""

    def __init__(self, ids: list, vectors: list) -> None:
        self.by_dim: dict[int, tuple] = {}
        size = np.array([len(v) for v in vectors], int)
        keys = np.array([0 if i is None else i for i in ids], np.int64)
        null = np.array([i is None for i in ids], bool)
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            own = own[np.lexsort((keys[own], null[own]))]
            self.by_dim[dim] = keys[own], null[own], np.array([vectors[i] for i in own]).reshape(len(own), dim)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Lists:
        """Queries of one dimension against all rows of it, tile by tile."""
        best = Lists(len(ids), k)
        keys, null, rows = self.by_dim.get(queries.shape[1], (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, queries.shape[1]), np.int64)))
        known = int((~null).sum())
        for at in range(0, len(keys), WIDE):
            tile = slice(at, at + WIDE)
            own = keys[at : min(known, at + WIDE)]
            a, b = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
            scores = product(queries, rows[tile])
            q, r = best_of_tile(scores, k, best.least, [(int(i), int(a[i]), int(b[i])) for i in np.flatnonzero(a < b)])
            if len(q):
                best.add(q, scores[q, r].astype(np.int64), keys[tile][r], null[tile][r])
        return best


def top_products(vectors: DataFrame, asked: Column, k: int, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_shard: int = 262_144, queries_per_block: int = 65_536, fan_in: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `asked` (a condition on `vectors`) names, its k highest integer inner products.

    Components are floor(scale * x); scores are exact, ties go to the smaller id. The row itself, that is every row
    with its id, is no candidate. Rows and queries are dealt to shards and blocks, and each pair of them is
    one task: it multiplies tiles of WIDE rows and HIGH queries, keeps what can be among the k best, and hands on k
    rows for each query. Lists are then merged `fan_in` at a time, up a tree, so no task sees more than
    fan_in * k rows of a query. A row is copied once for each block, a query once for each shard, in the narrowest
    whole-number type; nothing is broadcast or collected.

    Vectors that are null or hold a null, NaN or infinite component take no part; neither as query does a row without
    an id, as a candidate it comes after its ties. Vectors of different lengths have no product; two empty ones have 0.
    Rows that repeat an id as queries share one list, as candidates each takes a place. An empty table gives an
    empty result; fewer than k candidates give fewer rows. Only the two named columns and those of `asked` are read. A
    score beyond a long is an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kept = vectors.select(vectors[id_col].cast("long").alias("_id"), F.coalesce(asked, F.lit(False)).alias("_asked"), scaled(vectors[vector_col], scale).alias("_v")).filter("_v IS NOT NULL")
    kept = scratch.write(kept.withColumn("_n", F.monotonically_increasing_id()), "scaled")
    is_query = F.col("_asked") & F.col("_id").isNotNull()
    size = kept.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_query).alias("queries"), F.max(F.array_max(F.transform("_v", F.abs))).alias("most")).first()
    shape = "query_id long, shard int, vec_id long, score long"
    if not size["queries"]:
        scratch.drop(kept)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    busy = 2 * spark.sparkContext.defaultParallelism  # small tables are still dealt to all cores
    shards = max(-(-size["rows"] // rows_per_shard), min(busy, -(-size["rows"] // 1024)))
    blocks = -(-size["queries"] // queries_per_block)
    vector = F.col("_v").cast(f"array<{narrow(size['most'] or 0)}>").alias("_v")
    spread = lambda n: F.pmod(F.xxhash64("_n"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = kept.select("_id", vector, F.lit(0).alias("_side"), spread(shards).alias("_s"), every(blocks).alias("_b"))
    queries = kept.filter(is_query).select("_id", vector, F.lit(1).alias("_side"), every(shards).alias("_s"), spread(blocks).alias("_b"))
    dealt = rows.unionByName(queries).withColumn("_p", F.col("_b") * shards + F.col("_s")).repartitionById(blocks * shards, F.col("_p")).sortWithinPartitions("_side")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list = []
        shard = None
        for batch in batches:
            side = batch.column(2).to_numpy()
            first = int(np.searchsorted(side, 1))  # rows come before queries
            if first:
                ids += batch.column(0).slice(0, first).to_pylist()
                held += np.split(batch.column(1).slice(0, first).flatten().to_numpy(), batch.column(1).slice(0, first).value_lengths().to_numpy().cumsum()[:-1])
            if first == len(side):
                continue
            if shard is None:
                shard, number, ids, held = Shard(ids, held), batch.column(3)[0].as_py(), [], []
            asked_ids, v = batch.column(0).slice(first).to_numpy(), batch.column(1).slice(first)
            lengths, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
            starts = np.r_[0, lengths.cumsum()[:-1]]
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                for at in range(0, len(own), HIGH):
                    some = own[at : at + HIGH]
                    best = shard.search(asked_ids[some], flat[starts[some][:, None] + np.arange(dim)].astype(np.int64).reshape(len(some), dim), k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[some][best.q]), pa.array(np.full(len(best.q), number, np.int32)), pa.array(best.id, mask=best.null), pa.array(best.score)], ["query_id", "shard", "vec_id", "score"])

    lists = scratch.write(dealt.select("_id", "_v", "_side", "_s").mapInArrow(tiles, shape), "lists")
    scratch.drop(kept)
    while True:
        own = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        shards = -(-shards // fan_in)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int")).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
