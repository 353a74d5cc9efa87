"""[V3] Approximate search: inverted lists of product-quantised residuals, pruned by partition, re-scored exactly."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhaul.operators.runs import Pointers
from lexhaul.operators.vectors import DECIMALS, matrix

#: Values that one code of a sub-space can take.
CODES = 256
#: Distances to centres that a task holds at once (of 8 bytes); rows are taken in as many steps as that needs.
HELD = 1 << 20


def steps(rows: int, width: int) -> Iterator[slice]:
    """Slices of `rows` rows so that a slice has about HELD values of `width` each, at least one row."""
    n = max(1, HELD // max(1, width))
    return (slice(k, k + n) for k in range(0, rows, n))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, the first of equals."""
    norms = (centers**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((norms - 2 * x[s] @ centers.T).argmin(1) for s in steps(len(x), len(centers)))])


def centers_of(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's rounds from k different rows; an empty centre takes a row that is far from its own."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    c = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        far = np.argsort(-((x - c[own]) ** 2).sum(1), kind="stable")
        for j, taken in enumerate(np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)):
            c[taken], own[far[j]] = x[far[j]], taken
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total / np.maximum(np.bincount(own, minlength=len(c)), 1)[:, None]
    return c


class Quantizer:
    """List centres, and code books of the residuals' sub-spaces."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray]) -> None:
        self.coarse, self.books = coarse, books
        self.cuts = np.cumsum([b.shape[1] for b in books])[:-1]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, spaces: int, seed: int) -> Quantizer:
        coarse = centers_of(x, lists, seed)
        rest = x - coarse[nearest(x, coarse)]
        return cls(coarse, [centers_of(part, CODES, seed + 1 + k) for k, part in enumerate(np.array_split(rest, spaces, axis=1))])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, coarse=self.coarse, **{f"b{k}": b for k, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Quantizer:
        with np.load(io.BytesIO(raw)) as found:
            return cls(found["coarse"], [found[f"b{k}"] for k in range(len(found.files) - 1)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes (one byte for each sub-space) of each row."""
        own = nearest(x, self.coarse)
        parts = np.split(x - self.coarse[own], self.cuts, axis=1)
        return own, np.stack([nearest(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each query, nearest first."""
        norms = (self.coarse**2).sum(1)
        return np.concatenate([np.zeros((0, min(probes, len(norms))), np.int64), *(np.argsort(norms - 2 * x[s] @ self.coarse.T, axis=1, kind="stable")[:, :probes] for s in steps(len(x), len(norms)))])

    def distances(self, query: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to the decoded rows of a list, by one table for each sub-space."""
        out = np.zeros(len(codes))
        for k, (part, book) in enumerate(zip(np.split(query - self.coarse[of], self.cuts), self.books, strict=True)):
            out += ((part - book) ** 2).sum(1)[codes[:, k]]
        return out


def probes_for(model: Quantizer, x: np.ndarray, target: float, k: int = 10, most: int = 200) -> int:
    """How many lists to probe so that `target` of the k nearest in `x` lie in them, by up to `most` of its rows as queries."""
    own, asked = nearest(x, model.coarse), x[:: max(1, len(x) // most)]
    order = model.probe(asked, len(model.coarse)).argsort(axis=1)  # the place of each list in a query's order
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    places = np.sort(np.take_along_axis(order, own[near], 1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1 if len(places) else 1


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a direction."""
    n = np.linalg.norm(x, axis=1)
    good = np.isfinite(n) & (n > 0)
    return np.where(good[:, None], x / np.where(good, n, 1)[:, None], 0), good


def asking(model: Quantizer, batch: pa.RecordBatch, probes: int, query_id: str) -> Iterator[pa.RecordBatch]:
    """Queries (id, vector), each once for each list that it probes, in batches of about HELD components however many lists there are."""
    dim = model.coarse.shape[1]
    x, good = unit(matrix(batch.column(1), dim))
    for s in steps(len(x), probes * dim):
        near = model.probe(x[s], probes)[good[s]]
        at = pa.array(np.repeat(np.flatnonzero(good[s]) + s.start, near.shape[1]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(near.ravel().astype(np.int32)), batch.column(1).take(at)], [query_id, "list", "query"])


class IvfIndex:
    """An index below `path`; build() makes a new version beside the old one and then points to it.

    Every row is in one list, so what search() may miss are only rows whose list is not probed or whose decoded distance is
    among the far ones; distances that it returns are exact. Lists are folders, so a search reads the
    files of the probed ones only. A list of more than `rows_per_part` rows has several parts, and queries that
    probe one list are dealt to blocks, so no task depends on the size of a list.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.log = spark, path.rstrip("/"), Pointers(spark, path)

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, spaces: int = 16, sample: int = 20_000, seed: int = 7, rows_per_part: int = 65_536, recall: float = 0.97) -> None:
        """Fits on at most `sample` rows, chosen by a hash of the id, and writes every row that has a direction; vectors of another length than the most frequent one are left out.

        How many lists a search probes by default is measured too: as many as hold `recall` of the neighbours inside the sample.
        """
        number, _ = self.log.latest()
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).filter("vector IS NOT NULL")
        shape = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
        if shape is None:
            self.log.publish({"folder": None}, number)
            return
        dim, count = shape["dim"], shape["n"]
        taken = rows.filter(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
        x, good = unit(matrix(taken["vector"].combine_chunks(), dim))
        lists = min(lists or max(1, int(count**0.5)), 4096, int(good.sum()) or 1)
        model = Quantizer.fit(x[good] if good.any() else x[:1], lists, min(spaces, dim), seed)
        probes = probes_for(model, x[good], recall)
        raw, folder = model.dump(), f"{self.path}/version-{uuid.uuid4().hex}"

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Quantizer.load(raw)
            for b in batches:
                x, good = unit(matrix(b.column(1), dim))
                own, codes = held.encode(x)
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], ["list", "id", "code", "vector"]).filter(keep)

        rows.mapInArrow(encode, "list int, id long, code binary, vector array<float>").write.parquet(f"{folder}/encoded")
        encoded = self.spark.read.parquet(f"{folder}/encoded")
        sizes = {r["list"]: r["n"] for r in encoded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 4096 rows
        parts = {k: -(-n // rows_per_part) for k, n in sizes.items()}
        many = F.element_at(F.create_map(*[F.lit(v) for kv in parts.items() for v in kv]), F.col("list")) if parts else F.lit(1)
        dealt = encoded.withColumn("part", F.pmod(F.xxhash64("id", "vector"), many).cast("int"))
        dealt.repartition("list", "part").sortWithinPartitions("list", "part", "id").write.partitionBy("list", "part").parquet(f"{folder}/lists")
        self.spark.createDataFrame([(bytearray(raw),)], "model binary").write.parquet(f"{folder}/model")
        self.log.publish({"folder": folder, "dim": dim, "parts": [[k, p] for k, p in sorted(parts.items())], "probes": probes, "rows": sum(sizes.values())}, number)

    def rows(self, state: dict, wanted: list[int], columns: str) -> DataFrame:
        """Columns of the probed lists only; the filter is on partition folders."""
        found = self.spark.read.schema(f"{columns}, list int, part int").parquet(f"{state['folder']}/lists")
        return found.filter(F.col("list").isin(wanted))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rescore: int = 20, query_id: str = "query_id", query_col: str = "query", queries_per_block: int = 4096) -> DataFrame:
        """query_id, id, distance, rank of the k nearest rows found for each query, by exact cosine distance, ties by id.

        The `rescore` * k rows of each query that are nearest by their codes are compared exactly. Queries without a direction
        or of another length find nothing; ids of queries have to be unique.
        """
        kind = queries.schema[query_id].dataType.simpleString()
        state = self.log.current()
        empty = self.spark.createDataFrame([], f"{query_id} {kind}, id long, distance double, rank int")
        if not state or not state["folder"]:
            return empty
        raw = bytes(self.spark.read.parquet(f"{state['folder']}/model").first()["model"])
        dim, most, probes = state["dim"], rescore * k, probes or state["probes"]

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Quantizer.load(raw)
            for b in batches:
                yield from asking(held, b, probes, query_id)

        asked = queries.select(query_id, F.col(query_col).cast("array<double>").alias("query")).filter(F.size("query") == dim)
        chosen = asked.mapInArrow(choose, f"{query_id} {kind}, list int, query array<double>")
        load = {r["list"]: -(-r["n"] // queries_per_block) for r in chosen.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row for each list
        parts = {a: b for a, b in state["parts"] if a in load}
        if not parts:
            return empty
        plan = self.spark.createDataFrame([(a, p, load[a]) for a, p in parts.items()], "list int, parts int, blocks int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows(state, sorted(parts), "id long, code binary").join(F.broadcast(plan), "list").withColumn("block", every("blocks")).select("list", "part", "block", "id", "code")
        right = chosen.join(F.broadcast(plan), "list").withColumn("block", F.pmod(F.xxhash64(query_id), F.col("blocks")).cast("int")).withColumn("part", every("parts")).select("list", "part", "block", query_id, "query")

        def meet(key: tuple, rows: pa.Table, asking: pa.Table) -> pa.Table:
            of, part, held = key[0].as_py(), key[1].as_py(), Quantizer.load(raw)
            ids = rows["id"].to_numpy()
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            x, _ = unit(matrix(asking["query"].combine_chunks(), dim))
            who, found, near = [], [], []
            for n, q in enumerate(x if len(ids) else x[:0]):
                d = held.distances(q, of, codes)
                best = np.argpartition(d, most - 1)[:most] if len(d) > most else np.arange(len(d))
                who.append(np.full(len(best), n))
                found.append(ids[best])
                near.append(d[best])
            at = np.concatenate([np.zeros(0, int), *who])
            return pa.table([asking[query_id].take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(np.concatenate([np.zeros(0), *near])), pa.array(np.full(len(at), of, np.int32)), pa.array(np.full(len(at), part, np.int32))], [query_id, "id", "near", "list", "part"])

        keys = ["list", "part", "block"]
        close = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"{query_id} {kind}, id long, near double, list int, part int")
        own = Window.partitionBy(query_id)
        close = close.withColumn("_r", F.row_number().over(own.orderBy("near", "id"))).filter(F.col("_r") <= most).drop("_r", "near")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        exact = close.join(self.rows(state, sorted(parts), "id long, vector array<float>").withColumn("vector", F.col("vector").cast("array<double>")), ["list", "part", "id"]).join(asked, query_id)
        distance = F.round(1 - dot("vector", "query") / F.sqrt(dot("vector", "vector") * dot("query", "query")), DECIMALS)
        ranked = exact.select(query_id, "id", distance.alias("distance")).withColumn("rank", F.row_number().over(own.orderBy("distance", "id")))
        return ranked.filter(F.col("rank") <= k)
