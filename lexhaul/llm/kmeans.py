"""Centroid clustering of integer vectors: Lloyd's rounds with Elkan's bounds and exact final distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhaul.llm.common import Scratch
from lexhaul.llm.topk import narrow, scaled

#: With components up to 2^27 and up to 256 of them, squared distances stay below 2^63.
BITS, DIMENSIONS = 27, 256


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def above(x: np.ndarray) -> np.ndarray:
    """No smaller than the exact value whose correctly rounded operation gave x."""
    return np.nextafter(x, np.inf)


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def roots(sq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from both sides of the square roots of whole numbers; a step each for the conversion and the root."""
    r = np.sqrt(sq.astype(float))
    return np.maximum(below(below(r)), 0), above(above(r))


def apart(centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of half the distance of each two centroids; infinite from one to itself."""
    half = np.array([below(roots(squares(centroids, c))[0] / 2) for c in centroids])
    np.fill_diagonal(half, np.inf)
    return half


def assign(x: np.ndarray, centroids: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Elkan's step: moves `own` to the nearest centroid, ties to the smaller number, and tightens `upper` and `lower` in place.

    upper bounds each row's distance to its own centroid from above, lower those to all centroids from below. A
    centroid is skipped only where it is strictly further away, so that ties are always compared, as whole
    numbers. Returns how many distances were computed.
    """
    half = apart(centroids)
    rows = np.flatnonzero(upper >= half.min(axis=1)[own])
    if not len(rows):
        return 0
    a, some = own[rows], x[rows]
    best = np.einsum("ij,ij->i", d := some - centroids[a], d)
    low, u = roots(best)
    bounds = lower[rows]
    bounds[np.arange(len(rows)), a] = low
    computed = len(rows)
    for c in range(len(centroids)):
        near = np.flatnonzero((a != c) & (u >= bounds[:, c]) & (u >= half[a, c]))
        if not len(near):
            continue
        computed += len(near)
        found = squares(some[near], centroids[c])
        bounds[near, c], high = roots(found)
        closer = (found < best[near]) | ((found == best[near]) & (c < a[near]))
        moved = near[closer]
        a[moved], best[moved], u[moved] = c, found[closer], high[closer]
    own[rows], upper[rows], lower[rows] = a, u, bounds
    return computed


def follow(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Widens the bounds by what the centroids have moved, rounded to the safe side."""
    moved = np.array([roots(squares(a[None], b))[1][0] for a, b in zip(before, after, strict=True)])
    moved[(before == after).all(axis=1)] = 0
    upper[:] = np.where(moved[own] > 0, above(upper + moved[own]), upper)
    lower[:] = np.maximum(np.where(moved > 0, below(lower - moved), lower), 0)


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k rows with the smallest hash of seed and id; rows without an id come last, equal ids in the order of their components."""
    rows = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256).asc_nulls_last(), "_v").limit(k).select("_v").collect()
    return np.array([r["_v"] for r in rows], np.int64)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector, after `rounds` rounds and a last assignment.

    Kept are vectors of `dimensions` components, none null, NaN or infinite, as whole numbers floor(scale * x). Each
    round is one pass over a table in the shared folder that holds vectors with their cluster and bounds: tasks
    widen the bounds by the moves of the centroids, skip what the bounds rule out, and write the rows again beside
    their sums by cluster, so what is added up afterwards is k rows for each task. Only k centroids are on the
    driver. New centroids are exact floor(sum / count); one without rows stays. If none moves, further rounds
    would change nothing and are left out.

    Rows that repeat an id or a vector count each on their own; a null id stays null. With fewer kept rows than
    k there are as many centroids as rows; an empty table gives an empty result. Only the two named columns are
    read, so other names cannot clash. A component beyond 2^27 after scaling, whose distances a long may not hold, is an error.
    """
    if dimensions > DIMENSIONS:
        raise ValueError(f"at most {DIMENSIONS} dimensions: squared distances have to fit a long")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = F.when(F.size(vectors[vector_col]) == dimensions, vectors[vector_col])
    kept = vectors.select(vectors[id_col].cast("long").alias("_id"), scaled(whole, scale, BITS).alias("_v")).filter("_v IS NOT NULL")
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    kind = "int" if narrow(1 << BITS) == "int" else "bigint"
    schema = f"_id long, _v array<{kind}>, cluster int, upper double, lower array<double>, distance long, n long, total array<bigint>"

    def one_pass(before: np.ndarray | None, now: np.ndarray, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count, inertia = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64), [0] * len(now)
            names = [f.split()[0] for f in schema.split(", ")]
            for b in batches:
                n = b.num_rows
                x = b.column(1).flatten().to_numpy().reshape(n, dimensions).astype(np.int64)
                if before is None:
                    own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, len(now)))
                else:
                    own, upper = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().copy()
                    lower = b.column(4).flatten().to_numpy().reshape(n, len(now)).copy()
                    follow(upper, lower, own, before, now)
                assign(x, now, own, upper, lower)
                distance = np.einsum("ij,ij->i", d := x - now[own], d) if last else None
                for c in np.unique(own).tolist():
                    members = own == c
                    total[c] += x[members].sum(axis=0)
                    count[c] += members.sum()
                    if last:
                        inertia[c] += sum(distance[members].tolist())
                no_sums = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
                if last:
                    kept_on = [pa.nulls(n, b.column(1).type), pa.array(own.astype(np.int32)), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), pa.array(distance)]
                else:
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(now))
                    kept_on = [b.column(1), pa.array(own.astype(np.int32)), pa.array(upper), pa.ListArray.from_arrays(offsets, pa.array(lower.ravel())), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0), *kept_on, *no_sums], names)
            own = np.flatnonzero(count)
            if len(own):
                none = lambda t: pa.nulls(len(own), t)
                yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.list_(pa.int32() if kind == "int" else pa.int64())), pa.array(own.astype(np.int32)), none(pa.float64()), none(pa.list_(pa.float64())), pa.array([inertia[c] for c in own], pa.int64()), pa.array(count[own]), pa.array([total[c].tolist() for c in own], pa.list_(pa.int64()))], names)

        return run

    def sums(state: DataFrame) -> dict[int, tuple]:
        """count, component sums and summed distances of each cluster that has rows, as Python's whole numbers."""
        big = lambda c: F.sum(c.cast("decimal(38,0)"))
        rows = state.filter("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), big(F.col("distance")).alias("inertia"), *[big(F.get("total", i)).alias(f"s{i}") for i in range(dimensions)]).collect()
        return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dimensions)], int(r["inertia"] or 0)) for r in rows}

    state, before = kept.select("_id", F.col("_v").cast(f"array<{kind}>").alias("_v")), None
    for number in range(rounds + 1):
        last = number == rounds or (before is not None and (before == centroids).all())
        read = state if before is None else state.filter("n IS NULL").select("_id", "_v", "cluster", "upper", "lower")
        done = scratch.write(read.mapInArrow(one_pass(before, centroids, last), schema), f"pass{number}")
        if before is not None:
            scratch.drop(state)
        state, found = done, sums(done)
        if last:
            break
        before, centroids = centroids, np.array([[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids.tolist())], np.int64)
    inertia = sum(x[2] for x in found.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    own = [found[c][2] if c in found else 0 for c in range(len(centroids))]
    return state.filter("n IS NULL").select(F.col("_id").alias("vec_id"), "cluster", "distance", of(own).cast("long").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), of(hashes).alias("centroid_sha256"))
