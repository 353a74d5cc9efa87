"""Exact top-k search and centroid clustering against brute force in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from lexhaul.llm import kmeans, topk

SHAPE = "vec_id long, embedding array<float>, label int, _id string, _v int, _n int, _asked string, _s int, _b int, cluster int, n int"


@pytest.fixture(scope="module")
def made(spark):
    """Rows of (id, vector) with extra columns whose names clash with those used inside."""
    return lambda rows: spark.createDataFrame([(i, v, 1, "x", 2, 3, "y", 4, 5, 6, 7) for i, v in rows], SHAPE).repartition(3)


def odd_rows(dim, n=160, seed=4):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one vector is a good part of all rows
    rows += [(20, rows[5][1]), (7, rows[7][1]), (7, rows[7][1])]  # repeated ids and rows
    rows += [(2000, None), (2001, []), (2020, []), (2002, [None] * dim), (2003, [float("nan")] * dim), (2004, [float("inf")] + [0.0] * (dim - 1)), (2040, [0.5] * (dim - 1)), (2041, [0.25] * (dim - 1)), (None, rows[9][1]), (None, rows[40][1])]
    return rows


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def naive_top(rows, k, scale=64, every=20):
    kept = [(i, w) for i, v in rows if (w := whole(v, scale)) is not None]
    out = {}
    for q, a in kept:
        if q is not None and q % every == 0:
            out.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), c is None, c) for c, b in kept if c != q and len(a) == len(b))
    return sorted((q, n + 1, c, -s) for q, found in out.items() for n, (s, _, c) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))


def got_top(df, **how):
    return sorted((tuple(r) for r in topk.top_products(df, df["vec_id"] % 20 == 0, **how).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("how", [{}, {"rows_per_shard": 30, "queries_per_block": 3, "fan_in": 2}])
def test_top_products_equal_brute_force(made, how):
    rows = odd_rows(6)
    assert got_top(made(rows), k=5, **how) == naive_top(rows, 5)


def test_top_products_small_and_large(made):
    assert got_top(made([]), k=3) == []
    assert got_top(made([(1, [1.0]), (2, [2.0])]), k=3) == []  # no query
    assert got_top(made([(20, [1.0])]), k=3) == []  # no candidate
    assert got_top(made([(20, [1.0, 2.0]), (3, [-1.0, 0.0])]), k=3) == [(20, 1, 3, -64 * 64)]
    rows = [(20 * i, [float(3 ** (i % 7)) * 1e4, -float(i) * 1e5]) for i in range(40)]  # beyond what a float holds exactly
    assert got_top(made(rows), k=4) == naive_top(rows, 4)
    with pytest.raises(Exception, match="beyond"):
        got_top(made([(20, [1e30]), (21, [1.0])]), k=1)
    with pytest.raises(Exception):  # noqa: B017  the score does not fit a long
        got_top(made([(20, [1e15]), (21, [1e15])]), k=1)


def test_tiles_keep_all_that_can_be_best():
    r = np.random.default_rng(2)
    for n in (1, 7, 400):
        s = r.integers(-3, 3, (50, n)).astype(np.float32)
        q, c = topk.best_of_tile(s.copy(), 3, np.full(50, -np.inf, object), [(0, 0, 1)])
        for row in range(50):
            own = sorted((-s[row, k], k) for k in range(n) if (row, k) != (0, 0))[:3]
            assert {k for _, k in own} <= set(c[q == row].tolist())


def test_products_are_exact_in_every_type():
    r = np.random.default_rng(3)
    for most in (60, 1 << 16, 1 << 24, 1 << 40):
        a, b = r.integers(-most, most, (5, 9)), r.integers(-most, most, (6, 9))
        assert topk.product(a, b).astype(object).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def naive_clusters(rows, k, rounds, dim, scale=1024, seed="3"):
    kept = [(i, w) for i, v in rows if v is not None and len(v) == dim and (w := whole(v, scale)) is not None]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [w for _, w in sorted(kept, key=key)[:k]]
    near = lambda w: min((sum((x - y) ** 2 for x, y in zip(w, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(w)[1] for _, w in kept]
        cents = [[sum(col) // len(m) for col in zip(*m, strict=True)] if (m := [w for (_, w), a in zip(kept, own, strict=True) if a == c]) else old for c, old in enumerate(cents)]
    found = [(i, *near(w)) for i, w in kept]
    per = {}
    for _, d, c in found:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, d, c in found), key=str)


def got_clusters(df, **how):
    return sorted((tuple(r) for r in kmeans.clusters(df, **how).collect()), key=str)


@pytest.mark.parametrize(("k", "rounds", "scale"), [(8, 10, 1024), (8, 10, 2), (3, 0, 1024), (1, 4, 1024), (8, 40, 3)])
def test_clusters_equal_brute_force(made, k, rounds, scale):
    """A small scale makes many ties and empty clusters."""
    rows = odd_rows(5)
    assert got_clusters(made(rows), k=k, rounds=rounds, dimensions=5, scale=scale) == naive_clusters(rows, k, rounds, 5, scale)


def test_clusters_of_few_rows(made):
    assert got_clusters(made([]), dimensions=2) == [] == got_clusters(made([(1, None), (2, [1.0])]), dimensions=2)
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0])]
    assert got_clusters(made(rows), dimensions=2) == naive_clusters(rows, 8, 10, 2)
    with pytest.raises(Exception, match="beyond"):
        got_clusters(made([(1, [1e9, 0.0])]), dimensions=2)


def test_bounds_skip_work_and_stay_bounds():
    r = np.random.default_rng(7)
    x = np.concatenate([r.integers(-40, 40, (400, 4)) + 300 * np.array(c) for c in ([0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0])]).astype(np.int64)
    cents = x[[0, 401, 802, 5]]
    own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), 4))
    full = kmeans.assign(x, cents, own, upper, lower)
    again = 0
    for _ in range(4):
        moved = np.array([x[own == c].sum(0) // max(1, (own == c).sum()) for c in range(4)])
        kmeans.follow(upper, lower, own, cents, moved)
        cents = moved
        again = kmeans.assign(x, cents, own, upper, lower)
        exact = np.array([[sum(int(a) ** 2 for a in v - c) for c in cents] for v in x])
        assert (own == exact.argmin(axis=1)).all()
        assert (upper**2 >= exact[np.arange(len(x)), own] * (1 - 1e-12)).all() and (lower**2 <= exact * (1 + 1e-12)).all()
    assert again < full / 2
