import hashlib
import math

import numpy as np
import pytest

from orrery.llm import centroids


def plain(rows, k=16, rounds=3, dims=64):
    """The clusters, by every distance, in Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    now = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        now = [[sum(x) // len(x) for x in zip(*g, strict=True)] if (g := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else now[j] for j in range(len(now))]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found), key=str)


SCHEMA = "vec_id long, embedding array<float>"


def drawn(n, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (5, 64))
    return [(i, (middles[i % 5] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [drawn(300), drawn(7), [(1, [0.5] * 64)] * 5 + [(2, [0.5] * 64), (3, [-0.5] * 64)]])
def test_against_every_distance(spark, rows):
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "'x' as q"))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_odd_vectors(spark):
    odd = [(None, [0.25] * 64), (1, None), (2, []), (3, [0.1] * 63), (4, [None] + [0.1] * 63), (5, [float("nan")] + [0.1] * 63), (6, [float("inf")] + [0.1] * 63), (6, [0.1] * 64)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(odd, SCHEMA)).collect()), key=str) == plain(odd)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_component_too_large(spark):
    with pytest.raises(Exception, match="is beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA)).collect()


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(1)
    q = rng.integers(-40, 40, (2000, 64)) + rng.integers(-300, 300, (4, 64))[rng.integers(0, 4, 2000)]
    screen = centroids.Screen(q[:16].copy())
    exact = ((q[:, None] - q[None, :16]) ** 2).sum(2)
    assert (screen.bounds(q, *centroids.blocks(q)) <= exact).all()
    where, best, asked = screen.nearest(q, *centroids.blocks(q))
    assert (where == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert asked < 0.5 * exact.size
    huge = rng.integers(-centroids.LARGEST, centroids.LARGEST, (50, 64))
    assert (centroids.Screen(huge[:9]).bounds(huge, *centroids.blocks(huge)) <= ((huge[:, None] - huge[None, :9]) ** 2).sum(2)).all()
