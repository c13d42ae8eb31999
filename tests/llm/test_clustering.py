"""Shallot k-means against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF

from commerce_lake.llm import op13_centroid_clustering as C
from commerce_lake.llm.queries import ORACLES, QUERIES

EXTRA = "a int, b string, e double, cluster long, distance string"


def plain(rows, k, rounds, scale, dim, seed=1):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), e) for i, e in kept if i is not None)[:k]
    centroids = [e for _, e in start]
    near = lambda e: min((sum((p - q) ** 2 for p, q in zip(e, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        to = [near(e)[1] for _, e in kept]
        for j in range(len(centroids)):
            if own := [e for (_, e), t in zip(kept, to) if t == j]:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, near(e)[1], near(e)[0]) for i, e in kept], centroids


def rows_of(n, dim, spread, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, spread, (6, dim))
    return [(int(i), [float(v) for v in middle[rng.integers(6)] + rng.normal(0, 0.3, dim)]) for i in range(n)]


@pytest.mark.parametrize(("dim", "k", "rounds", "scale"), [(8, 5, 4, 64), (2, 7, 3, 2), (64, 16, 3, 64), (3, 1, 2, 64), (4, 2, 0, 64)])
def test_clusters(spark, dim, k, rounds, scale):
    rows = rows_of(250, dim, 1.0) + rows_of(40, dim, 1.0)  # repeated ids
    rows += [(900, None), (901, [1.0] * (dim - 1)), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, []), (None, [0.5] * dim)]
    rows += [(910 + i, [1.0] * dim) for i in range(30)]  # ties
    d = spark.createDataFrame([(*r, *[None] * 5) for r in rows], f"vec_id long, embedding array<double>, {EXTRA}").repartition(3)
    got, centroids = C.cluster(d, k, rounds, scale, dim)
    want, means = plain(rows, k, rounds, scale, dim)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and centroids.tolist() == means
    out = C.with_inertia(got, centroids).collect()
    assert {r.inertia for r in out} == {sum(x[2] for x in want)}
    assert all(r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster) for r in out)


def test_search_skips_distances():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-4000, 4000, (30, 6))
    x = centroids[rng.integers(0, 30, 2000)] + rng.integers(-150, 150, (2000, 6))
    s = C.Shallot(centroids, np.zeros(30))
    a, b, upper, lower = s.assign(x, np.zeros(2000, np.int32), np.ones(2000, np.int32), np.full(2000, np.inf), np.zeros(2000))
    d = ((x[:, None] - centroids[None]) ** 2).sum(2)
    rank = np.argsort(d, axis=1, kind="stable")
    assert (a == rank[:, 0]).all() and s.computed < 0.8 * 2000 * 30
    known = np.isclose(lower**2, np.take_along_axis(d, rank[:, 1:2], 1)[:, 0])
    assert (known | (lower == 0)).all()
    moved = centroids + rng.integers(-3, 3, centroids.shape)
    t = C.Shallot(moved, np.sqrt(((moved - centroids) ** 2).sum(1)))
    a2, *_ = t.assign(x, a, b, upper, lower)
    assert (a2 == ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all() and t.computed < 0.1 * 2000 * 30


def test_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert C.with_inertia(*C.cluster(empty)).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 4), (2, [0.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="overflow"):
        C.cluster(huge, dim=4)


def test_query(spark, duck):
    got = sorted(map(tuple, QUERIES["op13_centroid_clustering"](spark, SF).collect()))
    assert got and got == sorted(duck.execute(ORACLES["op13_centroid_clustering"]).fetchall())
