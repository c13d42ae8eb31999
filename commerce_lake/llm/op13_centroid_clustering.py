"""k-means by exact integer distances, accelerated by Shallot search.

Components become integers, floor(``SCALE`` x).  The centroids start as the vectors with the
smallest seeded digests of their ids; each round assigns every vector to its nearest centroid (ties
to the smaller number) and moves each centroid that has vectors to the floor of their mean.

Each vector keeps its nearest centroid and its second-nearest one, with an upper bound for
the distance to the first and a lower bound for all others, across rounds in a stored table.
Bounds follow the centroids' moves.  Where they (or half the way to the
nearest other centroid) already prove the first, nothing is computed.  Otherwise the distances to
both remembered centroids are computed and the search starts from the closer one: its neighbours
are visited in order of their distance from it, as far as that is at most the vector's distance
from it plus the second-best distance, and this ball shrinks as soon as a closer one is found.  What
lies beyond is farther than the second-best by the triangle inequality.  Survivors are
compared by squared distances in 64-bit integers; bounds are floating-point numbers with a margin.

Vectors take no part whose number of components is not ``dim``, or that are null or hold a
null or non-finite component.  Integers beyond 2^27 would overflow the squared distance: they raise an
error.  Vectors without a vec_id are assigned but never start a centroid.  Repeated ids are vectors of
their own; among those that could start, the smaller vector goes first.  Fewer vectors than
k give fewer centroids, none an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shuffle import cut

SCALE, DIM, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components up to this size have squared distances within 64 bits (for up to 64 of them).
LARGEST = 1 << 27
_MARGIN = 1e-9
_STATE = "vec_id long, e array<long>, a int, b int, upper double, lower double"


def vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["e"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Shallot:
    """The centroids of one round: nearest and second-nearest of vectors whose earlier ones are known."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray):
        k = len(centroids)
        self.centroids, self.moved = centroids, moved
        apart = np.array([[float(v) for v in squared(centroids, c)] for c in centroids]).reshape(k, k)
        self.apart = np.sqrt(apart)
        np.fill_diagonal(self.apart, -1)
        self.order = np.argsort(self.apart, axis=1, kind="stable")[:, 1:].astype(np.int32)
        self.near = np.take_along_axis(self.apart, self.order, 1)
        self.half = self.near[:, 0] / 2 if k > 1 else np.full(1, np.inf)
        others = np.array([np.delete(moved, i).max(initial=0) for i in range(k)])
        self.other_moved = others
        self.computed = 0

    def _squared(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        self.computed += len(x)
        return squared(x, self.centroids[c])

    def assign(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The four columns of the vectors' state, after this round's centroids."""
        a, b = a.copy(), b.copy()
        upper, lower = upper + self.moved[a], np.maximum(lower - self.other_moved[a], 0)
        proven = lambda r: upper[r] * (1 + _MARGIN) < np.maximum(lower[r], self.half[a[r]]) * (1 - _MARGIN)
        r = np.flatnonzero(~proven(np.arange(len(a))))
        first = self._squared(x[r], a[r])
        upper[r] = np.sqrt(first.astype(np.float64))
        still = ~proven(r)
        r, first = r[still], first[still]
        if len(self.centroids) == 1:
            lower[r] = np.inf
            return a, b, upper, lower
        one, two = a[r], b[r]
        second = self._squared(x[r], two)
        swap = (second < first) | (second == first) & (two < one)
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        start, tried = one.copy(), two.copy()
        radius = np.sqrt(first.astype(np.float64))
        live = np.arange(len(r))
        for j in range(len(self.centroids) - 1):
            live = live[self.near[start[live], j] * (1 - _MARGIN) <= (radius[live] + np.sqrt(second[live].astype(np.float64))) * (1 + _MARGIN)]
            if not len(live):
                break
            c = self.order[start[live], j]
            new = c != tried[live]
            v, c = live[new], c[new]
            d = self._squared(x[r[v]], c)
            best = (d < first[v]) | (d == first[v]) & (c < one[v])
            next_ = ~best & ((d < second[v]) | (d == second[v]) & (c < two[v]))
            w = v[best]
            second[w], two[w] = first[w], one[w]
            first[w], one[w] = d[best], c[best]
            second[v[next_]], two[v[next_]] = d[next_], c[next_]
        a[r], b[r] = one, two
        upper[r], lower[r] = np.sqrt(first.astype(np.float64)), np.sqrt(second.astype(np.float64))
        return a, b, upper, lower


def _assign(centroids: np.ndarray, moved: np.ndarray, dim: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Shallot(centroids, moved)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch, dim)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a component beyond {LARGEST}: squared distances would overflow")
            state = search.assign(x, *(batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "upper", "lower")))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["e"], *(pa.array(s) for s in state)], ["vec_id", "e", "a", "b", "upper", "lower"])

    return assign


def _sums(k: int, dim: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, a = vectors(batch, dim), batch["a"].to_numpy(zero_copy_only=False)
            for c in np.unique(a):
                total[c] += x[a == c].sum(0)
            n += np.bincount(a, minlength=k)
        c, d = np.divmod(np.arange(k * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total.ravel()), pa.array(n[c])], ["c", "d", "total", "n"])

    return sums


def _distances(centroids: np.ndarray, dim: int):
    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch["a"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(a), pa.array(squared(vectors(batch, dim), centroids[a]))], ["vec_id", "cluster", "distance"])

    return distances


def moved_to(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; those without vectors stay.  k * dim sums reach the driver."""
    k, dim = centroids.shape
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = state.select("a", "e").mapInArrow(_sums(k, dim), "c int, d int, total long, n long").groupBy("c", "d").agg(exact("total"), exact("n")).collect()
    out = centroids.copy()
    for r in rows:
        if r.n:
            out[r.c, r.d] = int(r.total) // int(r.n)
    return out


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """rows (vec_id, embedding) -> (vec_id, cluster, distance) of the vectors that take part, and the final centroids (k, dim)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.select("vec_id", x.alias("x")).where((F.size("x") == dim) & finite).select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("e"))
    start = kept.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "e").limit(k).collect()  # k rows
    centroids = np.array([r.e for r in start], np.int64).reshape(len(start), dim)
    if not len(start):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    if np.abs(centroids).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST}: squared distances would overflow")
    second = min(1, len(start) - 1)
    state = kept.select("vec_id", "e", F.lit(0).alias("a"), F.lit(second).alias("b"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    moved = np.zeros(len(start))
    for _ in range(rounds):
        state = cut(state.mapInArrow(_assign(centroids, moved, dim), _STATE), "assigned")
        after = moved_to(state, centroids)
        moved, centroids = np.sqrt(squared(after, centroids).astype(np.float64)), after
    last = state.mapInArrow(_assign(centroids, moved, dim), _STATE)
    return cut(last.mapInArrow(_distances(centroids, dim), "vec_id long, cluster int, distance long"), "clustered"), centroids


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """clustered with cluster_inertia, inertia and centroid_sha256."""
    total = {r.cluster: int(r.n) for r in clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # k rows
    name = lambda c: hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()
    each = clustered.sparkSession.createDataFrame([(c, n, sum(total.values()), name(centroids[c])) for c, n in total.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _round_sql(i: int) -> str:
    """Round i in SQL: s: assigned vectors, c: the centroids after it."""
    near = f"""s{i} AS (SELECT v, any_value(vec_id) AS vec_id, any_value(e) AS e, min((d, k)) AS best FROM (SELECT v.v, vec_id, v.e, k, list_sum(list_transform(list_zip(v.e, c{i}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY v)"""
    mean = f"""m{i} AS (SELECT k, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY j) AS e FROM (SELECT best[2] AS k, j, sum(x)::BIGINT AS t, count(*) AS n FROM (SELECT best, unnest(range(64)) AS j, unnest(e) AS x FROM s{i}) GROUP BY ALL) GROUP BY k),
c{i + 1} AS (SELECT k, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (k))"""
    return near + (",\n" + mean if i < ROUNDS else "")


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k, e FROM v WHERE vec_id IS NOT NULL ORDER BY k LIMIT 16),
{", ".join(_round_sql(i) for i in range(ROUNDS + 1))}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.e, ',')) AS centroid_sha256
FROM s{ROUNDS} JOIN c{ROUNDS} ON k = best[2]
"""
