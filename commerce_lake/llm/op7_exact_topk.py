"""Exact top-k inner products with an impact-ordered index, score at a time.

Components become integers, floor(``SCALE`` x).  Rows are dealt to blocks of about
``ROW_BLOCK`` and each block is indexed once: for each dimension, the block's rows in
segments of one value, from the highest value to the lowest (read from the other end for
negative weights).  Queries are packed in blocks of at most ``QUERY_BLOCK``; groups of them
of at most ``GROUP_BYTES`` are broadcast to the stored index, so no row is copied for a query.

The impact of a segment is its product with the query's weight, less the least one of its
dimension, and never negative.  A query visits segments of all dimensions in tiers of
descending quantised impact and adds them up in one accumulator a row.  After a tier, the
best rows so far are scored exactly: the k-th of them is a lower bound for the result.  A
row can still gain at most the tier's impact in each dimension in which it was not met, and
is out of the running if that does not reach the bound.  The visit stops when so few rows
are left that scoring them exactly costs less than a further tier; all others are proven
not to belong to the result.

Rows take no part whose vec_id or vector is null, or that hold a null or non-finite
component; a query meets rows of its own dimension only.  The query's own row, and rows
that repeat its id, are no candidates.  A query id given with several vectors uses the
smallest.  Other repeated rows are candidates of their own.  Ties go to the smaller
vec_id.  Blocks whose products could exceed 53 bits are scored with whole Python integers
instead; scores beyond 64 bits are cut to the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shuffle import cut

SCALE = 256
K = 5
QUERY_BLOCK = 512
ROW_BLOCK = 8192
GROUP_BYTES = 32 << 20
#: Tiers, as shares of the query's largest impact.
TIERS = (0.3, 0.1, 0.06, 0.04, 0.02, 0.0)
#: Segments of a dimension at most; wider ranges of values are quantised.
SEGMENTS = 1024
#: The visit stops when at most one row in so many may still belong to the result.
OPEN_SHARE = 16
EXACT_BITS = 53


class ImpactIndex:
    """Rows (n, d) of integers, posted by dimension in segments of one (quantised) value, highest first."""

    def __init__(self, rows: np.ndarray):
        n, d = rows.shape
        self.rows = rows.astype(np.float64)
        self.low, self.high = rows.min(0), rows.max(0)
        order = np.argsort(-rows, axis=0, kind="stable")
        self.posted = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(rows, order, 0).T.astype(np.float64))
        # rows in the first j segments from the highest value down, and from the lowest up
        self.quantum = np.maximum(1, -(-(self.high - self.low + 1) // SEGMENTS))
        self.segments = (self.high - self.low) // self.quantum + 1
        width = int(self.segments.max())
        count = lambda code: np.bincount((code + np.arange(d) * width).ravel(), minlength=d * width).reshape(d, width)
        runs = lambda c: np.concatenate((np.zeros((d, 1), np.int64), np.cumsum(c, axis=1)), axis=1)
        self.from_high = runs(count((self.high - rows) // self.quantum))
        self.from_low = runs(count((rows - self.low) // self.quantum))
        self.visited = 0

    def search(self, q: np.ndarray, k: int, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, and their exact scores; all others are proven not to be. banned: rows that take no part."""
        n, d = self.rows.shape
        weights = q.astype(np.float64)
        size = np.abs(q)
        span = size * (self.high - self.low)
        lowest = np.where(q >= 0, self.low, self.high)  # the value of least impact
        least = float((q * lowest).sum())  # the score of a row that gains nothing
        top, every, down = int(span.max(initial=0)), np.arange(d), q > 0
        unit = float(1 << d.bit_length())  # one number holds a row's gain and in how many dimensions it was met
        sums, at = np.zeros(n), np.zeros(d, np.int64)
        live = np.ones(n, bool)
        live[banned] = False
        some, kept, step = np.zeros(0, np.int64), [], size * self.quantum
        for share in TIERS if n > 4 * max(k, OPEN_SHARE) else ():
            level = max(1, int(top * share))
            # segments whose impact reaches the level: the j-th spans impacts from span - (j + 1) * step + 1 on
            j = np.where(span >= level, (span - level) // np.maximum(step, 1) + 1, 0)
            j = np.minimum(j, self.segments)
            stop = np.where(down, self.from_high[every, j], self.from_low[every, j])
            where, gain = [], []
            for i in np.flatnonzero(stop > at).tolist():
                side = slice(at[i], stop[i]) if down[i] else slice(n - stop[i], n - at[i])
                where.append(self.posted[i, side])
                gain.append(self.values[i, side] * (weights[i] * unit) + (1 - weights[i] * lowest[i] * unit))
            at = np.maximum(at, stop)
            if where:
                rows = np.concatenate(where)
                self.visited += len(rows)
                sums += np.bincount(rows, np.concatenate(gain), minlength=n)
            gained = np.floor(sums / unit)
            best = np.argpartition(np.where(live, -gained, np.inf), 2 * k)[: 2 * k]
            some = np.union1d(some, best[live[best]])
            if len(some) < k:
                break
            bound = np.partition(self.rows[some] @ weights, len(some) - k)[len(some) - k] - least
            room = np.concatenate(([0.0], np.cumsum(np.sort(np.minimum(span, level - 1))[::-1])))
            met = (sums - gained * unit).astype(np.int64)
            open_ = np.flatnonzero(live & (gained + room[d - met] >= bound))
            if len(open_) <= n // OPEN_SHARE or level == 1:
                kept = open_
                break
        else:
            kept = np.flatnonzero(live)
        if len(some) < k and not len(kept):
            kept = np.flatnonzero(live)
        return kept, (self.rows[kept] @ weights).astype(np.int64)


def _vectors(column, scale: int) -> list[np.ndarray]:
    """floor(scale x) of each vector: 64-bit integers where they fit, Python's otherwise."""
    out = []
    for v in column.to_pylist():
        x = np.floor(scale * np.asarray(v, np.float64))
        out.append(x.astype(np.int64) if not len(x) or np.abs(x).max() < 2.0**62 else np.array([math.floor(scale * y) for y in v], object))
    return out


def _packed(vectors: list[np.ndarray]) -> bytes:
    small = all(v.dtype != object for v in vectors)
    return b"\0" + np.stack(vectors).astype("<i8").tobytes() if small else b"\1" + repr([[int(x) for x in v] for v in vectors]).encode()


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    if raw[:1] == b"\0":
        return np.frombuffer(raw, "<i8", offset=1).reshape(-1, dim)
    import ast

    return np.array(ast.literal_eval(raw[1:].decode()), object).reshape(-1, dim)


def _pack(block: str, key: str, vector: str, scale: int):
    """A row for each vector length of a block: ids in ascending order and their vectors."""

    def pack(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, vectors = table[key].to_numpy(), _vectors(table[vector], scale)
        size = np.array([len(v) for v in vectors], np.int64)
        out = []
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            own = own[np.argsort(ids[own], kind="stable")]
            out.append((k[0].as_py(), d, ids[own].astype("<i8").tobytes(), _packed([vectors[i] for i in own])))
        columns = list(zip(*out))
        return pa.table({n: pa.array(c, t) for n, c, t in zip((block, "dim", f"{key}s", "vectors"), columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    return pack


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, rows, index = None, None, None, None
        for b in batches:
            for block, dim, raw_ids, raw_rows, raw_asked, raw_queries in zip(*(b[c].to_pylist() for c in ("block", "dim", "vec_ids", "vectors", "query_ids", "asked"))):
                if held != (block, dim):
                    held, ids, rows = (block, dim), np.frombuffer(raw_ids, "<i8"), _unpacked(raw_rows, dim)
                    index = None
                out: list[tuple[int, int, int]] = []
                queries = _unpacked(raw_queries, dim)
                fits = rows.dtype != object and queries.dtype != object and float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * 4 * dim * dim < 2.0**EXACT_BITS
                if fits and index is None:
                    index = ImpactIndex(rows)
                for qid, q in zip(np.frombuffer(raw_asked, "<i8").tolist(), queries):
                    own = np.arange(np.searchsorted(ids, qid), np.searchsorted(ids, qid, side="right"))
                    if fits:
                        maybe, score = index.search(q, k, own)
                    else:
                        maybe = np.setdiff1d(np.arange(len(ids)), own)
                        score = (rows[maybe].astype(object) * q.astype(object)).sum(1) if len(maybe) else maybe
                    score = score.tolist()
                    best = sorted(range(len(score)), key=lambda i: (-score[i], maybe[i]))[:k]
                    out += [(qid, int(ids[maybe[i]]), max(-(1 << 63), min(score[i], (1 << 63) - 1))) for i in best]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return search


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def exact_topk(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """rows (vec_id, embedding), queries (query_id, query) -> query_id, rank, vec_id, score."""
    rows = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding") & (F.size("embedding") > 0))
    queries = queries.select("query_id", "query").where(F.col("query_id").isNotNull() & usable("query") & (F.size("query") > 0)).groupBy("query_id").agg(F.min("query").alias("query"))
    n_rows = rows.count()
    sized = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("query") + 1), F.lit(0)).alias("values")).first()
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    row_blocks = max(1, math.ceil(n_rows / ROW_BLOCK))
    dealt = rows.withColumn("block", deal(row_blocks, "vec_id", "embedding")).repartition(row_blocks, "block")
    index = cut(dealt.groupBy("block").applyInArrow(_pack("block", "vec_id", "embedding", scale), "block int, dim int, vec_ids binary, vectors binary"), "index")
    query_blocks = max(1, math.ceil(sized.n / QUERY_BLOCK))
    asked = queries.withColumn("qb", deal(query_blocks, "query_id")).groupBy("qb").applyInArrow(_pack("qb", "query_id", "query", scale), "qb int, dim int, query_ids binary, vectors binary")
    asked = cut(asked.withColumnRenamed("vectors", "asked"), "asked")
    groups = max(1, math.ceil(8 * sized["values"] / GROUP_BYTES))
    index = index.repartition(row_blocks, "block")
    found = None
    for g in range(groups):  # each at most about GROUP_BYTES of queries
        some = F.broadcast(asked.where(F.col("qb") % groups == g).drop("qb"))
        part = index.join(some, "dim").select("block", "dim", "vec_ids", "vectors", "query_ids", "asked").mapInArrow(_search(k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return exact_topk(rows, queries)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
