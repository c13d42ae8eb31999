"""Chunked key exchange: count or reduce 64-bit keys of all texts over a Spark shuffle.

Texts are dealt to *chunks* by a hash of id, text and place (about ``CHUNK_BYTES`` of
text each).  A chunk task sends each distinct key once to the key's *bucket* (the
map-side combine that takes the heat out of hot keys), packed as binary columns,
since eight-byte rows would cost several times their size.  A bucket task sees
about ``BUCKET_KEYS`` keys.  Both counts follow the input, so the memory of a
task stays the same at every size.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_root

CHUNK_BYTES = 6 << 20
BUCKET_KEYS = 1 << 20
WORD_BYTES = 6
BATCH_ROWS = 2000
#: Of tables between steps: a writing task holds one row group.
ROW_GROUP_BYTES = 32 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which executors and driver share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session, unless the user has set another number than
    Spark's default: texts are long, and a task holds several batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as keep it apart from df's columns."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one pass without a shuffle of rows."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def chunk_count(total_bytes: int) -> int:
    return max(8, math.ceil(total_bytes / CHUNK_BYTES))


def bucket_count(total_bytes: int) -> int:
    return max(8, math.ceil(total_bytes / WORD_BYTES / BUCKET_KEYS))


def with_chunk(docs: DataFrame, n: int) -> DataFrame:
    """Deal rows to n chunks by a hash of id, text and the stored part they come from.

    So neither rows of one id (or none) nor rows of one text meet in one chunk."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int"))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def split_buckets(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys."""
    b = bucket_of(keys, n)
    edges = np.flatnonzero(b[1:] != b[:-1]) + 1 if len(b) else np.zeros(0, np.int64)
    at = [0, *edges.tolist(), len(keys)] if len(keys) else [0]
    return [(int(b[i]), i, j) for i, j in zip(at, at[1:])]


def packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def unpacked(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column and the row each came from."""
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), rows
