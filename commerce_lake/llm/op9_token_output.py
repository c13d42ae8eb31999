"""Token-ID output: documents as Parquet list columns in doc_id order, and their reader.

Layout: one file for each range of doc_id, ``part`` counting the ranges, rows in
doc_id order.  ``ids`` is a list column that Parquet dictionary-encodes (ids of a
row group repeat); the metadata columns are delta-encoded by writer version 2.
Row groups and pages have set sizes, and the writer keeps page indexes, so readers
of metadata or of a few documents skip the token pages.

A word between ASCII white space is encoded once per task and table of known words
(the tokenizer drops white space, so a text's ids are its words' ids in a row).

Null texts are empty: just the end id.  Rows of one doc_id stay together, ordered
by text; a null doc_id sorts first.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shuffle as X
from . import words as W

END_ID = 2
PART_BYTES = 24 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
KNOWN_WORDS = 1 << 20
ENCODE_WORDS = 4096
PARTS = 4096
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable:
    """Ids of the words met so far; emptied when it holds more than ``KNOWN_WORDS``."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def lookup(self, s: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the slice: start and length of its ids in ``flat``."""
        if len(self.keys) > KNOWN_WORDS:
            self.clear()
        own, first, back = np.unique(s.hashes(), return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, own)
        if len(self.keys):
            new = self.keys[np.minimum(where, len(self.keys) - 1)] != own
        else:
            new = np.ones(len(own), bool)
        if new.any():
            fresh, parts, sizes = first[new].tolist(), [], []
            for k in range(0, len(fresh), ENCODE_WORDS):
                texts = [s.word(i).decode("utf-8", "replace") for i in fresh[k : k + ENCODE_WORDS]]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                parts.append(np.fromiter((x for e in ids for x in e), np.int32, int(sizes[-1].sum())))
            size = np.concatenate(sizes)
            keys = np.concatenate((self.keys, own[new]))
            start = np.concatenate((self.at[:-1] if len(self.keys) else np.zeros(0, np.int64), len(self.flat) + np.cumsum(size) - size))
            length = np.concatenate((self.size if len(self.keys) else np.zeros(0, np.int64), size))
            order = np.argsort(keys, kind="stable")
            self.keys, start, self.size = keys[order], start[order], length[order]
            self.at = np.concatenate((start, [0]))
            self.flat = np.concatenate((self.flat, *parts))
            where = np.searchsorted(self.keys, own)
        where = where[back]
        return self.at[where], self.size[where] if len(self.keys) else np.zeros(0, np.int64)


_open: dict[int, WordTable] = {}


def word_table(definition: bytes) -> WordTable:
    """The table of this Python worker; later tasks of the worker with the same tokenizer go on with it."""
    key = zlib.crc32(definition) << 32 | len(definition)
    if key not in _open:
        _open.clear()
        _open[key] = WordTable(definition)
    return _open[key]


def encode_slice(table: WordTable, s: W.Slice, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of the slice and the number of each text, end ids included."""
    start, size = table.lookup(s)
    ends = s.word_of[1:]
    start, size = np.insert(start, ends, len(table.flat)), np.insert(size, ends, 1)
    flat = np.append(table.flat, np.int32(end_id))
    stop = np.cumsum(size)
    where = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - size), size)
    last = stop[ends + np.arange(len(ends))]
    return flat[where], np.diff(np.concatenate(([0], last)))


def _encode(definition, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, done = word_table(definition.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for s in W.slices(batch["text"], size=2 * W.SLICE_BYTES):
                flat, n = encode_slice(table, s, end_id)
                stop = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stop)).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(s.first, s.n_texts), pa.array(np.full(len(n), part, np.int32)), pa.array(done + stop - n), pa.array(n), ids], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                done += int(stop[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) into the folder ``path`` in ascending doc_id order."""
    docs = docs.select("doc_id", "text")
    X.small_batches(docs.sparkSession)
    n = max(8, math.ceil(X.text_bytes(docs) / PART_BYTES))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    with open(tokenizer or default_tokenizer(), "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # executors need no such file
    encoded = ordered.mapInArrow(_encode(definition, end_id), SCHEMA)
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
    encoded.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].tolist() if len(ids) else [0]
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8)) if len(ids) else b""
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "part", "local_start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def read_index(spark, path: str) -> DataFrame:
    """Metadata of the written documents without their token pages: doc_id, part, local_start, start, n_tokens."""
    meta = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return _with_start(meta, meta)


def _with_start(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before.  Parts are summed in groups of ``PARTS``; one row for each group is ordered in one task."""
    size = meta.groupBy("part").agg(F.sum("n_tokens").alias("size")).withColumn("group", F.floor(F.col("part") / PARTS))
    groups = size.groupBy("group").agg(F.sum("size").alias("whole"))
    groups = groups.select("group", (F.sum("whole").over(Window.orderBy("group")) - F.col("whole")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("group").orderBy("part")) - F.col("size")
    base = size.withColumn("inside", inside).join(groups, "group").select("part", (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("local_start"))


def read_ids(spark, path: str, first: int, last: int) -> DataFrame:
    """doc_id, n_tokens and ids of the documents with first <= doc_id <= last.

    The bounds reach the scan: files and row groups by their statistics, pages by the page index."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "ids")


def read_documents(spark, path: str) -> DataFrame:
    """All written documents: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    rows = spark.read.parquet(path).mapInArrow(_crc, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return _with_start(spark.read.parquet(path).select("part", "n_tokens"), rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    path = X.shared_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
