"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

1. Texts are dealt to chunks; each chunk hashes every window and sends its
   distinct hashes to their buckets (twice when the chunk itself repeats them).
2. A bucket counts its hashes; those counted more than once go back to the
   chunks that hold them.
3. Each chunk marks its repeated windows; overlapping windows merge into maximal
   removal intervals.

Null and empty texts have no words and lose none.  Repeated rows (also of one
doc_id) are separate texts, so each repeats the other.  Hashes have 64 bits: the
chance that any of n windows is wrongly taken as repeated is about n * n / 2**65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shuffle as X
from . import words as W

WINDOW = 35


def _chunk_windows(texts, window: int):
    """Slices with the hashes of their windows."""
    for s in W.slices(texts):
        yield s, *W.windows(s.hashes(), s.word_of, window)


def _send(window: int, n_buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = [h for _, h, _, _ in _chunk_windows(table["text"], window)]
        h = np.sort(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        edge = W.runs(h)
        distinct, times = h[edge[:-1]], np.minimum(np.diff(edge), 2)
        parts = X.split_buckets(distinct, n_buckets)
        keys = [np.repeat(distinct[i:j], times[i:j]) for _, i, j in parts]
        return pa.table({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "keys": X.packed(keys)})

    return send


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys, row = X.unpacked(table["keys"], np.uint64)
    chunk = table["chunk"].to_numpy()[row]
    order = np.argsort(keys, kind="stable")
    keys, chunk = keys[order], chunk[order]
    edge = W.runs(keys)
    again = np.repeat(np.diff(edge) > 1, np.diff(edge))
    keys, chunk = keys[again], chunk[again]
    order = np.argsort(chunk, kind="stable")
    keys, chunk = keys[order], chunk[order]
    at = W.runs(chunk)
    return pa.table({"chunk": pa.array([int(chunk[i]) for i in at[:-1]], pa.int32()), "keys": X.packed([np.unique(keys[i:j]) for i, j in zip(at, at[1:])])})


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:n]) > 0


def _remove(window: int):
    def remove(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        keys = np.unique(X.unpacked(repeated["keys"], np.uint64)[0]) if repeated.num_rows else np.zeros(0, np.uint64)
        n_words, n_removed, kept, spans = [], [], [], []
        for s, h, at, text in _chunk_windows(docs["text"], window):
            where = np.searchsorted(keys, h)
            hit = np.zeros(len(h), bool)
            if len(keys):
                where[where == len(keys)] = 0
                hit = keys[where] == h
            at, text = at[hit], text[hit]
            first = np.searchsorted(text, np.arange(s.n_texts + 1))
            raw = s.buf.tobytes()
            for i in range(s.n_texts):
                a, b = s.word_of[i], s.word_of[i + 1]
                words = raw[s.bounds[i] : s.bounds[i + 1]].split()
                gone = 0
                span: list[int] = []
                if first[i] < first[i + 1]:
                    out = covered(at[first[i] : first[i + 1]] - a, int(b - a), window)
                    gone = int(out.sum())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
                    span = edge.tolist()
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                n_words.append(int(b - a))
                n_removed.append(gone)
                kept.append(b" ".join(words))
                spans.append(span)
        return pa.table({
            "doc_id": docs["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "kept_text": pa.array([k.decode("utf-8") for k in kept], pa.string()), "spans": pa.array(spans, pa.list_(pa.int64())),
        })

    return remove


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove words covered by a window whose word sequence starts anywhere else.

    docs: doc_id, text.  Returns doc_id, n_words, n_removed, kept_sha256, kept_text
    and spans (ends of the removal intervals in words: from, to, from, to, ...)."""
    docs = docs.select("doc_id", "text")
    total = X.text_bytes(docs)
    docs = X.with_chunk(docs, X.chunk_count(total))
    sent = docs.groupBy("chunk").applyInArrow(_send(window, X.bucket_count(total)), "bucket int, chunk int, keys binary")
    repeated = sent.groupBy("bucket").applyInArrow(_count, "chunk int, keys binary")
    return docs.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(
        _remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<long>"
    )


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
