"""Language-model scores of whole documents.

Counts.  Words of all training documents are counted exactly over a keyed exchange; each
chunk of documents gets the counts of its own words back.

Model.  The ``VOCABULARY`` most frequent tokens are words of a gated recurrent model
(module gru) with a class-factored softmax; any other word belongs to one of
``RARE_CLASSES`` classes by its last two bytes and has the probability
(c + 1) / (n + v + 1) in its class (n tokens, v distinct words of the class in training),
so unseen words have one too.  The recurrent part is fitted on every training document
once: each is encoded and dealt by hash to a shard of about ``SHARD_BYTES`` of text, and
each shard is one task.  Rounds take 1, ``FAN`` - 1, then ``FAN`` times as many shards and go on
from the average of the round before; parameters are averaged in groups of ``FAN``, groups
of groups, until few are left for the driver.

Scores.  A document is scored to its end with its state carried on; ``score`` is the log10
probability of its words and its end, ``base_score`` that of the add-one unigram model.

Null and empty texts have the end token only.  Rows with a null doc_id train as others.
Repeated rows are counted and scored alike.  Without training documents every count is 0.
"""

from __future__ import annotations

import math
import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from . import shuffle as X
from . import words as W

VOCABULARY = 4096
CLASS_SIZE = 64
RARE_CLASSES = 48
SHARD_BYTES = 16 << 20
FAN = 8
DIVISOR, REMAINDER = 7, 2
END = np.uint64(0x5DEECE66D1234567)
_NO_LETTER = W.NO_LETTER


def rare_class(s: W.Slice) -> np.ndarray:
    """Class of each word by its last two bytes before one final punctuation mark, and that mark."""
    last = s.ends - 1
    mark = _NO_LETTER[s.buf[last]] & (last > s.starts)
    last = last - mark
    before = np.where(last > s.starts, s.buf[np.maximum(last - 1, 0)], 0).astype(np.int64)
    half = RARE_CLASSES // 2
    return ((before * 131 + s.buf[last]) * 40503 >> 7) % half + half * mark


def is_held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % DIVISOR == REMAINDER for i in ids], bool)


def _send(n_buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        training = ~is_held_out(table["doc_id"].to_pylist())
        keys, counts, classes = [np.array([END])], [np.array([training.sum()])], [np.zeros(1, np.int64)]
        for s in W.slices(table["text"], lower=True):
            own, first, back = np.unique(s.hashes(), return_index=True, return_inverse=True)
            counted = np.repeat(training[s.first : s.first + s.n_texts], s.n_words())
            keys.append(own)
            counts.append(np.bincount(back, counted, minlength=len(own)).astype(np.int64))
            classes.append(rare_class(s)[first])
        k = np.concatenate(keys)
        own, first, back = np.unique(k, return_index=True, return_inverse=True)
        n = np.bincount(back, np.concatenate(counts)).astype(np.uint32)
        c = np.concatenate(classes)[first].astype(np.uint8)
        parts = X.split_buckets(own, n_buckets)
        cut = lambda v: X.packed([v[i:j] for _, i, j in parts])
        return pa.table({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "keys": cut(own), "counts": cut(n), "classes": cut(c)})

    return send


_COUNTED = "kind int, chunk int, keys binary, counts binary, a long, b long, c long"


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Kind 0: counts for a chunk's keys; 1: a frequent key a, its count b and class c; 2: class a, its tokens b and words c."""
    keys, row = X.unpacked(table["keys"], np.uint64)
    counts, _ = X.unpacked(table["counts"], np.uint32)
    classes, _ = X.unpacked(table["classes"], np.uint8)
    own, first, back = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(back, counts).astype(np.int64)
    cls = classes[first].astype(np.int64)
    chunk = table["chunk"].to_pylist()
    edge = np.searchsorted(row, np.arange(len(chunk) + 1))
    kinds: list[tuple] = [(0, chunk[i], keys[edge[i] : edge[i + 1]].tobytes(), total[back[edge[i] : edge[i + 1]]].tobytes(), None, None, None) for i in range(len(chunk))]
    top = np.lexsort((own, -total))[:VOCABULARY]
    kinds += [(1, None, None, None, int(own[i].astype(np.int64)), int(total[i]), int(cls[i])) for i in top if total[i] > 0 and own[i] != END]
    n, v = np.bincount(cls, total * (own != END), minlength=RARE_CLASSES), np.bincount(cls, (total > 0) & (own != END), minlength=RARE_CLASSES)
    kinds += [(2, None, None, None, i, int(n[i]), int(v[i])) for i in range(RARE_CLASSES)]
    kinds += [(3, None, None, None, 0, int(total[i]), int(total[i] > 0)) for i in np.flatnonzero(own == END)]
    columns = list(zip(*kinds))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({name: pa.array(col, t) for name, col, t in zip(("kind", "chunk", "keys", "counts", "a", "b", "c"), columns, types)})


@dataclass
class Vocabulary:
    """Ids of the frequent tokens (the end token last) and the shares of rare words."""

    keys: np.ndarray
    ids: np.ndarray
    n_words: int
    rare_total: np.ndarray
    tokens: int
    distinct: int

    def encode(self, h: np.ndarray, classes: np.ndarray) -> np.ndarray:
        i = self.find(h)
        return np.where(i >= 0, self.ids[i], self.n_words + classes)

    def __post_init__(self):
        self.find = W.Lookup(self.keys)


def vocabulary(counted: DataFrame) -> tuple[Vocabulary, dict]:
    """The vocabulary and initial parameters from the buckets' counts."""
    top = counted.where("kind = 1").orderBy(F.desc("b"), "a").limit(VOCABULARY - 1).select("a", "b", "c").collect()
    sums = {r.a: (r.n, r.v) for r in counted.where("kind = 2").groupBy("a").agg(F.sum("b").alias("n"), F.sum("c").alias("v")).collect()}
    end = counted.where("kind = 3").agg(F.sum("b").alias("n")).first().n or 0
    keys = np.array([r.a for r in top], np.int64).view(np.uint64)
    n = np.array([sums.get(i, (0, 0))[0] for i in range(RARE_CLASSES)], np.int64)
    v = np.array([sums.get(i, (0, 0))[1] for i in range(RARE_CLASSES)], np.int64)
    tokens, distinct = int(n.sum()) + end, int(v.sum()) + (end > 0)
    for r in top:
        n[r.c] -= r.b
        v[r.c] -= 1
    all_keys = np.append(keys, END)
    order = np.argsort(all_keys)
    params = gru.init(len(all_keys), CLASS_SIZE, RARE_CLASSES, np.array([*(r.b for r in top), end], np.float64), n.astype(np.float64))
    return Vocabulary(all_keys[order], order, len(all_keys), n + v + 1, tokens, distinct), params


def encode_texts(vocab: Vocabulary, texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by the end id, and the texts' bounds."""
    end = vocab.n_words - 1
    parts, sizes = [], []
    for s in W.slices(texts, lower=True):
        ids = vocab.encode(s.hashes(), rare_class(s))
        parts.append(np.insert(ids, s.word_of[1:], end))
        sizes.append(s.n_words() + 1)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate(([0], np.cumsum(size)))


def _encode(vocab):
    """Batches of training documents -> a row for each shard: order, length and ids of its documents."""

    def encode(batches):
        for batch in batches:
            ids, bounds = encode_texts(vocab.value, pa.chunked_array([batch.column("text")]))
            ids = ids.astype(np.uint16)
            order = batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            rows: list[tuple] = []
            for k in np.unique(shard):
                at = np.flatnonzero(shard == k)
                rows.append((int(k), order[at].tobytes(), np.diff(bounds)[at].tobytes(), np.concatenate([ids[bounds[i] : bounds[i + 1]] for i in at]).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENCODED_TYPES)], list(_ENCODED_NAMES))

    return encode


_ENCODED = "shard int, orders binary, sizes binary, ids binary"
_ENCODED_NAMES, _ENCODED_TYPES = ("shard", "orders", "sizes", "ids"), (pa.int32(), pa.binary(), pa.binary(), pa.binary())
_FITTED = "shard int, documents long, params binary"


def shard_stream(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a shard's encoded rows, documents by the hash of doc_id and text, and the marks of their first ids."""
    order, _ = X.unpacked(table["orders"], np.int64)
    size, _ = X.unpacked(table["sizes"], np.int64)
    ids, _ = X.unpacked(table["ids"], np.uint16)
    first = np.cumsum(size) - size
    by = np.lexsort((size, order))
    to = np.cumsum(size[by]) - size[by]
    ids = ids[np.repeat(first[by] - to, size[by]) + np.arange(len(ids))].astype(np.int64)
    start = np.zeros(len(ids), bool)
    start[to] = True
    return ids, start


def _fit_shard(params, last: bool):
    """Fits a shard; the last round leaves out the sums that only a further round would use."""

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, start = shard_stream(table)
        fitted = gru.train(params.value, ids, start)
        if last:
            fitted = {k: v for k, v in fitted.items() if not k.startswith("seen_")}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "documents": pa.array([int(start.sum())], pa.int64()), "params": pa.array([pickle.dumps((1, fitted))], pa.binary())})

    return fit


def _merged(rows: list[bytes]) -> tuple[int, dict]:
    """Number of shards and mean parameters of (number, mean) pairs."""
    total, mean = 0, {}
    for n, p in map(pickle.loads, rows):
        total += n
        # a running mean: at most two sets of parameters are held
        mean = {k: (m + (p[k] - m) * (n / total) if m.dtype.kind == "f" else m) for k, m in mean.items()} or {k: v.astype(np.float64) if v.dtype.kind == "f" else v for k, v in p.items()}
    return total, {k: v.astype(np.float32) if v.dtype.kind == "f" else v for k, v in mean.items()}


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "documents": pa.array([sum(table["documents"].to_pylist())], pa.int64()), "params": pa.array([pickle.dumps(_merged(table["params"].to_pylist()))], pa.binary())})


def fit(docs: DataFrame, vocab: Vocabulary, params: dict, total: int) -> tuple[dict, int]:
    """Parameters fitted to all training documents (doc_id, text) of ``total`` bytes, and how many they are."""
    context = docs.sparkSession.sparkContext
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    training = docs.where(F.coalesce(crc % DIVISOR != REMAINDER, F.lit(True)))
    shards = max(1, math.ceil(total / SHARD_BYTES))
    # rows that repeat id and text part by where they are stored
    shard = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(shards)).cast("int")
    dealt = training.select("text", F.xxhash64("doc_id", "text").alias("place"), shard.alias("shard"))
    encoded = X.cut(dealt.mapInArrow(_encode(context.broadcast(vocab)), _ENCODED), "fit")
    documents, low, high = 0, 0, 1
    while low < shards:
        mine = encoded.where((F.col("shard") >= low) & (F.col("shard") < high))
        n = min(high, shards) - low
        fitted = mine.repartition(n, "shard").groupBy("shard").applyInArrow(_fit_shard(context.broadcast(params), high >= shards), _FITTED)
        while n > FAN:
            n = -(-n // FAN)
            fitted = fitted.groupBy(F.floor(F.col("shard") / FAN).cast("int").alias("group")).applyInArrow(_merge, _FITTED)
        rows = sorted(fitted.collect(), key=lambda r: r.shard)  # at most FAN sets of parameters; ordering in Spark would fit twice
        if rows:
            params = _merged([r.params for r in rows])[1]
            documents += sum(r.documents for r in rows)
        low, high = high, high * FAN
    return {k: v for k, v in params.items() if not k.startswith("seen_")}, documents


def _score(vocab, params):
    def score(docs: pa.Table, counted: pa.Table) -> pa.Table:
        v, p = vocab.value, params.value
        keys, _ = X.unpacked(counted["keys"], np.uint64)
        counts, _ = X.unpacked(counted["counts"], np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        find, known = W.Lookup(keys), v.encode(keys, np.zeros(len(keys), np.int64))
        held = is_held_out(docs["doc_id"].to_pylist())
        n_tokens, n_known, base, rare, ids, sizes = [], [], [], [], [], []
        c_end = int(counts[find(np.array([END]))[0]]) if len(keys) else 0
        per_token = math.log10(v.tokens + v.distinct + 1)
        for s in W.slices(docs["text"], lower=True):
            h, cls = s.hashes(), rare_class(s)
            at = find(h)
            c, own = counts[at], known[at]
            own = np.where(own >= v.n_words, v.n_words + cls, own)
            logs = np.log10(c + 1.0)
            inside = np.where(own >= v.n_words, logs - np.log10(v.rare_total[cls]), 0.0)
            run = np.concatenate((np.zeros((1, 3)), np.cumsum(np.stack((logs, inside, c > 0), axis=1), axis=0)))
            total = run[s.word_of[1:]] - run[s.word_of[:-1]]
            n = s.n_words() + 1
            n_tokens.append(n)
            n_known.append(total[:, 2].round().astype(np.int64) + (c_end > 0))
            base.append(total[:, 0] + math.log10(c_end + 1) - n * per_token)
            rare.append(total[:, 1])
            ids.append(np.insert(own, s.word_of[1:], v.n_words - 1))
            sizes.append(n)
        flat = lambda x: np.concatenate(x) if x else np.zeros(0)
        bounds = np.concatenate(([0], np.cumsum(flat(sizes)))).astype(np.int64)
        model = gru.score(p, flat(ids).astype(np.int64), bounds) / math.log(10) + flat(rare)
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pa.array(held), "n_tokens": pa.array(flat(n_tokens).astype(np.int64)), "n_known": pa.array(flat(n_known).astype(np.int64)),
            "train_tokens": pa.array(np.full(docs.num_rows, v.tokens, np.int64)), "base_score": pa.array(flat(base)), "score": pa.array(model),
        })

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    total = X.text_bytes(docs)
    dealt = X.with_chunk(docs, X.chunk_count(total))
    n_buckets = max(8, math.ceil(total / X.WORD_BYTES / X.BUCKET_KEYS / 4))
    sent = dealt.groupBy("chunk").applyInArrow(_send(n_buckets), "bucket int, chunk int, keys binary, counts binary, classes binary")
    counted = X.cut(sent.groupBy("bucket").applyInArrow(_count, _COUNTED), "counts")
    vocab, params = vocabulary(counted)
    params, _ = fit(docs, vocab, params, total)
    context = docs.sparkSession.sparkContext
    answers = counted.where("kind = 0").select("chunk", "keys", "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(context.broadcast(vocab), context.broadcast(params)), schema)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
