"""Exact Jaccard self-join on word shingles with token-combination prefixes.

A *token* is the 64-bit hash of a shingle.  All texts are counted into a sketch of
``SKETCH`` counters (a fixed size), which orders the tokens from rare to frequent;
only the order, never the result, depends on it.

A text of n tokens may miss tau = n - ceil(t n) of them in any text it links with.
Its prefix takes tokens in the global order until one of them must be shared:
rare tokens are indexed alone and each adds one; frequent tokens are spread over
partitions, indexed as pairs within a partition, and a partition of k of them adds
k - 1 (losing any k - 1 leaves no pair).  The prefix ends when that sum exceeds
tau, so two linked texts always meet under some signature.  Partitions follow the
size class, and a text is indexed for its own class and the next one.

Two members of a signature are compared only if, meeting there first, they can share
enough tokens (positions in the order, and numbers of rare tokens, bound that).
Members are first compared with one hub, the member that has the smallest share of
rare tokens.  Verified links are merged, and every pair of members that is
still in different components is then verified as well.  Verification compares
whole token sets.

Texts with equal sets form one class before any comparison.  Null or empty texts
have no shingles and link with nothing; rows with a null doc_id get a null
component.  Repeated rows are texts with equal sets; rows of one doc_id count as one
document that links when one of its texts does.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shuffle as X
from . import words as W
from .components import connected_components

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 22
SLICES = 64
#: Shares and sizes beyond which a key is dealt apart.
HOT_SHARE = 10_000
MOST_KEYS = 8 * X.BUCKET_KEYS
_SHORT = np.uint64(0xA24BAED4963EE407)


def token_sets(texts, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every text that has words."""
    for s in W.slices(texts, lower=True):
        h = s.hashes()
        t, _, text = W.windows(h, s.word_of, shingle)
        at = np.searchsorted(text, np.arange(s.n_texts + 1))
        n_words = s.n_words()
        for i in range(s.n_texts):
            if n_words[i] >= shingle:
                yield s.first + i, np.unique(t[at[i] : at[i + 1]])
            elif n_words[i]:
                own = h[s.word_of[i] : s.word_of[i + 1]]
                whole, _, _ = W.windows(own, np.array([0, len(own)]), len(own))
                yield s.first + i, W.mix(whole + np.array([len(own)], np.uint64) * _SHORT)


def _describe(shingle: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        cells: list[np.ndarray] = []
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            digest: list[bytes | None] = [None] * batch.num_rows
            for row, t in token_sets(batch["text"], shingle):
                n[row] = len(t)
                digest[row] = hashlib.blake2b(t.tobytes(), digest_size=16).digest()
                cells.append((t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                if len(cells) == 1000:
                    counts += np.bincount(np.concatenate(cells), minlength=len(counts))
                    cells.clear()
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(digest, pa.binary()), empty.cast(pa.int32()), empty.cast(pa.binary())], ["doc_id", "n", "digest", "slice", "counts"])
        if cells:
            counts += np.bincount(np.concatenate(cells), minlength=len(counts))
        if counts.any():
            parts = np.split(counts, SLICES)
            none = pa.nulls(SLICES)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["doc_id", "n", "digest", "slice", "counts"])

    return describe


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
            v = np.frombuffer(zlib.decompress(blob), np.int64)
            total[k] = total[k] + v if k in total else v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], ["slice", "counts"])


def _sketch(described: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: a fixed number of counters."""
    parts = described.where("slice is not null").select("slice", "counts")
    for keys in (["slice", F.pmod(F.xxhash64("counts"), F.lit(64))], ["slice"]):
        parts = parts.repartition(*keys).mapInArrow(_add_up, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(out) // SLICES
    for row in parts.collect():
        out[row.slice * width : (row.slice + 1) * width] += np.frombuffer(zlib.decompress(row.counts), np.int64)
    return out


def frequent_from(sketch: np.ndarray) -> int:
    """Tokens whose counter exceeds this are the frequent class."""
    mean = float(sketch.mean())
    return int(mean + max(64.0, 8 * math.sqrt(mean)))


def signatures(t: np.ndarray, sketch: np.ndarray, cutoff: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a token set, for each the most tokens that a text may share which meets
    it there first, and the number of rare tokens.

    A rare token at position i leaves n - i.  Pairs are indexed only after every rare
    token of the text, so texts that meet under pairs first share no rare token."""
    n = len(t)
    count = sketch[(t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(count, kind="stable")
    rare = int((count <= cutoff).sum())
    tau = n - (percent * n + 99) // 100
    if rare > tau:
        return t[order[: tau + 1]], n - np.arange(tau + 1), rare
    sigs = [t[order[:rare]]]
    often = t[order[rare:]]
    need = tau + 1 - rare
    width = math.log(100 / (percent - 1))  # of a size class: sizes of linked texts are at most one class apart
    own = int(math.log(n) / width)
    for c in (own, own + 1):
        parts = max(1, int(math.exp(c * width) * (100 - percent) / 100) // 4)
        p = (W.mix(often ^ np.uint64(c * 0x9E37 + 1)) % np.uint64(parts)).astype(np.int64)
        seen, first = np.unique(p, return_index=True)
        new = np.zeros(len(p), np.int64)
        new[first] = 1
        survive = np.cumsum(1 - new)
        end = int(np.searchsorted(survive, need)) + 1
        p, f = p[:end], often[:end]
        by = np.argsort(p, kind="stable")
        edge = W.runs(p[by])
        for i, j in zip(edge[:-1], edge[1:]):
            if j - i > 1:
                group = np.sort(f[by[i:j]])
                a, b = np.triu_indices(j - i, 1)
                sigs.append(W.mix(W.mix(group[a]) * np.uint64(3) + group[b] + np.uint64(c)))
    out = np.concatenate(sigs)
    left = np.full(len(out), n - rare)
    left[:rare] = n - np.arange(rare)
    return out, left, rare


def _index(sketch, cutoff: int, shingle: int, percent: int, n_buckets: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            own, who, meta = [], [], []
            for row, t in token_sets(batch["text"], shingle):
                if len(t) < 2 or ids[row] is None or (key := hashlib.blake2b(t.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(key)
                s, left, rare = signatures(t, sketch.value, cutoff, percent)
                own.append(s)
                who.append(np.full(len(s), ids[row], np.int64))
                meta.append(left.astype(np.uint64) | np.uint64(len(t) << 28 | (255 * rare // len(t)) << 56))
            if not own:
                continue
            keys, who_, meta_ = np.concatenate(own), np.concatenate(who), np.concatenate(meta)
            order = np.argsort(keys)
            keys, who_, meta_ = keys[order], who_[order], meta_[order]
            parts = X.split_buckets(keys, n_buckets)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), *(X.packed([v[i:j] for _, i, j in parts]) for v in (keys, who_, meta_))], ["bucket", "keys", "ids", "meta"])

    return index


def _classes(base: DataFrame) -> DataFrame:
    """(doc_id, n, digest) -> (doc_id, n, class_id): the smallest doc_id with an equal digest; null without a digest.

    A digest that more than one row in ``HOT_SHARE`` has is hot. There are fewer than
    ``HOT_SHARE`` of these, which are broadcast; the others meet their rows in a shuffle."""
    own = base.where("digest is not null")
    first = X.cut(own.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("times")), "digests")
    total = first.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = F.col("times") * HOT_SHARE > total
    held = own.join(F.broadcast(first.where(hot).select("digest", F.col("class_id").alias("hot_class"), F.lit(True).alias("hot"))), "digest", "left")
    rest = held.where("hot is null").join(first.where(~hot), "digest").select("doc_id", "n", "class_id")
    common = held.where("hot").select("doc_id", "n", F.col("hot_class").alias("class_id"))
    none = base.where("digest is null").select("doc_id", "n", F.lit(None).cast("long").alias("class_id"))
    return common.unionByName(rest).unionByName(none)


_MET = "sig long, id long, n long, left long, hub long, hub_n long, hub_left long"


def _members(sent: DataFrame) -> DataFrame:
    """Members of all signatures that have two or more, with their hubs.

    Buckets of ordinary size are reduced in one task each. In a bucket beyond ``MOST_KEYS`` keys
    some signature is hot: its members are unpacked in the tasks that read them, hubs are found
    by an aggregation that combines before the shuffle, and members join them in Spark."""
    size = sent.groupBy("bucket").agg(F.sum(F.length("keys") / 8).alias("keys"))
    large = [r.bucket for r in size.where(F.col("keys") > MOST_KEYS).select("bucket").collect()]  # at most one in MOST_KEYS keys
    met = sent.where(~F.col("bucket").isin(large)) if large else sent
    met = met.groupBy("bucket").applyInArrow(_meet, _MET)
    if not large:
        return met
    rows = sent.where(F.col("bucket").isin(large)).mapInArrow(_unpack_members, "sig long, id long, n long, left long, share int")
    hub = rows.groupBy("sig").agg(F.min(F.struct("share", "id", "n", "left")).alias("h"), F.count("*").alias("times")).where("times > 1")
    joined = rows.join(hub.select("sig", "h"), "sig")
    return met.unionByName(joined.select("sig", "id", "n", "left", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.left").alias("hub_left")))


def _unpack_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64((1 << 28) - 1)
    for batch in batches:
        for keys, ids, meta in zip(*(batch[c].to_pylist() for c in ("keys", "ids", "meta"))):
            m = np.frombuffer(meta, np.uint64)
            columns = (np.frombuffer(keys, np.int64), np.frombuffer(ids, np.int64), (m >> np.uint64(28) & low).astype(np.int64), (m & low).astype(np.int64), (m >> np.uint64(56)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "id", "n", "left", "share"])


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Signatures with two members or more: hub and members, with their sizes."""
    keys, _ = X.unpacked(table["keys"], np.uint64)
    ids, _ = X.unpacked(table["ids"], np.int64)
    meta, _ = X.unpacked(table["meta"], np.uint64)  # rare share, n, left
    order = np.argsort(keys)
    edge = W.runs(keys[order])
    order = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
    order = order[np.lexsort((ids[order], meta[order] >> np.uint64(56), keys[order]))]
    keys, ids = keys[order], ids[order]
    low = np.uint64((1 << 28) - 1)
    left, size = (meta[order] & low).astype(np.int64), (meta[order] >> np.uint64(28) & low).astype(np.int64)
    edge = W.runs(keys)
    times = np.diff(edge)
    hub, hub_n, hub_left = (np.repeat(v[edge[:-1]], times) for v in (ids, size, left))
    return pa.table({"sig": keys.view(np.int64), "id": ids, "n": size, "left": left, "hub": hub, "hub_n": hub_n, "hub_left": hub_left})


def _verify(shingle: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            ok = np.zeros(len(a), bool)
            # rows in a row with one text: it is hashed once
            text = batch["text_a"]
            new = pc.fill_null(pc.not_equal(text.slice(1), text.slice(0, max(len(text) - 1, 0))), True).to_numpy(zero_copy_only=False).astype(bool)
            group = np.concatenate(([0], np.cumsum(new))) if len(a) else np.zeros(0, np.int64)
            last, mine = -1, np.zeros(0, np.uint64)
            for row, t in token_sets(batch["text_b"], shingle):
                if group[row] != last:
                    last = group[row]
                    mine = next((s for _, s in token_sets(batch["text_a"].slice(row, 1), shingle)), np.zeros(0, np.uint64))
                both = len(np.intersect1d(mine, t, assume_unique=True))
                ok[row] = 100 * both >= percent * (len(mine) + len(t) - both)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, ok) if y], pa.int64()), pa.array([x for x, y in zip(b, ok) if y], pa.int64())], ["u", "v"])

    return verify


def _links(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of representatives whose texts link."""
    text = docs.where("doc_id is not null").select("doc_id", "text")
    both = pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(shingle, percent), "u long, v long")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, class_id, component_id for each row.

    class_id: smallest doc_id with an equal set; component_id: smallest doc_id reachable by links."""
    docs = docs.select("doc_id", "text")
    X.small_batches(docs.sparkSession)
    total = X.text_bytes(docs)
    described = X.cut(docs.mapInArrow(_describe(shingle), "doc_id long, n long, digest binary, slice int, counts binary"), "sets")
    sketch = _sketch(described)
    cutoff = frequent_from(sketch)
    held = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, (1 << 31) - 1).astype(np.int32))  # 2**SKETCH_BITS counters at every size
    base = described.where("slice is null").select("doc_id", "n", "digest")
    classes = X.cut(_classes(base), "classes")  # doc_id, n, class_id
    of = classes.where("class_id is not null").select("doc_id", "class_id").distinct()

    n_buckets = max(8, math.ceil(total * (100 - percent) * 1.5 / 100 / X.WORD_BYTES / X.BUCKET_KEYS * 2))
    sent = X.cut(docs.mapInArrow(_index(held, cutoff, shingle, percent, n_buckets), "bucket int, keys binary, ids binary, meta binary"), "sent")
    met = X.cut(_members(sent), "met")

    fits = lambda n, left, m, left_m: (100 + percent) * F.least(left, left_m) >= percent * (n + m)
    star = met.where((F.col("id") != F.col("hub")) & fits(*map(F.col, ("n", "left", "hub_n", "hub_left")))).groupBy("hub", "id").agg(F.count("*").alias("shared"))
    star = star.join(of.select(F.col("doc_id").alias("hub"), F.col("class_id").alias("a")), "hub").join(of.select(F.col("doc_id").alias("id"), F.col("class_id").alias("b")), "id").where("a <> b")
    best = star.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    best = X.cut(best, "pairs")
    links = X.cut(_links(best, docs, shingle, percent), "links")
    label = connected_components(links)

    member = met.select("sig", "id", "n", "left").join(of.select(F.col("doc_id").alias("id"), "class_id"), "id").join(label.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    member = member.select("sig", F.col("class_id").alias("x"), "n", "left", F.coalesce("component", "class_id").alias("c")).distinct()
    apart = member.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig")
    member = X.cut(member.join(apart, "sig"), "members")
    m, o = member.alias("m"), member.alias("o")
    more = m.join(o, (F.col("m.sig") == F.col("o.sig")) & (F.col("m.c") != F.col("o.c")) & (F.col("m.x") < F.col("o.x")) & fits(*map(F.col, ("m.n", "m.left", "o.n", "o.left"))))
    more = more.select(F.col("m.x").alias("a"), F.col("o.x").alias("b")).distinct()
    done = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = X.cut(more.join(done, ["a", "b"], "left_anti"), "pairs")
    if more.head(1):
        links = links.unionByName(_links(more, docs, shingle, percent))
        label = connected_components(links)
    out = classes.join(label.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    lone = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", lone)).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
