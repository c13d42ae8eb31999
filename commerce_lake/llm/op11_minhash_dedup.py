"""Near-duplicate removal with SuperMinHash signatures, banding, verification and union-find.

A signature has ``WIDTH`` places.  Each shingle deals its ranks to all places in an order of
its own (a permutation drawn step by step from its hash): the place drawn in step j gets the
value j plus a fraction, and a place keeps the smallest value of the set.  The ranks of one
shingle are correlated that way, which lowers the variance of signatures of small sets.
Values of step j are all below those of step j + 1, so a set is done with the first step
after which every place has a value; a set of many shingles takes one step.

Signatures are cut into bands of ``ROWS`` places.  Sets that agree in a band meet there.
Each member of a band is first compared with the band's smallest id (a star, so a group of
any size costs one pair for each member); verified pairs are contracted by union-find
inside tasks and by star steps over the shuffle.

Members of bands that hold several groups are still open.  They get a second star around
another member, and those that are in different groups even then are paired if their sizes
and sketches allow a link: an odd sketch of the set (two sets differ in at least as many
shingles as their sketches do in places, so this rules out no link) and two bits of each place of the
signature.  Verification compares whole shingle sets, so no pair is linked by chance.

A pair of similarity 0.85 shares no band with probability (1 - 0.85^4)^32 = 6e-11 (0.8: 5e-8);
the bound on the agreement of signatures fails with ``MISS`` at most.  Nothing is capped.

Sets that are equal form one class before any comparison.  Null or empty texts have no
shingles and link with nothing.  Rows with a null doc_id get a null component and are kept.
Rows of one doc_id count as one document, which links when one of its texts does; repeated
rows all appear in the result with the same values.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shuffle as X
from . import words as W
from .components import connected_components
from .op5_jaccard_join import _classes, _links, token_sets

SHINGLE, PERCENT = 5, 80
WIDTH, ROWS = 128, 4
BANDS = WIDTH // ROWS
#: Words of a set's sketch: two bits of each place of its signature, and its odd sketch.
PLANES, ODD = range(4), range(4, 20)
#: Probability that the sketches of a linked pair seem too different.
MISS = 1e-9
_FRACTION = 40
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15


def superminhash(shingles: np.ndarray, owner: np.ndarray, n_sets: int) -> np.ndarray:
    """Signatures (n_sets, WIDTH) of the sets whose shingle hashes belong to ``owner`` (ascending); a set without any has _TOP everywhere.

    All sets advance together, step by step; those whose places all have a value drop out."""
    sig = np.full(n_sets * WIDTH, _TOP, np.uint64)
    seed, base, order = shingles, owner * WIDTH, None
    low = np.uint64((1 << _FRACTION) - 1)
    for j in range(WIDTH):
        if not len(seed):
            break
        h = W.mix(seed + np.uint64((j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        draw = j + (((h >> np.uint64(_FRACTION)) * np.uint64(WIDTH - j)) >> np.uint64(64 - _FRACTION)).astype(np.int64)
        rows = np.arange(len(seed))
        place = draw if order is None else order[rows, draw].astype(np.int64)
        np.minimum.at(sig, base + place, (h & low) | np.uint64(j << _FRACTION))
        if j == WIDTH - 1:
            break
        is_open = (sig.reshape(n_sets, WIDTH) == _TOP).any(1)[base // WIDTH]
        if order is None:  # the permutations of the few sets that go on
            keep = np.flatnonzero(is_open)
            seed, base, draw = seed[keep], base[keep], draw[keep]
            order = np.tile(np.arange(WIDTH, dtype=np.uint8), (len(seed), 1))
            order[np.arange(len(seed)), draw] = 0
            continue
        order[rows, draw] = order[:, j]
        if 4 * is_open.sum() < 3 * len(seed):
            keep = np.flatnonzero(is_open)
            seed, base, order = seed[keep], base[keep], order[keep]
    return sig.reshape(n_sets, WIDTH)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = W.mix(key * np.uint64(_STEP) + parts[:, :, r])
    return key


def planes(sig: np.ndarray) -> np.ndarray:
    """Two bits of each place, as two planes of WIDTH bits in 64-bit words."""
    h = W.mix(sig)
    bits = [np.packbits((h >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for b in (0, 1)]
    return np.concatenate(bits, axis=1)


def odd_sketch(shingles: np.ndarray, owner: np.ndarray, n_sets: int) -> np.ndarray:
    """Whether an odd number of a set's shingles falls on each of 64 * len(ODD) places, in 64-bit words.

    Two sets differ in at least as many shingles as their sketches in places."""
    width = 64 * len(ODD)
    place = owner * width + (shingles % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(place, minlength=n_sets * width) & 1).astype(np.uint8).reshape(n_sets, width)
    return np.packbits(odd, axis=1).view(np.int64)


def least_agreement(percent: int) -> int:
    """Places in which the sketches of a linked pair agree, but with probability MISS."""
    s = percent / 100
    p, tail = s + (1 - s) / 4, 0.0
    for k in range(WIDTH + 1):
        tail += math.comb(WIDTH, k) * p**k * (1 - p) ** (WIDTH - k)
        if tail > MISS:
            return k
    return WIDTH


def _describe(shingle: int, percent: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            digest: list[bytes | None] = [None] * batch.num_rows
            rows, sets, held = [], [], 0
            bands, sketch = np.zeros((batch.num_rows, BANDS), np.uint64), np.zeros((batch.num_rows, len(PLANES) + len(ODD)), np.int64)

            def sign(rows=rows, sets=sets, bands=bands, sketch=sketch):
                if rows:
                    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    sig = superminhash(flat, owner, len(sets))
                    bands[rows], sketch[rows] = band_keys(sig), np.concatenate((planes(sig), odd_sketch(flat, owner, len(sets))), axis=1)
                    rows.clear()
                    sets.clear()

            for row, t in token_sets(batch["text"], shingle):
                n[row] = len(t)
                digest[row] = hashlib.blake2b(t.tobytes(), digest_size=16).digest()
                if 100 * len(t) >= percent * (len(t) + 1):  # smaller sets link with equal ones only
                    rows.append(row)
                    sets.append(t)
                    held += len(t)
                if held > 1 << 16:
                    sign()
                    held = 0
            sign()
            signed = 100 * n >= percent * (n + 1)
            as_lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel().view(np.int64)), v.shape[1]).cast(pa.list_(pa.int64()))
            lists = [pc.if_else(pa.array(signed), as_lists(v), pa.nulls(len(n), pa.list_(pa.int64()))) for v in (bands, sketch)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(digest, pa.binary()), *lists], ["doc_id", "n", "digest", "bands", "sketch"])

    return describe


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a batch: each id but the smallest of its group, with that smallest one."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root=root) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        edges = [(x, find(x)) for x in root]
        edges = [e for e in edges if e[0] != e[1]]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])


def _grouped(links: DataFrame) -> DataFrame:
    return connected_components(links.mapInArrow(_contract, "u long, v long"))


def _best(star: DataFrame) -> DataFrame:
    """star (id, hub, shared) -> (a, b): each id b with the hub a that shares the most bands."""
    best = star.groupBy("id").agg(F.min_by("hub", F.struct(-F.col("shared"), "hub")).alias("a"))
    return best.select("a", F.col("id").alias("b"))


def _apart(met: DataFrame, label: DataFrame) -> DataFrame:
    """met (band, id) -> band, id, c: those in bands whose members are in different groups c."""
    now = met.select("band", "id").join(label.select("id", "component"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    apart = now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    return now.join(apart, "band")


def _may_link(percent: int) -> Column:
    """Whether sizes and sketches of the members m and o allow a link."""
    pair = lambda k: F.col(f"m.s{k}").bitwiseXOR(F.col(f"o.s{k}"))
    agree = sum(F.bit_count(F.bitwise_not(pair(k)).bitwiseAND(F.bitwise_not(pair(k + 2)))) for k in (0, 1))
    differ = sum(F.bit_count(pair(k)) for k in ODD)
    sizes = F.col("m.n") + F.col("o.n")
    return (F.least("m.n", "o.n") * 100 >= F.greatest("m.n", "o.n") * percent) & (differ * (100 + percent) <= sizes * (100 - percent)) & (agree >= least_agreement(percent))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, class_id, component_id, kept for each row.

    class_id: smallest doc_id with an equal set; component_id: smallest doc_id reachable by links;
    kept: this is the document that stays of its group."""
    docs = docs.select("doc_id", "text")
    X.small_batches(docs.sparkSession)
    described = X.cut(docs.mapInArrow(_describe(shingle, percent), "doc_id long, n long, digest binary, bands array<long>, sketch array<long>"), "signed")
    classes = X.cut(_classes(described.select("doc_id", "n", "digest")), "classes")
    own = described.where("bands is not null and doc_id is not null")
    # one row of each set; copies share their signature
    reps = X.cut(own.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("r")).select(F.col("r.doc_id").alias("id"), "r.n", "r.bands", "r.sketch"), "reps")

    member = reps.select("id", F.explode("bands").alias("band"))
    hub = member.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("band", "hub")
    met = X.cut(member.join(hub, "band"), "met")
    star = met.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("shared"))
    best = X.cut(_best(star.where("shared > 1")), "pairs")
    # texts of one doc_id belong together
    held = classes.where("doc_id is not null and class_id is not null").select("doc_id", "class_id")
    tied = held.join(held.groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi"), "doc_id").select(F.col("class_id").alias("u"), F.col("lo").alias("v"))
    links = X.cut(_links(best, docs, shingle, percent).unionByName(tied), "links")
    label = _grouped(links)

    marks = [F.col("sketch")[k].alias(f"s{k}") for k in range(len(PLANES) + len(ODD))]
    open_ = X.cut(_apart(met, label).join(reps.select("id", "n", *marks), "id"), "members")
    m, o = open_.alias("m"), open_.alias("o")

    # those that did not link with the smallest id get a second star
    centre = open_.groupBy("band").agg(F.min_by(F.struct(*open_.columns), F.xxhash64("id")).alias("h")).select("h.*").alias("o")
    near = m.join(centre, (F.col("m.band") == F.col("o.band")) & (F.col("m.c") != F.col("o.c")) & _may_link(percent)).groupBy(F.col("m.id").alias("id"), F.col("o.id").alias("hub")).agg(F.count("*").alias("shared"))
    second = X.cut(_best(near).join(best, ["a", "b"], "left_anti"), "pairs")
    links = X.cut(links.unionByName(_links(second, docs, shingle, percent)), "links")
    label = _grouped(links)

    rest = _apart(open_.select("band", "id"), label).select("band", "id", F.col("c").alias("now"))
    rest = X.cut(open_.join(rest, ["band", "id"]).drop("c").withColumnRenamed("now", "c"), "members")
    m, o = rest.alias("m"), rest.alias("o")
    more = m.join(o, (F.col("m.band") == F.col("o.band")) & (F.col("m.c") != F.col("o.c")) & (F.col("m.id") < F.col("o.id")) & _may_link(percent))
    more = more.select(F.col("m.id").alias("a"), F.col("o.id").alias("b")).distinct()
    done = best.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = X.cut(more.join(done, ["a", "b"], "left_anti"), "pairs")
    if more.head(1):
        label = _grouped(links.unionByName(_links(more, docs, shingle, percent)))
    out = classes.join(label.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    lone = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", lone))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: one document of each group of near duplicates, with all its columns."""
    kept = near_duplicates(docs, shingle, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def op11_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
