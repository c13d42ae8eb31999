"""SuperMinHash near-duplicate removal against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import brute_components, docs_of, texts

from commerce_lake.llm import op11_minhash_dedup as M
from commerce_lake.llm import words as W


def plain_signature(hashes):
    """Element by element, with a whole permutation each."""
    sig = [2**64 - 1] * M.WIDTH
    for x in hashes:
        order = list(range(M.WIDTH))
        for j in range(M.WIDTH):
            h = int(W.mix(np.array([(x + (j + 1) * M._STEP) % 2**64], np.uint64))[0])
            k = j + ((h >> 40) * (M.WIDTH - j) >> 24)
            order[j], order[k] = order[k], order[j]
            sig[order[j]] = min(sig[order[j]], j << 40 | h & (1 << 40) - 1)
    return sig


def test_signatures_equal_plain_ones():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 7, 50, 300)]
    got = M.superminhash(np.concatenate(sets), np.repeat(np.arange(5), [len(s) for s in sets]), 5)
    assert [g.tolist() for g in got] == [plain_signature(s.tolist()) for s in sets]
    assert (M.superminhash(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1) == M._TOP).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        y = np.concatenate((x[:85], rng.integers(0, 1 << 63, 15).astype(np.uint64)))
        sig = M.superminhash(np.concatenate((x, y)), np.repeat([0, 1], 100), 2)
        off.append((sig[0] == sig[1]).mean() - 85 / 115)
        assert (M.band_keys(sig)[0] == M.band_keys(sig)[1]).any()
    assert abs(np.mean(off)) < 0.02 and np.var(off) < 0.9 * 85 / 115 * 30 / 115 / M.WIDTH  # below that of independent ranks


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, shingle, percent):
    values = texts(200, seed=shingle)
    rows = M.near_duplicates(docs_of(spark, values), shingle, percent).collect()
    want = brute_components(list(enumerate(values)), shingle, percent)
    assert len(rows) == len(values) + 2 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len({c for _, c in want.values()}) < len(want)


def test_groups_of_near_copies_and_chains(spark):
    """A chain whose ends do not link, a family around one text, equal texts, and ids with several texts."""
    rng = random.Random(4)
    line = [f"w{i}" for i in range(80)]
    chain = [[*line]]
    for k in range(12):
        chain.append([*chain[-1][: 6 * k], f"y{k}", *chain[-1][6 * k + 1 :]])
    near = [" ".join(line[:k] + [f"x{rng.random()}"] + line[k + 1 :]) for k in (3, 20, 40, 79) for _ in range(15)]
    values = texts(60) + [" ".join(c) for c in chain] + [" ".join(line)] * 40 + near
    rows = list(enumerate(values))
    two = [(1000, values[75]), (1000, "quite another text of more than four words"), (1001, "quite another text of more than four words"), (1001, "a third one with no link to others at all")]
    want = {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}
    got = M.near_duplicates(spark.createDataFrame(rows + two, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id < 1000} == want
    assert {r.component_id for r in got if r.doc_id >= 1000} == {want[75]}


def test_edges(spark):
    d = docs_of(spark, texts(30)).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    rows = M.near_duplicates(d).collect()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert M.near_duplicates(docs_of(spark, empty=True)).count() == 0
    kept = M.deduplicate(d)
    assert kept.columns == d.columns and kept.where("doc_id is null").count() == 1
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (5, 150, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[n // 7 :], rng.integers(0, 1 << 63, n // 9).astype(np.uint64))))
        a, b = M.odd_sketch(np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]), 2)
        differ = sum(bin(int(p) & 2**64 - 1 ^ int(q) & 2**64 - 1).count("1") for p, q in zip(a, b))
        assert 0 < differ <= len(np.setxor1d(x, y)) or n == 5
