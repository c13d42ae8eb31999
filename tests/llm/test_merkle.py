"""The Merkle manifest and its climb against plain Python."""

import hashlib
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_ops import docs_of, texts

from commerce_lake.llm import op12_merkle_manifest as M
from commerce_lake.llm.queries import ORACLES, QUERIES


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) -> root and (doc_id, leaf, subroot, proof_sha256, folded_root) of each."""

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def path(built, i):
        for level in built[:-1]:
            yield i % 2, level[i ^ 1] if i ^ 1 < len(level) else None
            i //= 2

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in langs}
    built = {g: levels([leaf(*r) for r in trees[g]]) for g in langs}
    top = levels([built[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(trees[g]):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, proof = leaf(*r[:3], r[3] + hit if r[3] is not None else None, r[4]), ""
            for right, s in [*path(built[g], i), *path(top, k)]:
                folded = sha((s or "") + folded if right else folded + (s or ""))
                proof += s or ""
            out.append((r[0], leaf(*r), built[g][-1][0], sha(proof), folded))
    return top[-1][0], out


@pytest.mark.parametrize(("n", "stride", "most"), [(1, 8, 100), (2, 1, 0), (37, 1, 40), (130, 2, 1 << 16), (300, 3, 90), (300, 8, 9)])
def test_manifest(spark, monkeypatch, n, stride, most):
    """most: nodes that may be broadcast, so that the climb changes from shuffles to broadcasts at different levels."""
    monkeypatch.setattr(M, "MOST_BROADCAST", most)
    rows = [(i if i % 11 else None, [None, "", "web"][i % 3], [None, "en", "", "é", "fr"][i % 5 if n > 2 else 1], None if i % 13 == 5 else i % 1000, t) for i, t in enumerate((texts(n) * 3)[:n])]
    rows += rows[3:5] if n > 5 else []
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumn("leaf", F.lit("x")).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    held = M.cut(d.select("doc_id", "lang", M.row_digest().alias("leaf"), M.row_digest(n_chars=tampered).alias("now"), F.monotonically_increasing_id().alias("row")), "leaves")
    manifest = M.manifest_of(held, stride)
    root, want = plain(rows)
    assert manifest.root == root
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = M.verify(spark, manifest, "now").collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "proof_sha256", "folded_root")) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.verified == (r.folded_root == root) and r.root == root for r in got)
    clean = M.verify(spark, M.build(d, stride))
    assert clean.where("verified").count() == len(rows) and len(clean.columns) == 10


def test_levels_are_linked(spark):
    m = M.build(docs_of(spark), stride=1)
    by = {(r.tree, r.level, r.pos): r for r in m.nodes.collect()}
    ends = 0
    for r in by.values():
        up = by.get((r.up_tree, r.up_level, r.up_pos))
        assert (up is None) == (r.up_tree is None)
        ends += up is None
        if up is not None and r.siblings:
            s = r.siblings[0]
            own, other = r.hash.hex(), s.hash.hex() if s.hash else ""
            assert up.hash.hex() == sha(other + own if s.right else own + other)
    assert 1 <= ends <= 2


def test_empty(spark):
    m = M.build(docs_of(spark, empty=True))
    assert m.root is None and M.verify(spark, m).count() == 0


def test_query(spark, duck):
    got = {tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect()}
    assert got == set(duck.execute(ORACLES["op12_merkle_manifest"]).fetchall())
