"""A Merkle manifest of a table, and proofs by a recursive climb.

A leaf is the digest of a row's fields.  The rows of one language form a tree: leaves
ascend by doc_id, and every two consecutive nodes (the last one alone where their number is
odd) become their digest until one node remains, the language's subroot.  The subroots,
ordered by language (null first, then by bytes), form the top tree in the same way; what remains is
the root of the table.

Rows are numbered inside their language without gathering it: they are sorted over range
partitions, and the counts of the partitions give each its offset.  Levels are built
``STRIDE`` at a time, in groups of 2^STRIDE nodes of known size, and stored as node rows:
a node of a built level holds its digest, its siblings up to the next built level and the
key of the node there, its parent.  A subroot's row leads on into the top tree; the root has no parent.
With a stride of one, every level has its rows; a stride of eight takes an eighth of the steps.

The climb is a recursive common table expression over these rows.  It starts from
(row, digest of the row as it is now) and in each step joins the row's node, appends its siblings to
the proof and folds them into the digest.  A row is verified if its folded digest is the root.

Rows that repeat a doc_id (or have none, which come first) are ordered by digest; equal rows
are leaves of their own.  Null fields have a digest of their own and differ from empty ones.
An empty table has no root and no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shuffle import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STRIDE = 8
#: Nodes of the upper levels that are broadcast to the climbing rows: about 3 MB.
MOST_BROADCAST = 1 << 12
#: The top tree; languages have the numbers from 0.
TOP = -1


class Manifest(NamedTuple):
    """leaves: row, doc_id, tree, pos, leaf; trees: tree, lang, n, subroot; nodes: the stored levels."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    root: str | None


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def row_digest(**changed: Column) -> Column:
    """The leaf of a row: each field as its length in bytes, a colon and its value, or a dash for null."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*map(field, FIELDS)))


def numbered(df: DataFrame, group: str | None, *order: str) -> DataFrame:
    """df with ``pos``: the number from 0 of each row in its group, by the order; no group is gathered."""
    by = [*([group] if group else []), *order]
    dealt = cut(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by]).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    key = F.col(group) if group else F.lit(0)
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_group", key)
    edges = dealt.groupBy("_part", "_group").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a row for each part that a group reaches into
    w = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = edges.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    before = before.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), "_first", "_before")
    placed = dealt.join(before, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return placed.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"))


def _height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _levels(hashes: Column, steps: Column) -> Column:
    """All levels of a group: its nodes, then each level above them."""
    pair = lambda level: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1)), lambda i: digest(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))))
    grown = F.aggregate(F.sequence(F.lit(1), steps), F.array(hashes), lambda all_, _: F.concat(all_, F.array(pair(F.element_at(all_, -1)))))
    return F.when(steps > 0, grown).otherwise(F.array(hashes))


def _build(nodes: DataFrame, trees: DataFrame, stride: int) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, pos, hash), trees (tree, n) -> stored node rows, and (tree, hash) of what remains of each tree."""
    sizes = trees.select("tree", _height(F.col("n")).alias("height"))
    highest = trees.agg(F.max(_height(F.col("n")))).first()[0] or 0
    rows, tops = None, None
    for level in range(0, highest + 1, stride):
        grouped = nodes.groupBy("tree", F.shiftright("pos", stride).alias("above")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("of"))  # 2^stride nodes at most
        grouped = grouped.join(sizes, "tree").withColumn("steps", F.least(F.lit(stride), F.col("height") - level)).withColumn("levels", _levels(F.col("of.hash"), F.col("steps")))
        grouped = cut(grouped.select("tree", "above", "steps", "height", "of", "levels"), "levels")
        bit = lambda i, j: F.call_function("shiftright", i, j)
        beside = lambda i, j: F.struct(bit(i, j).bitwiseAND(F.lit(1)).alias("right"), F.unhex(F.get(F.get(F.col("levels"), j), bit(i, j).bitwiseXOR(F.lit(1)))).alias("hash"))
        path = lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda j: F.when(j < F.col("steps"), beside(i, j))), lambda s: s.isNotNull())
        child = F.transform("of", lambda c: F.struct(c["pos"].alias("pos"), F.unhex(c["hash"]).alias("hash"), path(c["pos"].bitwiseAND(F.lit((1 << stride) - 1)).cast("int")).alias("siblings")))
        done = F.col("height") == level + F.col("steps")
        up_to = lambda c: F.when(~done, c)
        up = grouped.select("tree", F.lit(level).alias("level"), up_to(F.col("tree")).alias("up_tree"), up_to(level + F.col("steps")).alias("up_level"), up_to(F.col("above")).alias("up_pos"), F.explode(child).alias("c"))
        up = up.select("tree", "level", "c.pos", "c.hash", "c.siblings", "up_tree", "up_level", "up_pos")
        last = grouped.select("tree", F.col("above").alias("pos"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), (F.col("height") == level + F.col("steps")).alias("done"))
        rows = up if rows is None else rows.unionByName(up)
        top = last.where("done").select("tree", "hash")
        tops = top if tops is None else tops.unionByName(top)
        nodes = last.where("not done").select("tree", "pos", "hash")
        sizes = sizes.where(F.col("height") > level + stride)
    return rows, tops


def build(docs: DataFrame, stride: int = STRIDE) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text); further columns take no part."""
    rows = cut(docs.select("doc_id", "lang", row_digest().alias("leaf"), F.monotonically_increasing_id().alias("row")), "leaves")
    return manifest_of(rows, stride)


def manifest_of(rows: DataFrame, stride: int = STRIDE) -> Manifest:
    """The manifest of stored rows (doc_id, lang, leaf, row and any others, which its leaves keep)."""
    placed = cut(numbered(rows, "lang", "doc_id", "leaf", "row"), "placed")
    langs = cut(numbered(placed.groupBy("lang").agg(F.count("*").alias("n")), None, "lang").withColumnRenamed("pos", "tree"), "trees")
    leaves = cut(placed.join(langs.select(F.col("lang").alias("_lang"), "tree"), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang", "lang"), "leaves")
    stored, subroots = _build(leaves.select("tree", "pos", F.col("leaf").alias("hash")), langs, stride)
    subroots = cut(subroots, "subroots")
    top = langs.agg(F.lit(TOP).cast("long").alias("tree"), F.count("*").alias("n"))
    over, root = _build(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash"), top.where("n > 0"), stride)
    # a subroot is a leaf of the top tree
    into = lambda top_, own: F.when(F.col("up_tree").isNull(), top_).otherwise(F.col(own)).alias(own)
    stored = stored.select("tree", "level", "pos", "hash", "siblings", into(F.lit(TOP).cast("long"), "up_tree"), into(F.lit(0), "up_level"), into(F.col("tree"), "up_pos"))
    nodes = cut(stored.unionByName(over), "nodes")
    found = root.first()
    return Manifest(leaves, langs.join(subroots.withColumnRenamed("hash", "subroot"), "tree"), nodes, found.hash if found else None)


_CLIMB = """
WITH RECURSIVE climb (row, tree, level, pos, folded, proof) AS (
  SELECT row, tree, level, pos, folded, proof FROM {starts}
  UNION ALL
  SELECT /*+ HINT */ c.row, n.up_tree, n.up_level, n.up_pos,
         aggregate(n.siblings, c.folded, (f, s) -> CASE WHEN s.hash IS NULL THEN sha2(f, 256) WHEN s.right = 1 THEN sha2(concat(lower(hex(s.hash)), f), 256) ELSE sha2(concat(f, lower(hex(s.hash))), 256) END),
         aggregate(n.siblings, c.proof, (p, s) -> concat(p, coalesce(s.hash, X'')))
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos
)
SELECT * FROM climb WHERE tree IS NULL OR tree = -1 AND {until} < 64 OR level >= {until}
"""


def climb(spark: SparkSession, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """starts (row, tree, pos, folded) -> row, folded (at the root), proof_sha256 (of its siblings from below).

    Near the top all rows meet at few nodes: the levels that have at most MOST_BROADCAST nodes together are
    broadcast to the rows, the levels below meet them in a shuffle, where a node has few rows."""
    counts = {r.level: r.n for r in nodes.where(F.col("tree") != TOP).groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row a stored level
    over = nodes.where(F.col("tree") == TOP).count()
    high = [k for k in sorted(counts) if sum(n for j, n in counts.items() if j >= k) + over <= MOST_BROADCAST]
    until = min(high, default=max(counts, default=0) + 1)
    low = (F.col("tree") != TOP) & (F.col("level") < until)
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # the rows of all steps count, and these are as many as the table has, times the steps
    try:
        at = starts.select("row", "tree", F.lit(0).alias("level"), "pos", "folded", F.lit(b"").alias("proof"))
        if until:
            at = cut(spark.sql(_CLIMB.replace("HINT", "SHUFFLE_MERGE(n)"), starts=at, nodes=nodes.where(low), until=until), "climbed")
        hint = "BROADCAST(n)" if over <= MOST_BROADCAST else "SHUFFLE_MERGE(n)"
        done = spark.sql(_CLIMB.replace("HINT", hint), starts=at, nodes=nodes.where(~low), until=64)
        return cut(done.select("row", "folded", digest(F.lower(F.hex("proof"))).alias("proof_sha256")), "climbed")
    finally:
        spark.conf.set(key, before)


def verify(spark: SparkSession, manifest: Manifest, now: str = "leaf") -> DataFrame:
    """The manifest's leaves with subroot, root, proof_sha256, folded_root and verified; ``now`` names the column with each row's present digest."""
    leaves = manifest.leaves
    up = climb(spark, leaves.select("row", "tree", "pos", F.col(now).alias("folded")), manifest.nodes)
    out = leaves.join(up, "row").join(manifest.trees.select("tree", "subroot"), "tree")
    root = F.lit(manifest.root).cast("string")
    return out.select(*leaves.columns, "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = cut(docs.select("doc_id", "lang", row_digest().alias("leaf"), row_digest(n_chars=tampered).alias("now"), F.monotonically_increasing_id().alias("row")), "leaves")
    return verify(spark, manifest_of(rows), "now").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE_SQL = """
WITH RECURSIVE step (i, k, v) AS (SELECT i, 0, i FROM range(256) r (i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 7 = 0 AS hit FROM documents, tab),
f AS (SELECT doc_id, lang, n_chars, hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
      sha256(head || coalesce(strlen((n_chars + hit::INTEGER)::VARCHAR) || ':' || (n_chars + hit::INTEGER), '-') || tail) AS now FROM f),
tree AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM l GROUP BY lang),
leaves AS (SELECT doc_id, leaf, now, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l JOIN tree ON l.lang IS NOT DISTINCT FROM tree.lang),
ht AS (SELECT tree, CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END AS height FROM (SELECT tree, n FROM tree UNION ALL SELECT -1, count(*) FROM tree)),
low (tree, level, pos, h) AS (SELECT tree, 0, pos, leaf FROM leaves UNION ALL SELECT low.tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low JOIN ht USING (tree) WHERE level < height GROUP BY low.tree, level, pos // 2),
sub AS (SELECT tree, h AS subroot FROM low JOIN ht USING (tree) WHERE level = height),
top (tree, level, pos, h) AS (SELECT -1, 0, tree, subroot FROM sub UNION ALL SELECT top.tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top JOIN ht USING (tree) WHERE level < height GROUP BY top.tree, level, pos // 2),
rt AS (SELECT h AS root FROM top JOIN ht USING (tree) WHERE level = height),
node AS (SELECT * FROM low UNION ALL SELECT * FROM top),
climb (doc_id, leaf, own, tree, level, pos, folded, proof) AS (SELECT doc_id, leaf, tree, tree, 0, pos, now, '' FROM leaves UNION ALL
 SELECT c.doc_id, c.leaf, c.own, CASE WHEN c.level = height THEN -1 ELSE c.tree END, CASE WHEN c.level = height THEN 0 ELSE c.level + 1 END, CASE WHEN c.level = height THEN c.tree ELSE c.pos // 2 END,
  CASE WHEN c.level = height THEN folded WHEN s.h IS NULL THEN sha256(folded) WHEN c.pos % 2 = 1 THEN sha256(s.h || folded) ELSE sha256(folded || s.h) END,
  CASE WHEN c.level = height THEN proof ELSE proof || coalesce(s.h, '') END
 FROM climb c JOIN ht USING (tree) LEFT JOIN node s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.level < height OR c.tree >= 0)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb JOIN ht USING (tree) JOIN sub ON sub.tree = own, rt WHERE climb.tree = -1 AND climb.level = height
"""
