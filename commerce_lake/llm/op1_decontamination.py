"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are normalised: lower case, every run of characters that are neither
letters nor digits becomes one space.  An item of m characters may differ from a
passage by e = floor(``ERROR`` m) edits, and by no more than the lemma can bound
((m - q) // q).  Within e edits they share at least m + 1 - q - q e character q-grams,
all on diagonals (text position minus item position) less than e + 1 apart.  Shared
q-grams are counted in bands of 2 h diagonals that overlap by h = 2 e + 1, so every
match lies in one of them; bands that meet the bound are verified by alignment
restricted to their diagonals.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each broadcast;
``BLOCKS_A_PASS`` of them share one pass over all documents.  Documents are never shuffled.

Null and empty texts match nothing.  Items shorter than q normalised characters have no
q-gram and match nothing either; items below 40 may differ by fewer than ``ERROR`` m edits,
as the lemma asks for a shared q-gram.
Repeated rows and items each give their rows.  Texts of any length are scanned in
overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shuffle import small_batches

Q = 8
ERROR = 0.1
BLOCK_BYTES = 4 << 20
BLOCKS_A_PASS = 8
PIECE = 1 << 20
_BITS = 22
_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_tables: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """For each code point below 2**16: its lower case if a letter or digit, else a space."""
    if not _tables:
        t = np.full(1 << 16, 32, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalnum():
                t[i] = ord(c.lower()[0])
        _tables.append(t)
    return _tables[0]


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a separator 0, and the place of each separator (and the end)."""
    joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(raw < (1 << 16), _classes()[np.minimum(raw, (1 << 16) - 1)], raw)
    codes[raw == 0] = 0
    gap = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & ((codes[:-1] == 32) | (codes[:-1] == 0)))
    codes = codes[keep]
    trail = np.ones(len(codes), bool)
    trail[:-1] = ~((codes[:-1] == 32) & (codes[1:] == 0))
    if len(codes) and codes[-1] == 32:
        trail[-1] = False
    codes = codes[trail]
    return codes, np.append(np.flatnonzero(codes == 0), len(codes))


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams (q = 8) by doubling."""
    h, step = codes, 1
    for m in _MULTIPLIERS:
        h = h[:-step] * m + h[step:] if len(h) > step else h[:0]
        h = h ^ (h >> np.uint32(15))
        step *= 2
    return h


@dataclass
class Items:
    """A block of benchmark items with the index of their q-grams."""

    ids: list
    codes: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    width: np.ndarray
    filter: np.ndarray
    grams: np.ndarray
    at: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @property
    def reach(self) -> int:
        return max((len(c) for c in self.codes), default=0) + 4 * int(self.width.max() if len(self.width) else 0) + 8


def index_items(rows: list[tuple[int, str | None]], error: float = ERROR) -> Items:
    codes, at = normalise([t for _, t in rows])
    kept = [(i, codes[a + 1 : b]) for (i, _), a, b in zip(rows, at, at[1:]) if b - a - 1 >= Q]
    m = np.array([len(c) for _, c in kept], np.int64)
    e = np.minimum(np.floor(error * m).astype(np.int64), (m - Q) // Q)
    grams = [gram_hashes(c) for _, c in kept]
    g = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
    item = np.repeat(np.arange(len(kept)), [len(x) for x in grams])
    place = np.concatenate([np.arange(len(x)) for x in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(g, kind="stable")
    g, item, place = g[order], item[order], place[order]
    own, first = np.unique(g, return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[own >> np.uint32(32 - _BITS)] = True
    return Items([i for i, _ in kept], [c for _, c in kept], e, m + 1 - Q - Q * e, 2 * e + 1, bitmap, own, np.append(first, len(g)), item, place)


def candidates(codes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, first diagonal) of the bands whose shared q-grams meet the item's bound."""
    h = gram_hashes(codes)
    p = np.flatnonzero(items.filter[h >> np.uint32(32 - _BITS)])
    if not len(p) or not len(items.grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.minimum(np.searchsorted(items.grams, h[p]), len(items.grams) - 1)
    ok = items.grams[g] == h[p]
    p, g = p[ok], g[ok]
    n = items.at[g + 1] - items.at[g]
    where = np.arange(int(n.sum())) + np.repeat(items.at[g] - (np.cumsum(n) - n), n)
    item = items.item[where]
    diagonal = np.repeat(p, n) - items.place[where]
    band = diagonal // items.width[item]
    key = item << 40 | (band + (1 << 30))
    own, count = np.unique(key, return_counts=True)
    # a band of 2 h diagonals holds two neighbours of h
    prior = np.zeros(len(own), np.int64)
    if len(own):
        follows = np.concatenate(([False], own[1:] == own[:-1] + 1))
        prior[follows] = count[np.flatnonzero(follows) - 1]
    item, band = own >> 40, (own & ((1 << 40) - 1)) - (1 << 30)
    lower = count + prior >= items.bound[item]  # the band that ends here
    upper = ~np.concatenate((own[1:] == own[:-1] + 1, [False])) & (count >= items.bound[item]) if len(own) else np.zeros(0, bool)
    item_, start = np.concatenate((item[lower], item[upper])), np.concatenate((band[lower] - 1, band[upper]))
    return item_, start * items.width[item_]


def align(item: np.ndarray, regions: np.ndarray, width: int) -> np.ndarray:
    """Fewest edits between the item and any passage on the band's diagonals.

    regions: a row for each candidate, from its first diagonal on, len(item) + width long."""
    cost = np.zeros((len(regions), width), np.int32)
    step = np.arange(width, dtype=np.int32)
    for i in range(len(item)):
        new = cost + (regions[:, i : i + width] != item[i])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - step, axis=1) + step
    return cost.min(1)


def scan(texts: list[str | None], items: Items) -> list[tuple[int, int, int]]:
    """(text, item, edits) of every text that holds an item within its budget."""
    best: dict[tuple[int, int], int] = {}
    if not items.ids:
        return []
    codes, at = normalise(texts)
    for a in range(0, len(codes), PIECE):
        piece = codes[a : a + PIECE + items.reach]
        open_: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, start in zip(*(x.tolist() for x in candidates(piece, items))):
            c, width = items.codes[item], 2 * int(items.width[item])
            lo, hi = max(start, 0), min(start + len(c) + width, len(piece))
            first = int(np.searchsorted(at, a + lo, side="right")) - 1
            while first < len(texts) and at[first] - a < hi:
                f, t = max(lo, int(at[first]) + 1 - a), min(hi, int(at[first + 1]) - a)
                if t - f >= len(c) - items.edits[item] and best.get((first, item), 1) > 0:
                    if _holds(piece[f:t], c):
                        best[first, item] = 0
                    else:
                        region = np.zeros(len(c) + width, np.uint32)
                        region[f - start : t - start] = piece[f:t]
                        open_.setdefault(item, []).append((first, region))
                first += 1
        for item, rows in open_.items():
            rows = [r for r in rows if best.get((r[0], item), 1) > 0]
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                edits = align(items.codes[item], np.stack([r for _, r in some]), 2 * int(items.width[item]))
                for (text, _), n in zip(some, edits.tolist()):
                    if n <= items.edits[item]:
                        best[text, item] = min(n, best.get((text, item), n))
    return [(t, i, n) for (t, i), n in sorted(best.items())]


def _holds(region: np.ndarray, item: np.ndarray) -> bool:
    raw, want, at = region.tobytes(), item.tobytes(), -1
    while (at := raw.find(want, at + 1)) >= 0:
        if at % 4 == 0:
            return True
    return False


SLICE_CHARS = 1 << 20


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _match(held: list):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in _groups(b["text"].to_pylist()):
                for items in (h.value for h in held):
                    rows = scan(some, items)
                    length = [len(items.codes[i]) for _, i, _ in rows]
                    columns = [
                        b["doc_id"].take(pa.array([first + r[0] for r in rows], pa.int64())),
                        pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([1 - r[2] / m for r, m in zip(rows, length)], pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "similarity"])

    return match


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items, in blocks of at most ``most`` bytes (or one item)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = 4 * len(r.text or "")
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def _passes(spark: SparkSession, benchmark: DataFrame, error: float) -> Iterator[list]:
    """Broadcast indexes of the benchmark's blocks, ``BLOCKS_A_PASS`` for each pass over the documents."""
    held = []
    for block in blocks(benchmark):
        held.append(spark.sparkContext.broadcast(index_items(block, error)))
        if len(held) == BLOCKS_A_PASS:
            yield held
            held = []
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, edits, similarity of every match."""
    spark = docs.sparkSession
    small_batches(spark)
    schema, out = "doc_id long, item_id long, edits long, similarity double", None
    for held in _passes(spark, benchmark, error):
        found = docs.select("doc_id", "text").mapInArrow(_match(held), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """The documents without a match, with all their columns."""
    kept = docs
    small_batches(docs.sparkSession)
    for held in _passes(docs.sparkSession, benchmark, error):
        kept = kept.mapInArrow(_keep(held), kept.schema)
    return kept


def _keep(held: list):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.zeros(b.num_rows, bool)
            for first, some in _groups(b["text"].to_pylist()):
                for items in (h.value for h in held):
                    for t, _, _ in scan(some, items):
                        hit[first + t] = True
            yield b.filter(pa.array(~hit))

    return keep


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
