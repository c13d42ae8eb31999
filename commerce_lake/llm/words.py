"""Vectorised word splitting and hashing for text columns inside Arrow tasks.

A *word* is a maximal run of bytes other than space and 0x09-0x0D, which in
UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` on code points.  Nulls count as
empty texts.  Work is done on slices of about ``SLICE_BYTES`` so that memory is
bounded by the longest single text, never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_ROLL = 0xC2B2AE3D27D4EB4F | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte that is no letter.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64's public finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the tables are kept while small."""
    have = _tables.get(base)
    if have is not None and len(have[0]) >= n:
        return have
    size = max(n, 1 << 12)
    inverse = pow(base, -1, 1 << 64)
    pair = []
    for b in (base, inverse):
        a = np.full(size, b, dtype=np.uint64)
        a[0] = 1
        pair.append(np.multiply.accumulate(a))
    out = (pair[0], pair[1])
    if size <= 2 * SLICE_BYTES + 1:
        _tables[base] = out
    return out


class Slice:
    """Words of consecutive texts: spans into ``buf`` and the words of each text."""

    __slots__ = ("first", "buf", "bounds", "starts", "ends", "word_of")

    def __init__(self, first: int, buf: np.ndarray, bounds: np.ndarray, outside: np.ndarray = _SPACE):
        self.first, self.buf, self.bounds = first, buf, bounds
        inside = ~outside[buf]
        n = len(buf)
        cut = np.zeros(n + 1, dtype=bool)
        cut[bounds] = True
        prev = np.empty(n, dtype=bool)
        if n:
            prev[0] = False
            prev[1:] = inside[:-1]
        start = inside & (~prev | cut[:n])
        nxt = np.empty(n, dtype=bool)
        if n:
            nxt[-1] = False
            nxt[:-1] = inside[1:]
        end = inside & (~nxt | cut[1:])
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.word_of = np.searchsorted(self.starts, bounds)  # words of text i: word_of[i]:word_of[i+1]

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1

    def n_words(self) -> np.ndarray:
        return np.diff(self.word_of)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        n = len(self.buf)
        power, inverse = _powers(_BASE, n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False, outside: np.ndarray = _SPACE, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column; ``lower`` folds A-Z only; ``outside`` tells the bytes between words."""
    if isinstance(texts, pa.ChunkedArray):
        first = 0
        for part in texts.chunks:
            for s in slices(part, lower, outside, size):
                s.first += first
                yield s
            first += len(part)
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), len(texts))
        buf = raw[offsets[i] : offsets[j]]
        yield Slice(i, _LOWER[buf] if lower else buf, offsets[i : j + 1] - offsets[i], outside)
        i = j
    if len(raw) > SLICE_BYTES:
        pa.default_memory_pool().release_unused()  # workers live on after a task; memory goes back before the next batch


def windows(h: np.ndarray, word_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every n-word window inside a text.

    Returns (hash, index of the first word, index of the text)."""
    counts = np.maximum(np.diff(word_of) - n + 1, 0)
    total = int(counts.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), text
    before = np.cumsum(counts) - counts
    at = np.arange(total) - np.repeat(before, counts) + np.repeat(word_of[:-1], counts)
    power, inverse = _powers(_ROLL, len(h) + 1)
    run = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=run[1:])
    return mix((run[at + n] - run[at]) * inverse[at]), at, text


class Lookup:
    """Places of hashes in an ascending array of distinct 64-bit hashes, -1 for those it lacks.

    Hashes are spread evenly, so their leading bits tell the place up to a few steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1)
        at = self.first[(h >> self.shift).astype(np.intp)]
        last = len(self.keys) - 1
        np.minimum(at, last, out=at)
        open_ = np.flatnonzero(self.keys[at] < h)
        while len(open_):
            open_ = open_[at[open_] < last]
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < h[open_]]
        return np.where(self.keys[at] == h, at, -1)


def runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array, with the end appended."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
