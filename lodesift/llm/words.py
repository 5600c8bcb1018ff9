"""Words, shingles and windows of whole Arrow batches as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Every function works on
all texts of a slice at once; a slice holds whole texts of about ``SLICE_BYTES``,
or one longer text.  Hashes are 64 bits wide: polynomials over random byte
values, then mixed, so equal words always have equal hashes and different words
share one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Bytes that are hashed at once: numbers of 8 bytes stand for each of them.
HASH_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers[key][:n]


@dataclass
class Texts:
    """Whole texts: their bytes, and where each begins (``len(texts) + 1`` offsets)."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)


def texts_of(column: pa.Array) -> Texts:
    """A string column as bytes and offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[o[0]:o[-1]], o - o[0])


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows of ``batch`` in order, in pieces of about ``size`` bytes of ``column``."""
    at, n = 0, batch.num_rows
    whole = texts_of(batch.column(batch.schema.get_field_index(column)))
    while at < n:
        to = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + size, side="right")) - 1)
        o = whole.offsets[at:to + 1]
        yield batch.slice(at, to - at), Texts(whole.data[o[0]:o[-1]], o - o[0])
        at = to


@dataclass
class Words:
    """Words of all texts in order; text ``i`` has the words ``first[i] .. first[i + 1] - 1``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: Texts, space: np.ndarray = _SPACE) -> Words:
    """Runs of bytes for which ``space`` is false, none across texts."""
    inside = ~space[texts.data]
    m = len(inside)
    begins, ends = inside.copy(), inside.copy()
    if m:
        cut = texts.offsets[(texts.offsets > 0) & (texts.offsets < m)]
        before = np.concatenate(([False], inside[:-1]))
        before[cut] = False
        begins &= ~before
        after = np.concatenate((inside[1:], [False]))
        after[cut - 1] = False
        ends &= ~after
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, texts.offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes; spans come in the order of their starts."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + HASH_BYTES)))
        low, high = int(starts[at]), max(int(ends[at:to].max()), int(starts[at]) + 1)
        begin, end = starts[at:to] - low, ends[at:to] - low
        total = _BYTES[data[low:high]]
        total *= powers(_BASE, high - low)
        np.cumsum(total, out=total)
        h = total[end - 1] - np.where(begin > 0, total[begin - 1], np.uint64(0))
        h *= powers(pow(_BASE, -1, 2**64), high - low)[begin]
        out[at:to] = mix(h)
        at = to
    return out


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    return span_hashes(texts.data, words.starts, words.ends)


def shingles(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and the text of each.

    A text with fewer words gives its whole sequence as one; none gives none.
    """
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(n) - n
    at = words.first[:-1][owner] + np.arange(len(owner)) - first[owner]
    length = np.minimum(counts, size)[owner].astype(np.uint64)
    h = mix(length + _C)
    for k in range(size):
        has = length > k
        nxt = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else hashes
        h = np.where(has, mix(h * _A + nxt * _B + np.uint64(k)), h)
    return h, owner


def windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of every ``size`` consecutive words of one text, and the index of the first word."""
    counts = words.counts
    n = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(n) - n
    at = words.first[:-1][owner] + np.arange(len(owner)) - first[owner]
    found = []
    for base, seed in ((int(_A), 1), (int(_B), 2)):
        c = mix(hashes + np.uint64(seed)) * powers(base, len(hashes))
        np.cumsum(c, out=c)
        h = c[at + size - 1] - np.where(at > 0, c[at - 1], np.uint64(0)) if len(at) else c[:0]
        found.append(mix(h * powers(pow(base, -1, 2**64), len(hashes) + 1)[at]) if len(at) else c[:0])
    return found[0], found[1], at
