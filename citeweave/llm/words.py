"""Numpy helpers over Arrow text columns: word bounds, word hashes, shingles.

A word is ``[^\\x20\\x09-\\x0D]+``.  Everything works on the UTF-8 bytes of a
whole batch at once; a text is never turned into Python strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for at, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[at] = np.cumprod(p)
    return _powers[0], _powers[1]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``values[start:end]`` of small integers."""
    n = len(values)
    up, down = _base_powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:n]
    np.cumsum(terms, out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start]
               + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n+1 offsets of the texts.
    A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20):
    """Cut a batch into runs of rows holding about ``max_bytes`` of text each
    (one row at least), so that memory follows the bytes, not the row count."""
    if batch.num_rows == 0:
        return
    _, offs = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Word bounds and 64-bit word hashes of a run of texts.

    ``start``/``end`` are byte positions in ``data``; words of text ``d`` are
    ``first[d]:first[d + 1]``; ``hash`` (unless not ``hashed``) depends on the word's bytes alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True,
                 space: np.ndarray = SPACE, hashed: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~space[self.data]
        starts, ends = inside.copy(), inside.copy()
        if n:
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            full = offsets[1:] > offsets[:-1]
            heads, tails = offsets[:-1][full], offsets[1:][full] - 1
            starts[heads] = inside[heads]
            ends[tails] = inside[tails]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            self.hash = span_hash(self.data, self.start, self.end)

    @classmethod
    def of(cls, column: pa.Array, lower: bool = True, hashed: bool = True) -> "Words":
        return cls(*text_bytes(column), lower=lower, hashed=hashed)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``k`` words of each text, in order, and their
        n+1 offsets; a text of 1 to k-1 words has its whole sequence as one."""
        counts = np.diff(self.first)
        many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        offs = np.zeros(len(many) + 1, dtype=np.int64)
        np.cumsum(many, out=offs[1:])
        out = np.zeros(int(offs[-1]), dtype=np.uint64)
        n = len(self.hash)
        if n >= k:
            acc = np.zeros(n - k + 1, dtype=np.uint64)
            for j in range(k):
                acc = (acc + self.hash[j:n - k + 1 + j]) * np.uint64(0x9FB21C651E98DF25)
                acc ^= acc >> np.uint64(29)
            doc = np.repeat(np.arange(len(counts)), counts)
            whole = np.flatnonzero(doc[:n - k + 1] == doc[k - 1:]) if n else []
            out[np.repeat(counts >= k, many)] = mix(acc[whole])
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            h = np.uint64(counts[d])
            for w in self.hash[self.first[d]:self.first[d + 1]]:
                h = mix(np.asarray([h ^ w], dtype=np.uint64))[0]
            out[offs[d]] = h
        return out, offs


class HashIndex:
    """Positions of distinct uint64 keys by open addressing, for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        at = self._home(keys)
        found = self.slots[at]
        if not len(self.keys):
            return found
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.slots[at[left]]
            left = left[(found[left] >= 0) & (self.keys[found[left]] != keys[left])]
        return found


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each run, end to end."""
    total = int(counts.sum())
    heads = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - heads, counts)
