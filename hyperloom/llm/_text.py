"""Vectorised word and n-gram hashing over Arrow string columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  Every byte is looked up in a table of random
64-bit numbers, multiplied by a power of an odd base and summed up; the difference of two prefix
sums, shifted back by the inverse power, is the hash of any slice.  One pass of a few array
operations therefore hashes all words of a batch, and the same trick over word hashes gives all
k-word windows.  Work is cut into slabs of a quarter of a megabyte at word boundaries, so that memory stays
bounded however long a single text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SLAB = 1 << 18
_BASE, _GRAM_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    table = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64)
    lower = table.copy()
    lower[65:91] = table[97:123]
    return table, lower


_TABLE, _TABLE_LOWER = _tables()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a column of texts, as byte slices of one buffer with their hashes.

    ``data`` bytes, ``offsets`` of the texts in it, ``start`` and ``end`` of each word, ``count`` of
    words per text, ``first`` word of each text, ``doc`` the text of each word, ``hash`` (uint64).
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False, hashed: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):  # no chunk at all
            texts = pa.array([], pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        n = len(texts)
        _, at, data = texts.buffers()
        if n:
            at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        else:
            at = np.zeros(1, np.int64)
        self.data = (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]]
        self.offsets = at - at[0]
        table = _TABLE_LOWER if lower else _TABLE
        starts, ends, hashes = [], [], []
        bounds = self._slabs()
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            s, e, h = self._slab(lo, hi, table, hashed)
            starts.append(s)
            ends.append(e)
            hashes.append(h)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.first = self.first[:-1]
        self.doc = np.repeat(np.arange(n), self.count)
        self.n_docs = n

    def _slabs(self) -> list[int]:
        """Cuts near multiples of the slab size, each at white space or at the start of a text."""
        n, bounds = len(self.data), [0]
        while bounds[-1] + _SLAB < n:
            want = bounds[-1] + _SLAB
            k = int(np.searchsorted(self.offsets, want))
            next_doc = int(self.offsets[k]) if k < len(self.offsets) else n
            at, step = want, 1 << 12
            while at < next_doc:
                hits = np.flatnonzero(_SPACE[self.data[at : min(at + step, next_doc)]])
                if len(hits):
                    at += int(hits[0])
                    break
                at = min(at + step, next_doc)
            bounds.append(at)
        if n:
            bounds.append(n)
        return bounds

    def _slab(self, lo: int, hi: int, table: np.ndarray, hashed: bool):
        part = self.data[lo:hi]
        inside = ~_SPACE[part]
        a, b = np.searchsorted(self.offsets, (lo, hi))
        cuts = self.offsets[a:b] - lo  # texts that begin here
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0]
        ends[cuts - 1] = inside[cuts - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not hashed or not len(s):
            return s + lo, e + lo, np.zeros(0, np.uint64)
        up, down = _power(_BASE, len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[part] * up[: len(part)], out=total[1:])
        return s + lo, e + lo, mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_GRAM_BASE))

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def gram_hash(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of words[i:i+k] for every i; windows may span texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k == 1 and not salt:
        return words
    up, down = _power(_GRAM_BASE, len(words) + 1)
    w = mix(words + np.uint64(salt)) if salt else words
    total = np.empty(len(w) + 1, np.uint64)
    total[0] = 0
    np.cumsum(w * up[: len(w)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + np.uint64(k))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all k-word windows inside a text, and the index of each one's first word."""
    g = gram_hash(words.hash, k)
    if not len(g):
        return g, np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[: len(g)] == words.doc[k - 1 :])
    return g[at], at
