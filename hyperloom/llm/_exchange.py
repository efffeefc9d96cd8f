"""Counting grams across a corpus with few, dense shuffle rows.

Documents are dealt to chunks of bounded size by a hash of their id.  A chunk sorts its distinct gram
hashes, cuts them into hash ranges and sends one packed row per range; a range merges what all chunks
sent and answers each chunk with one number per hash it asked about, in the order it asked.  Compared
with a row per gram this shuffles 3 to 6 bytes per distinct gram instead of 20 to 40, and no gram, however
frequent, weighs more than once per chunk, so hot grams need no salting.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk and distinct grams of a range; both bound a task's memory.  Rows of the exchange number chunks times ranges, so both sizes
#: grow with the square root of the corpus from FROM_BYTES on, up to MOST times; a task then needs up to that many times the memory (about 2 GB).
CHUNK_BYTES, RANGE_GRAMS, FROM_BYTES, MOST = 2 << 20, 1 << 20, 8 << 30, 16


def volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Bytes of text and number of rows, from one narrow scan."""
    r = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(r.b), int(r.n)


def plan_sizes(n_bytes: int) -> tuple[int, int]:
    """Chunks and hash ranges for so many bytes; a word and its space take 5 bytes at least, as a rule."""
    grown = min(MOST, max(1.0, math.sqrt(n_bytes / FROM_BYTES)))
    return max(8, math.ceil(n_bytes / CHUNK_BYTES / grown)), max(8, math.ceil(n_bytes / 5 / RANGE_GRAMS / grown))


def chunk_of(n_chunks: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A chunk by id; rows without an id are spread by their text, rows without a text at random, since they ask for nothing."""
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.col(text)))
    none = F.coalesce(F.octet_length(text), F.lit(0)) == 0
    return F.pmod(F.when(none, F.xxhash64(F.monotonically_increasing_id())).otherwise(key), F.lit(n_chunks)).cast("int")


def chunked(docs: DataFrame, n_chunks: int, *columns: str) -> DataFrame:
    return docs.select(chunk_of(n_chunks).alias("chunk"), *(columns or ("doc_id", "text")))


def hash_bits(n_bytes: int, spare: int) -> int:
    """Bits that hold all grams of a corpus with 2**-spare of them sharing a value with another one."""
    return min(64, math.ceil(math.log2(max(2, n_bytes / 5))) + spare)


def range_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Ranges grow with the hash, so a sorted array falls into slices."""
    return ((h >> np.uint64(40)) * np.uint64(n_ranges)) >> np.uint64(24)


def cuts(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Where each range begins in a sorted array of hashes."""
    return np.searchsorted(range_of(h, n_ranges), np.arange(n_ranges + 1, dtype=np.uint64))


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their bytes, lowest first; planes of zeros nearly vanish in a compressed shuffle."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return len(x).to_bytes(4, "little") + bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    n, width = int.from_bytes(b[:4], "little"), b[4]
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(b, np.uint8, n * width, 5).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending numbers as their first one and the steps between them."""
    if not len(h):
        return pack(h)
    return pack(np.diff(h, prepend=h[:1])) + int(h[0]).to_bytes(8, "little")


def unpack_sorted(b: bytes) -> np.ndarray:
    n, width = int.from_bytes(b[:4], "little"), b[4]
    d = unpack(b)
    if n:
        d = np.cumsum(d, dtype=np.uint64) + np.uint64(int.from_bytes(b[5 + n * width : 13 + n * width], "little"))
    return d


def groups_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each run of equal values, and the run of each index."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(len(sorted_values), bool)
    new[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


def stable_order(h: np.ndarray) -> np.ndarray:
    """The stable sorting order of hashes.  Sorting hash and index in one number is several times faster than argsort; where hashes
    differ only in the bits that the index took, the slow way puts it right."""
    n = len(h)
    low = np.uint64((1 << max(1, n - 1).bit_length()) - 1) if n else np.uint64(0)
    order = (np.sort((h & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    s = h[order]
    return order if (s[1:] >= s[:-1]).all() else np.argsort(h, kind="stable")
