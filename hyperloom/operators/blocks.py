"""Triangles by groups of vertices and edges by blocks of vertices, so that wedges are closed where they are listed and never travel.

Triangles: vertices are dealt to p groups by a hash.  A task for three groups (or for two, with the triangles inside them) gets the pieces of hyperedges in
its groups, so it has all edges among them and lists the triangles that have a vertex in each.  An edge goes to p - 1 tasks, whatever its ids are, and a task
has 6 / p^2 of the edges; tasks run in rounds, so the pieces of a round alone are on disk.  Triples that a hyperedge holds lie in one piece.
Edges: vertices are cut into blocks by ranges of ids.  A hyperedge goes to the blocks of its members, so a block knows all neighbours of its own vertices.
It counts the edges from them; degrees of other blocks' vertices and counts of cross triangles come to it packed.
"""

import struct
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Pairs of members that a block should hold, and wedges that are closed at once.
PAIRS, WEDGES, CELLS = 1_000_000, 500_000, 2_000_000
#: Edges whose counts go in one row; rows of tens of MB cost an executor several times their size.
PART = 50_000
#: Rows that are dealt to tasks at once; more of them pack better.
DEALT = 50_000

#: kind 0: hyperedges (a: sizes, b, c: members); 1: another block's vertex (a: all its neighbours, for four-cycles); 2: an own vertex (deg), or one that
#: others ask for; 3: counts of edges (a: u, b: v, c: cross triangles); 4: weights of edges (a: u, b: v, c: weights); 5: degrees (a: v, b: degrees).
_ROW = "graph string, blk int, kind int, v long, deg long, a binary, b binary, c binary"
_NAMES = ["graph", "blk", "kind", "v", "deg", "a", "b", "c"]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 3
CROSS = "graph string, x long, y long, z long, dx long, dy long, dz long"
WEIGHTED = CROSS + ", w_xy double, w_xz double"
SUMS = "graph string, x long, s double"
CENSUS = "graph string, n long, tau long"
CYCLES = "graph string, u long, v long, t4 long"
TABLE = "graph string, u long, v long, nhy long, hsum long, hmax long, t long, covn long, copies long, du long, dv long"


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as offsets from the least one, in as few bytes as they need, first all lowest bytes and so on, compressed."""
    x = np.asarray(x, np.int64)
    low = int(x.min()) if len(x) else 0
    d = (x - low).view(np.uint64)
    k = max(1, -(-int(d.max()).bit_length() // 8)) if len(x) else 1
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T
    return struct.pack("<qqb", len(x), low, k) + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    n, low, k = struct.unpack("<qqb", b[:17])
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :k] = np.frombuffer(pa.Codec("zstd").decompress(b[17:], n * k, asbytes=True), np.uint8).reshape(k, n).T
    return out.view("<i8").ravel().astype(np.int64, copy=False) + low


def _pack_sets(size: np.ndarray, mem: np.ndarray) -> dict[str, list[bytes]]:
    """Ascending sets: their sizes, first members (as steps; sets are put in their order) and gaps."""
    off = np.cumsum(size) - size
    order = np.argsort(mem[off], kind="stable")
    mem, size = mem[_slices(off[order], size[order])], size[order]
    off = np.cumsum(size) - size
    rest = np.ones(len(mem), bool)
    rest[off] = False
    return {"a": [_pack(size)], "b": [_pack(np.diff(mem[off], prepend=0))], "c": [_pack(np.diff(mem, prepend=0)[rest])]}


def _unpack_sets(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = _unpack(a)
    off, mem = np.cumsum(size) - size, np.empty(size.sum(), np.int64)
    rest = np.ones(len(mem), bool)
    rest[off] = False
    mem[rest] = _unpack(c)
    mem[off] = first = np.cumsum(_unpack(b))
    total = np.cumsum(mem)
    return size, total - np.repeat(total[off] - first, size)


def _pack_weights(w: np.ndarray) -> bytes:
    whole = bool(np.all(w == np.rint(w)) and np.all(np.abs(w) < 2.0**53))
    return (b"w" + _pack(w.astype(np.int64))) if whole else b"f" + w.astype("<f8").tobytes()


def _unpack_weights(b: bytes) -> np.ndarray:
    return _unpack(b[1:]).astype(np.float64) if b[:1] == b"w" else np.frombuffer(b[1:], "<f8")


def _group(v: np.ndarray, p: int) -> np.ndarray:
    h = v.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(p)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each graph, some batches at once."""
    kept: list[pa.RecordBatch] = []

    def parts() -> Iterator[tuple[str, pa.Table]]:
        t = pa.Table.from_batches(kept)
        names = t.column("graph").to_numpy()
        some = list(dict.fromkeys(names))
        for g in some:
            yield g, t.filter(pa.array(names == g)) if len(some) > 1 else t

    for x in batches:
        kept.append(x)
        if sum(y.num_rows for y in kept) >= DEALT:
            yield from parts()
            kept = []
    if sum(y.num_rows for y in kept):
        yield from parts()


def _sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and members of hyperedges."""
    x = t.column("members").combine_chunks()
    x = x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)
    off = x.offsets.to_numpy().astype(np.int64)
    return np.diff(off), x.values.to_numpy()[off[0] : off[-1]].astype(np.int64)


def _batch(graph: str, n: int, **columns) -> pa.RecordBatch:
    out = []
    for name, kind in zip(_NAMES, _TYPES):
        x = [graph] * n if name == "graph" else columns.get(name)
        out.append(pa.nulls(n, kind) if x is None else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(out, names=_NAMES)


def _slices(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all slices [start, start + len), one after the other."""
    end = np.cumsum(lens)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(starts - end + lens, lens)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers, sorted."""
    x = np.concatenate(parts)
    x.sort()
    return x[np.diff(x, prepend=x[0] - 1) > 0] if len(x) else x


class _Block:
    """What one block knows: local numbers are positions in ``ids``, ranks positions by (degree, id)."""

    def __init__(self, batches: Iterator[pa.RecordBatch], own: Callable[[np.ndarray], np.ndarray], stats: bool = False, group: Callable[[np.ndarray], np.ndarray] | None = None):
        """``own``: which ids are own.  ``stats``: only the edges whose lower end is own, with nhy, hsum, hmax and covn.  ``group``: edges inside a group are left out."""
        sizes, mem, far, wanted, self.parts, self.weights, told = [], [], [], [np.empty(0, np.int64)], [], [], []
        for x in batches:
            kind, v = (x.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("kind", "v"))
            a, b, c = (x.column(y) for y in "abc")
            for i in np.flatnonzero(kind == 0):
                size, m = _unpack_sets(a[i].as_py(), b[i].as_py(), c[i].as_py())
                sizes.append(size.astype(np.int8 if len(size) == 0 or size.max() < 128 else np.int64))
                mem.append(m)
            for i in np.flatnonzero(kind == 1):
                far.append((int(v[i]), _unpack(a[i].as_py())))
            wanted.append(v[kind == 2].astype(np.int64))
            for i in np.flatnonzero(kind == 3):
                self.parts.append([_unpack(y[i].as_py()) for y in (a, b, c)])
            for i in np.flatnonzero(kind == 4):
                self.weights.append((_unpack(a[i].as_py()), _unpack(b[i].as_py()), _unpack_weights(c[i].as_py())))
            for i in np.flatnonzero(kind == 5):
                told.append((_unpack(a[i].as_py()), _unpack(b[i].as_py())))
        size, mem = np.concatenate([np.empty(0, np.int64), *sizes]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *mem])
        sizes.clear()
        self.wanted, self.far = np.unique(np.concatenate(wanted)), far
        self.ids = _distinct([mem])
        self.n = n = len(self.ids)
        self.own = own(self.ids)
        loc, off = np.searchsorted(self.ids, mem), np.cumsum(size) - size
        mem = None
        #: by size, the local numbers of members, ascending in each row
        self.members = {int(s): loc[off[size == s][:, None] + np.arange(s)] for s in np.unique(size)}
        loc = off = size = None
        of = None if group is None else group(self.ids)
        keys = [np.empty(0, np.int64)]
        for s, m in self.members.items():
            i, j = np.triu_indices(s, 1)
            p, q = m[:, i].ravel(), m[:, j].ravel()
            some = self.own[p] if stats else self.own[p] | self.own[q]
            if of is not None:
                some &= of[p] != of[q]
            keys.append((p * n + q)[some])
        p = q = some = None
        if stats:
            lens = [len(k) for k in keys[1:]]
            key, inv = np.unique(np.concatenate(keys), return_inverse=True)
            of = np.repeat(np.array(list(self.members), np.int64), lens)
            self.nhy = np.bincount(inv, minlength=len(key))
            self.hsum = np.rint(np.bincount(inv, weights=of - 2, minlength=len(key))).astype(np.int64)
            self.hmax = np.zeros(len(key), np.int64)
            np.maximum.at(self.hmax, inv, of)
            self.covn = self._around(np.split(inv, np.cumsum(lens)[:-1]) if lens else [])
        else:
            key = _distinct(keys)
        keys = of = inv = None
        self.key, self.u, self.v = key, key // n if n else key, key % n if n else key
        self.deg = np.bincount(self.u, minlength=n) + np.bincount(self.v, minlength=n)  # right for own vertices, if edges of both ends are there
        if told:
            v, deg = (np.concatenate(x) for x in zip(*told))
            at = np.minimum(np.searchsorted(self.ids, v), max(n - 1, 0))
            ok = self.ids[at] == v if n else np.zeros(len(v), bool)
            self.deg[at[ok]] = deg[ok]

    def _around(self, inv: list[np.ndarray]) -> np.ndarray:
        """For each edge, how many others are with both ends in a hyperedge: all in the only one, or the distinct ones of several."""
        n, covn, keys = self.n, np.where(self.nhy == 1, self.hsum, 0), [np.empty(0, np.int64)]
        for (s, m), e in zip(self.members.items(), inv):
            i, j = np.triu_indices(s, 1)
            place = np.flatnonzero(self.own[m[:, i].ravel()])
            some = self.nhy[e] > 1
            if s < 3 or not some.any():
                continue
            e, place = e[some], place[some]
            for k in range(0, len(e), step := max(1, 4_000_000 // s)):
                row, pair = place[k : k + step] // len(i), place[k : k + step] % len(i)
                rest = np.ones((len(row), s), bool)
                rest[np.arange(len(row)), i[pair]] = rest[np.arange(len(row)), j[pair]] = False
                keys.append(_distinct([np.repeat(e[k : k + step], s - 2) * n + m[row][rest]]))
        key = _distinct(keys)
        return covn + np.bincount(key // n, minlength=len(covn)) if len(key) else covn

    def orient(self) -> None:
        """The edges in ranks from the lower to the higher end, sorted."""
        n = self.n
        order = np.argsort(self.deg, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.order, self.rank, self.own_r, self.id_r, self.deg_r = order, rank, self.own[order], self.ids[order], self.deg[order]
        p, q = rank[self.u], rank[self.v]
        self.ekey = np.minimum(p, q) * n + np.maximum(p, q)
        self.key = self.u = self.v = p = q = None
        self.ekey.sort()
        self._ends()

    def _ends(self) -> None:
        n = max(self.n, 1)
        self.lo, self.hi = (self.ekey // n).astype(np.int32), (self.ekey % n).astype(np.int32)
        self.start = np.searchsorted(self.lo, np.arange(self.n + 1))

    def only(self, some: np.ndarray) -> None:
        """Leaves out all other edges."""
        self.ekey = self.ekey[some]
        self._ends()

    def weighed(self) -> np.ndarray:
        """The weights that have come of the upward edges, NaN where none has."""
        w = np.full(len(self.ekey), np.nan)
        for u, v, x in self.weights:
            at = [np.minimum(np.searchsorted(self.ids, y), self.n - 1) for y in (u, v)]
            p, q = (self.rank[y] for y in at)
            key = np.minimum(p, q) * self.n + np.maximum(p, q)
            e = np.minimum(np.searchsorted(self.ekey, key), len(w) - 1)
            ok = (self.ids[at[0]] == u) & (self.ids[at[1]] == v) & (self.ekey[e] == key) if len(w) else np.zeros(len(u), bool)
            w[e[ok]] = x[ok]
        return w

    def cycles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """u, v and in how many four-cycles' matchings the edge stands, over the cycles whose lowest vertex m by id is own; chords allowed.

        With r across from m and p < q between them the least edge is (m, p), so the matching is (m, p), (r, q).  The common neighbours above m of m
        and r are in order, so the i-th of k is p in k - 1 - i cycles, and q in i.  No cycle is listed, only the wedges m, c, r.
        """
        far = self.far
        names = _distinct([self.ids, *[x for _, x in far]])
        n, here = len(names), np.searchsorted(names, self.ids)
        u, v, ou, ov = here[self.u], here[self.v], self.own[self.u], self.own[self.v]
        key = [u[ou] * n + v[ou], v[ov] * n + u[ov], *[np.searchsorted(names, x) * n + np.searchsorted(names, z) for x, z in far]]
        key = np.sort(np.concatenate(key))
        src, dst = key // n, key % n
        end = np.searchsorted(src, np.arange(n), "right")
        own = np.zeros(n, bool)
        own[here] = self.own
        count = np.zeros(len(key), np.int64)
        edge = np.flatnonzero(own[src] & (dst > src))  # (m, c), by m and c
        m, c = src[edge], dst[edge]
        total = np.cumsum(end[c] - np.searchsorted(key, c * n + m, "right"))
        stop = np.flatnonzero(np.diff(m, append=-1)) + 1  # of each m
        i = 0
        while i < len(edge):
            j = int(stop[np.searchsorted(stop, i, "right")])
            k = int(np.searchsorted(total, (total[i - 1] if i else 0) + WEDGES, "right"))
            j = max(j, int(stop[np.searchsorted(stop, k, "right") - 1]) if k >= stop[0] else 0)
            ranges = [(-1, n)]  # of r; halved where a vertex has more wedges than are counted at once
            while ranges:
                lo, hi = ranges.pop()
                begin = np.searchsorted(key, c[i:j] * n + np.maximum(m[i:j], lo), "right")
                lens = (end[c[i:j]] if hi == n else np.maximum(np.searchsorted(key, c[i:j] * n + hi, "right"), begin)) - begin
                if lens.sum() > WEDGES and hi - lo > 1:
                    ranges += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
                    continue
                if not lens.any():
                    continue
                row, slot = np.repeat(np.arange(i, j), lens), _slices(begin, lens)
                pair = m[row] * n + dst[slot]
                order = np.argsort(pair, kind="stable")  # leaves the c of a pair in order
                first = np.flatnonzero(np.diff(pair[order], prepend=-1))
                size = np.diff(first, append=len(pair))
                place = np.arange(len(pair)) - np.repeat(first, size)
                np.add.at(count, edge[row[order]], np.repeat(size, size) - 1 - place)
                np.add.at(count, slot[order], place)
            i = j
        some = np.flatnonzero(count)
        p, q = src[some], dst[some]
        both, at = np.unique(np.minimum(p, q) * n + np.maximum(p, q), return_inverse=True)
        t4 = np.zeros(len(both), np.int64)
        np.add.at(t4, at, count[some])
        return names[both // n], names[both % n], t4

    def covered(self) -> np.ndarray:
        """Sorted distinct keys (edge, z) of the triples in hyperedges, of edges that are there."""
        n, m, found = self.n, len(self.ekey), [np.empty(0, np.int64)]
        for s, mem in self.members.items():
            if s < 3 or not m:
                continue
            i, j, k = np.array(list(combinations(range(s), 3))).T
            step = max(1, 4_000_000 // len(i))
            for b in range(0, len(mem), step):
                r = np.sort(self.rank[mem[b : b + step]], axis=1)
                x, y, z = r[:, i].ravel(), r[:, j].ravel(), r[:, k].ravel()
                if n < 1 << 20:  # looked up in order below, which is quicker
                    found.append(_distinct([(x * n + y) * n + z]))
                else:
                    e = np.minimum(np.searchsorted(self.ekey, x * n + y), m - 1)
                    found.append(_distinct([e[ok] * n + z[ok] for ok in [self.ekey[e] == x * n + y]]))
        key = _distinct(found)
        if n >= 1 << 20 or not m or not len(key):
            return key
        e = np.minimum(np.searchsorted(self.ekey, key // n), m - 1)
        ok = self.ekey[e] == key // n
        return e[ok] * n + key[ok] % n

    def triangles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the edges (x, y), (x, z), (y, z) of triangles, some at a time."""
        n, start, m = self.n, self.start, len(self.ekey)
        if not m:
            return
        x, y = self.lo, self.hi
        lens = start[y + 1] - start[y]
        end, row = np.cumsum(lens), np.cumsum(np.diff(x, prepend=x[0]) > 0)
        most = max(1, CELLS // n)
        flat = most >= 64  # a table of some vertices' edges, or one of hashes that tells most pairs that are no edge
        if flat:
            table = np.zeros(min(most, row[-1] + 1) * n, np.int32)
        else:
            bits = min(26, max(6, (4 * m).bit_length()))
            spot = lambda k: (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
            maybe = np.zeros(1 << bits, bool)
            for i in range(0, m, 1_000_000):
                maybe[spot(self.ekey[i : i + 1_000_000])] = True
        i = 0
        while i < m:
            j = int(np.searchsorted(end, (end[i - 1] if i else 0) + WEDGES, "right"))
            if flat:
                j = min(j, int(np.searchsorted(row, row[i] + most)))
            j = max(j, i + 1)
            yz = _slices(start[y[i:j]], lens[i:j])
            if flat:
                xs = np.unique(x[i:j])
                width = start[xs + 1] - start[xs]
                at = _slices(start[xs], width)
                cells = np.repeat(np.arange(len(xs)) * n, width) + self.hi[at]
                table[cells] = at + 1
                xz = table[np.repeat((row[i:j] - row[i]) * n, lens[i:j]) + self.hi[yz]]
                hit = np.flatnonzero(xz)
                xz = xz[hit].astype(np.int64) - 1
                table[cells] = 0
            else:
                key = np.repeat(x[i:j].astype(np.int64) * n, lens[i:j]) + self.hi[yz]
                hit = np.flatnonzero(maybe[spot(key)])
                key = key[hit]
                xz = np.minimum(np.searchsorted(self.ekey, key), m - 1)
                ok = self.ekey[xz] == key
                hit, xz = hit[ok], xz[ok]
            if len(hit):
                yield i + np.searchsorted(np.cumsum(lens[i:j]), hit, "right"), xz, yz[hit]
            i = j


def _held(keys: np.ndarray, xy: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(xy), bool)
    k = xy * n + z
    return keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k


class Blocks:
    """degrees, the table of edges with all their counts, and cross triangles of normal hyperedges with whole numbers for vertices."""

    def __init__(self, hyperedges: DataFrame):
        """``hyperedges`` are read several times."""
        n = F.size("members")
        per = hyperedges.groupBy("graph").agg(F.sum((n * (n - 1) / 2).cast("long")).alias("n"))
        pairs, most = (x or 0 for x in per.agg(F.sum("n"), F.max("n")).first())
        k = max(1, -(-pairs // PAIRS))
        cuts = hyperedges.select(F.explode("members").alias("v")).agg(F.percentile_approx("v", [i / k for i in range(1, k)], 10000)).first()[0] if k > 1 else []
        self.bounds = bounds = np.unique(np.array(cuts or [], np.int64))
        #: groups, and the tasks of each round: their number and groups
        self.p = p = int(np.ceil(np.sqrt(most / PAIRS))) if most > 6 * PAIRS else 1
        tasks = list(enumerate([*combinations(range(p), 3), *combinations(range(p), 2)] if p > 1 else [(0,)]))
        r = max(1, p // 2)  # an edge goes to p - 1 tasks, to about two in a round
        self.rounds = [tasks[i::r] for i in range(r)]
        self._hyperedges = hyperedges.select("graph", "members")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for graph, t in _gathered(batches):
                size, mem = _sets(t)
                off, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
                to = np.unique(np.searchsorted(bounds, mem, "right") * len(size) + row)
                blk, row = to // len(size), to % len(size)
                for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(blk)) + 1):
                    own = row[part]
                    yield _batch(graph, 1, blk=[blk[part[0]]], kind=[0], **_pack_sets(size[own], mem[_slices(off[own], size[own])]))

        self._chunks = self._hyperedges.mapInArrow(deal, _ROW)

    def _own(self) -> Callable[[int], Callable[[np.ndarray], np.ndarray]]:
        bounds = self.bounds
        return lambda blk: lambda ids: np.searchsorted(bounds, ids, "right") == blk

    @staticmethod
    def _row(df: DataFrame, kind: int, **c) -> DataFrame:
        """Columns of messages; those that are not given are null."""
        return df.select(*[(F.lit(kind).cast("int") if x == "kind" else c[x] if x in c else F.lit(None)).cast(t).alias(x) for x, t in (y.split() for y in _ROW.split(", "))])

    @cached_property
    def _told(self) -> DataFrame:
        """Own vertices with their degrees, and these packed for each block that has an edge from a lower vertex to them."""
        bounds, own = self.bounds, self._own()

        def tell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph, blk = key[0].as_py(), key[1].as_py()
            b = _Block(batches, own(blk))
            mine = np.flatnonzero(b.own)
            yield _batch(graph, len(mine), blk=np.full(len(mine), blk, np.int32), kind=np.full(len(mine), 2, np.int32), v=b.ids[mine], deg=b.deg[mine])
            of = np.searchsorted(bounds, b.ids, "right")
            up = np.flatnonzero(b.own[b.v])
            to = np.unique(np.concatenate([of[b.u[up]] * b.n + b.v[up], blk * b.n + mine]))
            for part in np.split(to, np.flatnonzero(np.diff(to // b.n)) + 1):
                v = part % b.n
                yield _batch(graph, 1, blk=[part[0] // b.n], kind=[5], a=[_pack(b.ids[v])], b=[_pack(b.deg[v])])

        return cut(self._chunks.groupBy("graph", "blk").applyInArrow(tell, _ROW))

    @cached_property
    def degrees(self) -> DataFrame:
        return self._told.filter("kind = 2").select("graph", "v", "deg")

    @cached_property
    def _above(self) -> DataFrame:
        """graph, to (the block that asks), blk, v: vertices of higher blocks that are next to a block's own ones, for four-cycles."""
        bounds, own = self.bounds, self._own()

        def ask(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph, blk = key[0].as_py(), key[1].as_py()
            b = _Block(batches, own(blk))
            of = np.searchsorted(bounds, b.ids, "right")
            far = np.flatnonzero(of > blk)
            yield _batch(graph, len(far), blk=of[far].astype(np.int32), kind=np.full(len(far), blk, np.int32), v=b.ids[far])

        return cut(self._chunks.groupBy("graph", "blk").applyInArrow(ask, _ROW).select("graph", F.col("kind").alias("to"), "blk", "v"))

    def _pieces(self, tasks: list) -> DataFrame:
        """The pieces of hyperedges with an edge among a task's groups."""
        p = self.p

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for graph, t in _gathered(batches):
                size, mem = _sets(t)
                row, g = np.repeat(np.arange(len(size)), size), _group(mem, p)
                count = np.bincount(row * p + g, minlength=len(size) * p).reshape(-1, p)
                for k, groups in tasks:
                    c = count[:, groups]
                    some = ((c > 0) if len(groups) == 3 else c).sum(1) >= 2
                    there = np.zeros(p, bool)
                    there[list(groups)] = True
                    m = mem[there[g] & some[row]]
                    if len(m):
                        yield _batch(graph, 1, blk=[k], kind=[0], **_pack_sets(c.sum(1)[some], m))

        return self._hyperedges.mapInArrow(deal, _ROW)

    def _packed(self, df: DataFrame, tasks: list, weights: bool) -> DataFrame:
        """Weights of edges (graph, u, v, w) or degrees (graph, v, deg), packed for the tasks that have the edge or vertex."""
        p = self.p

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for graph, t in _gathered(batches):
                x = [t.column(c).to_numpy() for c in (("u", "v", "w") if weights else ("v", "deg"))]
                order = np.lexsort((x[1], x[0]))
                x = [y[order] for y in x]
                g = [_group(y, p) for y in x[: 1 + weights]]
                for k, groups in tasks:
                    there = np.zeros(p, bool)
                    there[list(groups)] = True
                    some = there[g[0]]
                    if weights:
                        some = some & there[g[1]] & ((g[0] != g[1]) | (len(groups) < 3))
                    if some.any():
                        y = [c[some] for c in x]
                        last = {"b": [_pack(y[1])], "c": [_pack_weights(y[2])]} if weights else {"b": [_pack(y[1])]}
                        yield _batch(graph, 1, blk=[k], kind=[4 if weights else 5], a=[_pack(y[0])], **last)

        return df.mapInArrow(deal, _ROW)

    def _listed(self, found: Callable, schema: str, degrees: bool = True, weights: DataFrame | None = None) -> DataFrame:
        """What ``found(graph, block, triangles)`` gives in each task; ``triangles`` are places of edges, each triangle in one task only.  Rounds run one
        after the other, and the files of one are gone when the next begins; a single round is planned into the query that reads it."""
        p, every = self.p, dict(x for r in self.rounds for x in r)

        def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = every[key[1].as_py()]
            b = _Block(batches, lambda ids: np.ones(len(ids), bool), group=(lambda ids: _group(ids, p)) if len(groups) == 3 else None)
            b.orient()
            g = _group(b.id_r, p)
            home = [i for i in groups if p < 3 or {i, (i + 1) % p} == set(groups)]  # whose triangles inside one group are listed here

            def triangles() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for xy, xz, yz in b.triangles():
                    if len(groups) == 2:
                        one = g[b.lo[xy]]
                        ok = (one != g[b.hi[xy]]) | (one != g[b.hi[yz]]) | np.isin(one, home)
                        xy, xz, yz = xy[ok], xz[ok], yz[ok]
                    if len(xy):
                        yield xy, xz, yz

            yield from found(key[0].as_py(), b, triangles)

        out = None
        for tasks in self.rounds:
            df = self._pieces(tasks)
            if degrees:
                df = df.unionByName(self._packed(self.degrees, tasks, False))
            if weights is not None:
                df = df.unionByName(self._packed(weights, tasks, True))
            df = df.groupBy("graph", "blk").applyInArrow(task, schema)
            df = cut(df) if len(self.rounds) > 1 else df
            out = df if out is None else out.unionByName(df)
        return out

    def census(self, degrees: bool = False) -> DataFrame:
        """graph, n, tau: numbers of triangles, and the largest degree of a triangle's lowest vertex if degrees are asked for; some rows for a graph."""

        def found(graph: str, b: _Block, triangles: Callable) -> Iterator[pa.RecordBatch]:
            n = tau = 0
            for xy, _, _ in triangles():
                n, tau = n + len(xy), max(tau, int(b.deg_r[b.lo[xy]].max()))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([graph]), pa.array([n], pa.int64()), pa.array([tau], pa.int64())], names=["graph", "n", "tau"])

        return self._listed(found, CENSUS, degrees)

    def triangles(self, cross: bool) -> DataFrame:
        """graph, x, y, z, dx, dy, dz: all triangles, or those that no hyperedge holds."""
        names = [c.split()[0] for c in CROSS.split(", ")]

        def found(graph: str, b: _Block, triangles: Callable) -> Iterator[pa.RecordBatch]:
            held = b.covered() if cross else np.empty(0, np.int64)
            for xy, _, yz in triangles():
                free = ~_held(held, xy, b.hi[yz], b.n)
                xyz = [x[free] for x in (b.lo[xy], b.hi[xy], b.hi[yz])]
                if len(xyz[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([graph] * len(xyz[0]), pa.string())] + [pa.array(f[x], pa.int64()) for f in (b.id_r, b.deg_r) for x in xyz], names=names)

        return self._listed(found, CROSS)

    def weighted(self, weights: DataFrame, sums: Callable | None = None, third: bool = False) -> DataFrame:
        """The cross triangles with the weights of (x, y) and (x, z), both of which must have one, and (y, z) too with ``third``.  ``weights`` has graph, u, v,
        w (double); a weight goes to the tasks of its edge, so triangles stay where they are.  ``sums(w_xy, w_xz, w_yz, dx)``, if given, is summed over the
        triangles of each x in a task: graph, x, s."""
        names = [c.split()[0] for c in (WEIGHTED if sums is None else SUMS).split(", ")]

        def found(graph: str, b: _Block, triangles: Callable) -> Iterator[pa.RecordBatch]:
            w = b.weighed()
            b.weights = []
            if third:  # no triangle with another edge counts
                some = ~np.isnan(w)
                w = w[some]
                b.only(some)
            held = b.covered()
            total, hits = np.zeros(b.n if sums else 0), np.zeros(b.n if sums else 0, bool)
            for xy, xz, yz in triangles():
                some = ~(np.isnan(w[xy]) | np.isnan(w[xz]))
                xy, xz, yz = xy[some], xz[some], yz[some]
                free = ~_held(held, xy, b.hi[yz], b.n)
                xy, xz, yz = xy[free], xz[free], yz[free]
                if sums and len(xy):
                    x = b.lo[xy]
                    np.add.at(total, x, sums(w[xy], w[xz], w[yz], b.deg_r[x]))
                    hits[x] = True
                elif len(xy):
                    xyz = (b.lo[xy], b.hi[xy], b.hi[yz])
                    yield pa.RecordBatch.from_arrays([pa.array([graph] * len(xy), pa.string())] + [pa.array(f[x], pa.int64()) for f in (b.id_r, b.deg_r) for x in xyz] + [pa.array(w[e]) for e in (xy, xz)], names=names)
            x = np.flatnonzero(hits)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([graph] * len(x), pa.string()), pa.array(b.id_r[x], pa.int64()), pa.array(total[x])], names=names)

        weights = weights.select("graph", "u", "v", F.col("w").cast("double").alias("w")).filter("w IS NOT NULL")
        return self._listed(found, SUMS if sums else WEIGHTED, True, weights)

    def table(self) -> DataFrame:
        """The edges, each once, with t (cross triangles), covn (neighbours of both that a hyperedge of the edge holds), copies (triangles) and degrees."""
        bounds, own = self.bounds, self._own()

        def counted(graph: str, b: _Block, triangles: Callable) -> Iterator[pa.RecordBatch]:
            held, m = b.covered(), len(b.ekey)
            b.members = None  # not needed any more
            t, hits, k = np.zeros(m, np.int32), [], 0
            for xy, xz, yz in triangles():
                free = ~_held(held, xy, b.hi[yz], b.n)
                hits += [e[free] for e in (xy, xz, yz)]
                k += 3 * int(free.sum())
                if k > m:
                    t += np.bincount(np.concatenate(hits), minlength=m).astype(np.int32)
                    hits, k = [], 0
            if hits:
                t += np.bincount(np.concatenate(hits), minlength=m).astype(np.int32)
            some = np.flatnonzero(t)
            p, q = b.id_r[b.lo[some]], b.id_r[b.hi[some]]
            u, v, t = np.minimum(p, q), np.maximum(p, q), t[some]
            order = np.lexsort((v, u))
            u, v, t = u[order], v[order], t[order]
            to = np.searchsorted(bounds, u, "right")
            for part in np.split(np.arange(len(u)), np.flatnonzero(np.diff(to)) + 1) if len(u) else []:
                for i in range(0, len(part), PART):
                    w = part[i : i + PART]
                    yield _batch(graph, 1, blk=[to[w[0]]], kind=[3], a=[_pack(u[w])], b=[_pack(v[w])], c=[_pack(t[w])])

        def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = _Block(batches, own(key[1].as_py()), True)
            t = np.zeros(len(b.key), np.int64)
            for u, v, count in b.parts:
                at = np.searchsorted(b.key, np.searchsorted(b.ids, u) * b.n + np.searchsorted(b.ids, v))
                t[at] += count  # an edge stands once in a part
            columns = [b.ids[b.u], b.ids[b.v], b.nhy, b.hsum, b.hmax, t, b.covn, t + b.covn, b.deg[b.u], b.deg[b.v]]
            names = [c.split()[0] for c in TABLE.split(", ")]
            for i in range(0, len(t), 100_000):
                w = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(t[w]), pa.string())] + [pa.array(c[w], pa.int64()) for c in columns], names=names)

        parts = self._listed(counted, _ROW, False)
        return cut(self._chunks.unionByName(self._told.filter("kind = 5")).unionByName(parts).groupBy("graph", "blk").applyInArrow(summed, TABLE))

    def cycles(self) -> DataFrame:
        """graph, u, v, t4: parts of the numbers of four-cycles, cross or not, in whose matching the edge stands."""
        own, row = self._own(), self._row

        def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = key[0].as_py()
            b = _Block(batches, own(key[1].as_py()))
            p, q = np.concatenate([b.u, b.v]), np.concatenate([b.v, b.u])
            order = np.lexsort((q, p))
            p, q = p[order], q[order]
            at = np.searchsorted(b.ids, b.wanted)
            for i in range(0, len(at), 5000):
                start, end = (np.searchsorted(p, at[i : i + 5000], side) for side in ("left", "right"))
                yield _batch(graph, len(start), v=b.wanted[i : i + 5000], a=[_pack(b.ids[q[x:y]]) for x, y in zip(start, end)])

        def counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = _Block(batches, own(key[1].as_py()))
            columns = b.cycles()
            for i in range(0, len(columns[0]), 100_000):
                part = [x[i : i + 100_000] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(part[0]), pa.string())] + [pa.array(x, pa.int64()) for x in part], names=["graph", "u", "v", "t4"])

        known = self._chunks
        if len(self.bounds):  # a block needs all neighbours of the higher blocks' vertices that are next to its own
            wanted = row(self._above.select("graph", "blk", "v").distinct(), 2, graph=F.col("graph"), blk=F.col("blk"), v=F.col("v"))
            lists = known.unionByName(wanted).groupBy("graph", "blk").applyInArrow(answer, _ROW).select("graph", "v", "a")
            known = known.unionByName(row(cut(self._above.join(lists, ["graph", "v"])), 1, graph=F.col("graph"), blk=F.col("to"), v=F.col("v"), a=F.col("a")))
        return known.groupBy("graph", "blk").applyInArrow(counted, CYCLES)
