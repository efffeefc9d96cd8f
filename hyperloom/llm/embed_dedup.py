"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors x and y with cosine c lie sqrt(2-2c) apart, and their projections on a random direction differ by a normal variable of that spread over
sqrt(dimension).  Vectors meet in cells that a few coarse projections make, in several tables; the plan takes so many tables that a pair at the
threshold misses all of them with a chance below ``MISS``.  Cells only spread the work.  Inside a cell rows are sorted by each of many projections;
around each query lies a window in each order, the windows that a pair collides in are counted, and pairs with the count that nearly every
true pair reaches are verified in double precision.  Cells with more rows than a block are joined block by block, so no task holds a whole
hot cell.  Vectors of each length have a plan of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from .components import components

#: Chance that a pair at the threshold is missed by all tables, and by the count; both together bound the loss.
MISS = 1e-6
BLOCK, SEED = 2048, 41


def _tail(k: int, n: int, p: float) -> float:
    """Chance of fewer than k successes in n trials."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


@dataclass(frozen=True)
class Plan:
    dimension: int
    cosine: float
    coarse: int  # projections that make a cell
    tables: int
    width: float  # of a cell
    window: float  # half width of a query's window
    projections: int  # in which collisions are counted
    least: int  # collisions that a pair needs

    @staticmethod
    def make(dimension: int, cosine: float, group_rows: int, miss: float = MISS, aim: int = 1024) -> Plan:
        """Coarse projections until an average cell of the largest group has ``aim`` rows at most, then tables by the recall that is left."""
        spread = math.sqrt(2 - 2 * cosine) / math.sqrt(dimension)
        data = 1 / math.sqrt(dimension)
        width = 2.4 * data
        same = lambda s: math.erf(width / s / math.sqrt(2)) - s / width * math.sqrt(2 / math.pi) * (1 - math.exp(-((width / s) ** 2) / 2))
        near, far = same(spread), same(math.sqrt(2) * data)
        coarse = max(0, math.ceil(math.log(max(1, group_rows / aim)) / -math.log(far)))
        window = 5.0 * spread  # a true pair misses such a window about once in two million times
        hit = (near**coarse) * math.erf(window / spread / math.sqrt(2))
        tables = 1 if coarse == 0 else math.ceil(math.log(miss) / math.log(1 - hit))
        tight, n = 2.0 * spread, 24
        p = math.erf(tight / spread / math.sqrt(2))
        least = max(k for k in range(n + 1) if _tail(k, n, p) <= miss)
        return Plan(dimension, cosine, coarse, tables, width, tight, n, least)

    @lru_cache(maxsize=64)  # noqa: B019
    def directions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit directions of the cells (tables, coarse, dimension), their offsets, and of the counted projections (projections, dimension)."""
        r = np.random.default_rng(SEED)
        cells = r.normal(size=(self.tables, self.coarse, self.dimension))
        counted = r.normal(size=(self.projections, self.dimension))
        # orthogonal sets spread evenly, so that counts vary less than with independent directions
        for i in range(0, self.projections, self.dimension):
            q, _ = np.linalg.qr(counted[i : i + self.dimension].T)
            counted[i : i + self.dimension] = q.T[: len(counted[i : i + self.dimension])]
        cells /= np.maximum(np.linalg.norm(cells, axis=-1, keepdims=True), 1e-300)
        return cells, r.uniform(0, self.width, (self.tables, self.coarse)), counted


def _cells(x: np.ndarray, plan: Plan) -> np.ndarray:
    """The cell of each row in each table, as a number."""
    directions, offsets, _ = plan.directions()
    out = np.zeros((len(x), plan.tables), np.int64)
    for t in range(plan.tables):
        for j in range(plan.coarse):
            out[:, t] = out[:, t] * 4099 + np.floor((x @ directions[t, j] + offsets[t, j]) / plan.width).astype(np.int64) + 2048
    return out


def query_windows(px: np.ndarray, py: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of py in the order of each projection; for each row of px and projection, the place where its window begins and the places in it."""
    kind = np.uint16 if len(py) < 1 << 16 else np.uint32
    place, begin, width = np.empty(py.shape, kind), np.empty(px.shape, kind), np.empty(px.shape, kind)
    for k in range(px.shape[1]):
        order = np.argsort(py[:, k], kind="stable")
        place[order, k] = np.arange(len(order), dtype=kind)
        line = py[order, k]
        low = np.searchsorted(line, px[:, k] - half, side="left")
        begin[:, k], width[:, k] = low, np.searchsorted(line, px[:, k] + half, side="right") - low
    return place, begin, width


def collisions(place: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """In how many windows of each query each row lies."""
    count = np.zeros((len(begin), len(place)), np.int8)
    for k in range(place.shape[1]):
        # an unsigned difference: places before the window wrap around and are beyond any width
        count += (place[None, :, k] - begin[:, None, k]) < width[:, None, k]
    return count


def link_block(x: np.ndarray, y: np.ndarray | None, cells_x: np.ndarray, cells_y: np.ndarray | None, table: int, plan: Plan):
    """Index pairs (i, j) of unit rows of x and y (or of x alone, i < j) that are linked and first meet in this table."""
    own = y is None
    y, cells_y = (x, cells_x) if own else (y, cells_y)
    counted = plan.directions()[2].astype(np.float32)
    place, begin, width = query_windows((x @ counted.T).astype(np.float32), (y @ counted.T).astype(np.float32), plan.window)
    out_i, out_j = [], []
    for at in range(0, len(x), 256):
        u, v = np.nonzero(collisions(place, begin[at : at + 256], width[at : at + 256]) >= plan.least)
        u = u + at
        if own:
            some = u < v
            u, v = u[some], v[some]
        for s in range(0, len(u), 1 << 16):
            p, q = u[s : s + (1 << 16)], v[s : s + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[p], y[q]) >= plan.cosine
            if table:
                ok &= ~(cells_x[p, :table] == cells_y[q, :table]).any(1)
            out_i.append(p[ok])
            out_j.append(q[ok])
    z = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (z, z)


def spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indexes of the pairs that a union of the pairs in order needs: as many as join two components."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    keep = []
    for n, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(n)
    return np.asarray(keep, np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept per row.  Rows are compared when their labels are equal and not null.

    A vector that is null, empty, zero, or holds a null or a non-finite component links with nothing; its component is itself.  Vectors of different
    lengths do not link, those of each length are compared among themselves.  Equal vectors of a label are one class: they link with each other and
    with all that their class links with, and are compared once.  Rows with one id count as vectors of their own and share a component.  A null id
    links with nothing and has none; an id that is no whole number counts as null.  Other columns are not read.  An empty table gives an empty result.
    The driver holds a plan for each distinct length.
    """
    v = F.col("v")
    number = F.col(f"`{id_column}`")
    number = number.try_cast("long") if vectors.schema[id_column].dataType.simpleString() == "string" else number.cast("long")
    rows = vectors.select(number.alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{label}`").alias("label"))
    big = F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (big > 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # scaled by the largest component first, so that no square overflows or vanishes
    rows = rows.withColumn("v", F.when(F.col("good"), F.transform(v, lambda x: x / big)))
    rows = written(rows, "vectors")
    some = rows.filter("good")
    classes = written(some.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    largest = classes.groupBy("label", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()
    plans = {r.d: Plan.make(r.d, cosine, r.n) for r in largest}

    def place(batches):
        for b in batches:
            vectors = b.column(1)
            length = np.diff(np.asarray(vectors.offsets))
            for d in np.unique(length):
                plan, which = plans[int(d)], pa.array(np.flatnonzero(length == d))
                x = np.asarray(vectors.take(which).flatten(), np.float64).reshape(-1, d)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cells = _cells(x, plan)
                t = np.tile(np.arange(plan.tables), len(x))
                take = np.repeat(np.arange(len(x)), plan.tables)
                raw, places = [r.tobytes() for r in x], [r.astype("<i8").tobytes() for r in cells]
                label, rep, n = (b.column(i).take(which).take(pa.array(take)) for i in (0, 2, 3))
                yield pa.RecordBatch.from_arrays(
                    [label, pa.array(np.full(len(t), d), pa.int32()), pa.array(t, pa.int32()), pa.array(cells.reshape(-1), pa.int64()), rep, n, pa.array([raw[i] for i in take], pa.binary()), pa.array([places[i] for i in take], pa.binary())],
                    ["label", "d", "t", "cell", "rep", "n", "x", "places"],
                )

    label_kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "v", "rep", "n").mapInArrow(place, f"label {label_kind}, d int, t int, cell long, rep long, n long, x binary, places binary")
    counts = placed.groupBy("label", "d", "t", "cell").agg(F.count(F.lit(1)).alias("rows"))
    # a cell of several blocks: each row goes to every pair of blocks that its own is in
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    placed = placed.join(counts, ["label", "d", "t", "cell"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", "x"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.filter("rows > 1").select("label", "d", "t", "cell", "rep", "n", "x", "places", "block", other.alias("other"))
    placed = placed.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other")

    def join(key, table):
        plan, t, b1, b2 = plans[key[1].as_py()], key[2].as_py(), key[4].as_py(), key[5].as_py()
        read = lambda c, kind: np.frombuffer(b"".join(z.as_py() for z in table[c]), kind).reshape(table.num_rows, -1)
        x, places, rep, n, block = read("x", "<f8"), read("places", "<i8"), np.asarray(table["rep"]), np.asarray(table["n"]), np.asarray(table["block"])
        if b1 == b2:
            i, j = link_block(x, None, places, None, t, plan)
        else:
            a, b = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
            i, j = link_block(x[a], x[b], places[a], places[b], t, plan)
            i, j = a[i], b[j]
        links = np.bincount(i, weights=n[j], minlength=len(rep)) + np.bincount(j, weights=n[i], minlength=len(rep))
        to = np.arange(len(rep))
        forest = spanning(i, j)
        # one row per vector with its number of links, and one per pair of a spanning forest
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate((rep[some], rep[i[forest]])), pa.int64()), "b": pa.array(np.concatenate((rep[to[some]], rep[j[forest]])), pa.int64()), "label": pa.array([key[0].as_py()] * (len(some) + len(forest)), table["label"].type), "links": pa.array(np.concatenate((links[some], np.zeros(len(forest)))).astype(np.int64), pa.int64())})

    found = placed.groupBy("label", "d", "t", "cell", "b1", "b2").applyInArrow(join, f"a long, b long, label {label_kind}, links long")
    found = written(found, "vector-links")
    per = found.filter("a = b").groupBy("label", F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.select("a", "b"))
    member = classes.join(per, ["label", "rep"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    good_rows = some.join(member, ["label", "v"]).select("id", "links", "component")
    lone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = good_rows.unionByName(lone)
    return out.select(F.col("id").alias(id_column), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
