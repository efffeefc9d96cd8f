"""Triangles over groups of vertices: what is sent does not hang on the ids, and rounds bound what is on disk."""

import random

import numpy as np
import pytest

from hyperloom.operators import blocks, graphs, scores
from hyperloom.operators.hypergraph import Closure


def test_numbers_are_packed_whole():
    for x in ([], [5], [-(2**63), 2**63 - 1, 0], list(range(300)), [7] * 9):
        assert blocks._unpack(blocks._pack(np.array(x, np.int64))).tolist() == x
    sets = [[3, 9, 2**40], [-5, 4], [3, 4, 5, 6], [2**62, 2**62 + 1]]
    p = blocks._pack_sets(np.array([len(s) for s in sets]), np.concatenate([np.array(s, np.int64) for s in sets]))
    size, mem = blocks._unpack_sets(*(p[c][0] for c in "abc"))
    assert sorted(x.tolist() for x in np.split(mem, np.cumsum(size)[:-1])) == sorted(sets)


@pytest.mark.parametrize("cells", [0, 2_000_000])
def test_hashes_and_tables_close_the_same_wedges(monkeypatch, cells):
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "WEDGES", 50)
    r = random.Random(2)
    edges = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(250)})
    b = blocks._Block([blocks._batch("g", 1, blk=[0], kind=[0], **blocks._pack_sets(np.full(len(edges), 2), np.array(edges).ravel()))], lambda ids: np.ones(len(ids), bool))
    b.orient()
    found = sorted(tuple(sorted(b.id_r[[b.lo[xy], b.hi[xy], b.hi[yz]]])) for part in b.triangles() for xy, _, yz in zip(*part))
    e = set(edges)
    assert found == [(x, y, z) for x, y in edges for z in range(y + 1, 40) if (x, z) in e and (y, z) in e] and len(found) > 50


def test_groups_find_what_joins_find(spark, monkeypatch):
    """Random ids over several rounds: an edge goes to p - 1 tasks, and no vertex's neighbours go anywhere."""
    monkeypatch.setattr(blocks, "PAIRS", 40)
    r = random.Random(5)
    names = [r.randrange(2**40) for _ in range(26)]
    inc = spark.createDataFrame([(i, names[v]) for i in range(90) for v in r.sample(range(26), r.randint(1, 6))], "hid long, v long").selectExpr("'g' AS graph", "hid", "v")
    c, plain = Closure.of(inc), Closure.of(inc)
    b = c.blocks
    assert b.p > 2 and len(b.rounds) > 1
    sent = 0
    for tasks in b.rounds:
        for x in b._pieces(tasks).collect():
            size, mem = blocks._unpack_sets(x["a"], x["b"], x["c"])
            for m in np.split(mem, np.cumsum(size)[:-1]):
                i, j = np.triu_indices(len(m), 1)
                g = blocks._group(m, b.p)
                sent += int(((g[i] != g[j]) | (len(dict(tasks)[x["blk"]]) == 2)).sum())
    assert sent == (b.p - 1) * plain.hyperedges.selectExpr("sum(size * (size - 1) div 2)").first()[0]
    tri = graphs.triangles(plain.edges, plain.degrees)
    free = plain._uncovered(tri)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert c.triangle_count.first()[0] == tri.count() and rows(c.floor_degree) == rows(graphs.floor_degree(tri))
    t = {x[:3]: x[3] for x in rows(graphs.triangle_edges(free).groupBy("graph", "u", "v").count())}
    assert {x[:3]: x[6] for x in rows(c.edge_table) if x[6]} == t
    w = scores.weighting(c, "mindeg")
    assert scores.p_succ(c, w).first()["p"] == pytest.approx(scores.p_succ(c, w, cross=free).first()["p"])
