"""Core numbers, widths and the published values of instances that need no download."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.operators import cores, graphs
from hyperloom.operators.hypergraph import Closure
from hyperloom.plans import registry, reports
from hyperloom.sources import generators


def peel(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    core, k = {}, 0
    while adj:
        v = min(adj, key=lambda x: len(adj[x]))
        k = max(k, len(adj[v]))
        core[v] = k
        for w in adj.pop(v):
            adj[w].discard(v)
    return core


def width(edges):
    """The densest subset of edges by brute force over vertex sets."""
    nodes = sorted({v for e in edges for v in e})
    best = 0
    for k in range(2, len(nodes) + 1):
        for s in itertools.combinations(nodes, k):
            s = set(s)
            best = max(best, -(-sum(a in s and b in s for a, b in edges) // len(s)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_width_and_cores(spark, seed):
    r = random.Random(seed)
    edges = sorted({tuple(sorted(r.sample(range(9), 2))) for _ in range(r.randint(3, 26))})
    u, v = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    a = cores.oracle_width_of(u, v)
    assert a == width(edges)
    assert cores.orientation_feasible(u, v, a) and not (a > 1 and cores.orientation_feasible(u, v, a - 1))
    if seed < 2:
        df = spark.createDataFrame([("g", *e) for e in edges], "graph string, u long, v long")
        assert {x.v: x.core for x in cores.core_numbers(df).collect()} == peel(edges)
        assert cores.oracle_width(df).first().alpha == a


def test_hard_instances(spark):
    """Values published for these instances: m, triangles, kappa, kappa of copies, width, floor degree, own bound, ratio to the lower bound."""
    got = {r.graph: r for r in reports.hard_instances(spark).collect()}
    want = {  # fixed values
        "hubs_1_64": (192, 64, 2, 2, 2, 2, 6.0, 0.25), "hubs_1_256": (768, 256, 2, 2, 2, 2, 6.0, 0.125), "hubs_4_64": (576, 64, 2, 2, 2, 2, 18.0, 0.25),
        "hubs_8_64": (1088, 64, 2, 2, 2, 2, 34.0, 0.25), "friendship_64": (256, 64, 8, 2, 2, 2, 8.0, 0.25), "friendship_256": (1024, 256, 16, 2, 2, 2, 8.0, 0.125),
    }
    for k, w in want.items():
        r = got[k]
        assert (r.m, r.n_triangles, r.kappa, r.kappa_copy, r.alpha, r.tau) == w[:6] and (r.ours, r.ours_over_lower) == pytest.approx(w[6:])
    r = got["disjointness_6_15"]
    assert r.n_triangles == 450 and r.separable


def test_affine_planes(spark):
    got = {r.graph: r for r in reports.object_scan(spark, (7,)).collect()}
    a, b = got["affine_7"], got["affine_7_130"]
    assert (a.n, a.m, a.kappa, a.m_copy, a.n_copies, a.alpha) == (105, 392, 7, 0, 0, 0)
    assert (b.n, b.m, b.kappa, b.kappa_copy, b.alpha, b.m_copy, b.n_copies) == (885, 1172, 7, 2, 1, 520, 130)


def test_separable_family(spark):
    """Published row for cliques of 20: m, kappa, cross triangles, and the split with 15 shuffles."""
    c = Closure.of(generators.cliques_and_cross(spark, 6, 20, 120, seed=1), 200).persisted()
    r = reports.evaluate(c, ["cliques_20"], 15).first()
    assert (r.m, r.n_cross) == (1380, 120)
    want = {"loc_x": 52.535702146254785, "perfect_over_loc": 1.5862068965517242, "firstedge_x": 83.33249305957655, "permuted_over_loc_mean": 0.9513422733077903, "mindeg_over_loc": 0.16595847029583902, "structural_share": 1.0830043572984749, "perm_pvalue": 0.0625}  # fixed values
    for k, v in want.items():
        assert r[k] == pytest.approx(v, rel=1e-9), k
    d = reports.diagnostic(c).first()
    assert (d.kappa, d.kappa_copy, d.alpha, d.m_copy) == (19, 3, 2, 355)


def test_bracket_and_unknown_pattern(spark):
    e = generators.hubs(spark, 1, 4)
    assert spark.range(1).select(*cores.bracket(F.lit(5))).first()[:] == (3, 5)
    with pytest.raises(ValueError):
        cores.diagnose(e, "K4")


def test_window_sweep(spark):
    r = random.Random(3)
    rows = [("t", r.randrange(10 * 86400), r.randrange(12), r.randrange(12)) for _ in range(300)]
    df = spark.createDataFrame(rows, "graph string, ts long, u long, v long")
    out = cores.window_sweep(df, [86400, 10**9], starts=3, min_m=2).collect()
    assert out and all(x.alpha <= x.kappa_copy <= x.kappa for x in out)
    whole = {tuple(sorted((u, v))) for _, ts, u, v in rows if u != v and ts < max(x[1] for x in rows)}
    assert max(x.m for x in out) == len(whole)


def test_relabel_orders(spark):
    e = spark.createDataFrame([("g", 0, "z", "b"), ("g", 1, "b", "a"), ("g", 2, "z", "z")], "graph string, pos long, u string, v string")
    out, names = graphs.relabel(e)
    assert {r.label: r.id for r in names.collect()} == {"z": 0, "b": 1, "a": 2}
    assert sorted((r.u, r.v) for r in graphs.canonical(out).collect()) == [(0, 1), (1, 2)]
    ids = graphs.label_ids(spark.createDataFrame([("g", x) for x in "zab"], "graph string, label string"))
    assert {r.label: r.v for r in ids.collect()} == {"a": 0, "b": 1, "z": 2}


def test_registered_window_sweep_is_whole(spark, monkeypatch):
    day = spark.range(400 * 310).select(F.lit("g").alias("graph"), (F.floor(F.col("id") / 310) * 86400).alias("ts"), (F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v"))
    monkeypatch.setattr(registry.tables, "user_days", lambda spark, sf_dir: day)
    monkeypatch.setattr(cores, "diagnose", lambda e: e.groupBy("graph").agg(F.count(F.lit(1)).alias("m")))
    days = [r.window_days for r in registry.QUERIES["window_sweep"](spark, "").collect()]
    assert {d: days.count(d) for d in days} == {1.0: 6, 3.0: 6, 7.0: 6, 30.0: 6, 90.0: 6, 365.0: 6, 399.0: 1}


def test_registered_instances_are_whole(spark, monkeypatch):
    graphs_of = lambda e, *a: e.select("graph").distinct()
    monkeypatch.setattr(cores, "instance_report", graphs_of)
    monkeypatch.setattr(cores, "diagnose", graphs_of)
    hard = {r.graph for r in registry.QUERIES["hard_instances"](spark, "").collect()}
    assert len(hard) == 12 and "friendship_1024" in hard and {g.split("_")[1] for g in hard if g.startswith("disjointness")} == {"6", "9", "12", "16", "20"}
    scan = {r.graph for r in registry.QUERIES["object_scan"](spark, "").collect()}
    assert len(scan) == 10 and {g.split("_")[1] for g in scan} == {"7", "11", "13", "17", "19"}
