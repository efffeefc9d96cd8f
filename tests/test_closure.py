"""Closures against brute force over sets, on a hand-checked hypergraph and on random ones."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.functions.scalar import correlation
from hyperloom.operators import cores, graphs, mining, sampling, scores
from hyperloom.operators.hypergraph import Closure
from hyperloom.plans import reports

TINY = [(1, 2, 3), (3, 4), (2, 4), (4, 5), (1, 5)]


def frame(spark, hyperedges, graph="g"):
    rows = [(graph, i, v) for i, h in enumerate(hyperedges) for v in h]
    return spark.createDataFrame(rows, "graph string, hid long, v long")


class Brute:
    def __init__(self, hyperedges):
        self.hs = list(dict.fromkeys(tuple(sorted(set(h))) for h in hyperedges if 2 <= len(set(h)) <= 25))
        self.adj = {}
        for h in self.hs:
            for a, b in itertools.combinations(h, 2):
                self.adj.setdefault(a, set()).add(b)
                self.adj.setdefault(b, set()).add(a)
        self.edges = sorted((a, b) for a in self.adj for b in self.adj[a] if a < b)
        inside = lambda *v: any(set(v) <= set(h) for h in self.hs)
        self.tri = [t for t in itertools.combinations(sorted(self.adj), 3) if all(b in self.adj[a] for a, b in itertools.combinations(t, 2))]
        self.cross = [t for t in self.tri if not inside(*t)]
        self.t = Counter(e for t in self.cross for e in itertools.combinations(t, 2))
        self.c4 = []
        for q in itertools.combinations(sorted(self.adj), 4):
            for a, x, b, y in ((q[0], q[1], q[2], q[3]), (q[0], q[1], q[3], q[2]), (q[0], q[2], q[1], q[3])):
                if x in self.adj[a] and b in self.adj[x] and y in self.adj[b] and a in self.adj[y]:
                    self.c4.append((q, inside(*q)))


def random_hyperedges(seed, n=14, k=16):
    r = random.Random(seed)
    return [tuple(r.sample(range(n), r.randint(1, 5))) for _ in range(k)] + [(1, 1, 2)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tiny(spark):
    c = Closure.of(frame(spark, TINY)).persisted()
    assert rows(c.stats, "m", "n_cross", "n_triangles") == [(7, 1, 2)]
    assert {(u, v): t for u, v, t in rows(c.edge_t, "u", "v", "t") if t} == {(2, 3): 1, (2, 4): 1, (3, 4): 1}
    assert {v: s for v, s in rows(mining.vertex_scores(c), "v", "score") if s} == {2: 1, 3: 1, 4: 1}
    assert c.c4.count() == 3
    assert rows(graphs.c4_total(graphs.codegrees(c.edges)), "n_c4") == [(3,)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_brute_force(spark, seed):
    hs = random_hyperedges(seed)
    b, c = Brute(hs), Closure.of(frame(spark, hs)).persisted()
    assert rows(c.edges, "u", "v") == b.edges
    assert {(u, v): t for u, v, t in rows(c.edge_t, "u", "v", "t")} == {e: b.t[e] for e in b.edges}
    assert sorted(tuple(sorted(r)) for r in rows(c.cross, "x", "y", "z")) == sorted(b.cross)
    st = c.stats.first()
    assert (st.m, st.n_cross, st.n_triangles) == (len(b.edges), len(b.cross), len(b.tri))
    assert c.c4.count() == sum(not inside for _, inside in b.c4)
    assert graphs.c4_total(graphs.codegrees(c.edges)).first().n_c4 == len(b.c4)
    assert sum(s for _, s in rows(mining.vertex_scores(c), "v", "score")) == 3 * len(b.cross)


def test_two_graphs_do_not_mix(spark):
    both = frame(spark, TINY, "a").unionByName(frame(spark, random_hyperedges(4), "b"))
    one = Closure.of(frame(spark, TINY, "a")).stats.first()
    st = {r.graph: r for r in Closure.of(both).stats.collect()}
    assert (st["a"].m, st["a"].n_cross) == (one.m, one.n_cross) and st["b"].m == len(Brute(random_hyperedges(4)).edges)


def test_empty(spark):
    c = Closure.of(frame(spark, [(1,)]))
    assert c.edges.count() == c.cross.count() == c.stats.count() == c.c4.count() == 0
    assert cores.core_numbers(c.edges.select("graph", "u", "v")).count() == 0


def test_weights_identities(spark):
    hs = random_hyperedges(7, 16, 24)
    b, c = Brute(hs), Closure.of(frame(spark, hs)).persisted()
    uni, perf = scores.weighting(c, "uniform"), scores.weighting(c, "perfect")
    deg = {v: len(x) for v, x in b.adj.items()}
    rank = {v: i for i, v in enumerate(sorted(deg, key=lambda v: (deg[v], v)))}
    m, n = len(b.edges), len(b.cross)
    for w, f in ((uni, lambda e: 0), (perf, lambda e: b.t[e])):
        wp = {e: f(e) + 1 for e in b.edges}
        key = lambda p, q: (min(p, q), max(p, q))
        d = {v: sum(wp[key(v, x)] for x in b.adj[v]) for v in b.adj}
        p = m2 = 0
        for t in b.cross:
            x, y, z = sorted(t, key=rank.get)
            pr = wp[key(x, y)] / sum(wp.values()) * wp[key(x, z)] / d[x]
            p += pr
            m2 += 1 / pr
        assert scores.p_succ(c, w).first().p == pytest.approx(p)
        assert scores.second_moment(c, w).first().m2 == pytest.approx(m2)
    assert scores.wedge_weighted_cost(c, uni).first().samples == pytest.approx(scores.wedge_cost(c).first().samples)
    t = np.array([b.t[e] for e in b.edges], float)
    loc = np.array([deg[u] + deg[v] for u, v in b.edges], float)
    assert scores.edge_local_cost(c).first().words == pytest.approx((m * t / 3).var() / (0.1 * n) ** 2 * loc.mean())
    order = sorted(range(m), key=lambda i: (-t[i], b.edges[i]))
    taus = np.unique(np.clip(np.round(np.geomspace(1, max(m, 2), 25)).astype(int), 1, m))
    best = min((tau + ((m - tau) * t[order[tau:]] / 3).var() / (0.1 * n) ** 2 * loc[order[tau:]].mean() if tau < m else float(tau)) for tau in taus)
    assert scores.heavy_storage_cost(c).first().words == pytest.approx(best)


def test_permutation_null_repeats_numpy(spark):
    hs = random_hyperedges(9, 16, 24)
    b, c = Brute(hs), Closure.of(frame(spark, hs)).persisted()
    deg = {v: len(x) for v, x in b.adj.items()}
    rank = {v: i for i, v in enumerate(sorted(deg, key=lambda v: (deg[v], v)))}
    t = np.array([b.t[e] for e in b.edges], float)
    got = dict(rows(sampling.permutation_null(c, "g", 4, 10), "seed", "perm"))
    for s in range(10, 14):
        wp = dict(zip(b.edges, np.random.default_rng(s).permutation(t) + 1))
        key = lambda p, q: (min(p, q), max(p, q))
        d = {v: sum(wp[key(v, x)] for x in b.adj[v]) for v in b.adj}
        want = sum(wp[key(x, y)] * wp[key(x, z)] / d[x] for x, y, z in (sorted(q, key=rank.get) for q in b.cross)) / sum(wp.values())
        assert got[s] == pytest.approx(want)


def test_simulation_is_unbiased(spark):
    c = Closure.of(frame(spark, random_hyperedges(7, 16, 24))).persisted()
    w = scores.weighting(c, "perfect")
    truth = c.stats.first()
    est = [r.estimate for r in sampling.simulate_estimator(c, w, 4000, 3).collect()]
    assert np.mean(est) == pytest.approx(truth.n_cross, rel=0.15)
    prof = sampling.simulate_profile(c, w, 8000, 1).first()
    assert prof.n_triangles == pytest.approx(truth.n_triangles, rel=0.2)
    check = sampling.monte_carlo_check(c, w, 8000).first()
    assert check.hit_rate == pytest.approx(check.p, rel=0.15)


def test_ranking_measures(spark):
    est = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate([5, 4, 3, 2, 1])], "graph string, v long, score double")
    ex = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate([1, 5, 4, 2, 2])], "graph string, v long, score double")
    assert mining.precision_at_k(est, ex, 2).first().precision == 0.5
    a, b = np.array([5, 4, 3, 2, 1]), np.array([1, 5, 4, 2.5, 2.5])
    rank = lambda x: np.array([np.mean([sorted(x).index(v), len(x) - 1 - sorted(x)[::-1].index(v)]) for v in x])
    assert mining.rank_correlation(est, ex).first().rho == pytest.approx(np.corrcoef(rank(a.tolist()), rank([1, 5, 4, 2, 2]))[0, 1])
    assert mining.gini(ex.withColumnRenamed("score", "x"), "x").first().gini == pytest.approx(sum(abs(p - q) for p in (1, 5, 4, 2, 2) for q in (1, 5, 4, 2, 2)) / (2 * 25 * 2.8))
    del b


def test_domain_separation(spark):
    p = spark.createDataFrame([("a", "x", 0.0, 1.0), ("b", "x", 0.1, 1.0), ("c", "y", 5.0, 3.0), ("d", "y", 5.1, 3.0), ("e", "y", 0.3, 1.0)], "label string, domain string, p double, q double")
    assert mining.domain_separation(p, ["p", "q"]).first().accuracy == pytest.approx(4 / 5)


def test_sampled_triples_scale(spark):
    c = Closure.of(frame(spark, random_hyperedges(7, 16, 24))).persisted()
    assert c.sampled_cross(10**9).count() == c.cross.count()
    s = c.sampled_cross(5)
    assert s.count() <= c.cross.count() and s.agg(F.min("scale")).first()[0] >= 1


@pytest.mark.parametrize("kind", ["path", "wedge", "c4"])
def test_joined_null_has_the_distribution_of_the_array_form(spark, kind):
    c = Closure.of(frame(spark, random_hyperedges(5, 14, 22))).persisted()
    array = [r.perm for r in sampling.permutation_null(c, "g", 60, kind=kind).collect()]
    joined = [r.perm for r in sampling.permutation_null_joined(c, 60, kind=kind).collect()]
    spread = np.std(array) / np.sqrt(60) + np.std(joined) / np.sqrt(60)
    assert len(joined) == 60 and abs(np.mean(array) - np.mean(joined)) < 5 * spread + 1e-12
    # the identity shuffle: every edge keeps its own weight, so the scores are those of the perfect weights
    one = Closure.of(frame(spark, [(1, 2), (2, 3), (1, 3)]))
    assert {round(r.perm, 9) for r in sampling.permutation_null_joined(one, 3, kind="path").collect()} == {round(scores.p_succ(one, scores.weighting(one, "perfect")).first().p, 9)}


def test_positions_in_hot_groups(spark):
    from hyperloom.functions.ranks import positions

    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), F.xxhash64("id").alias("h"), "id").repartition(5)
    got = positions(df, ["g"], [F.col("h").desc(), "id"], "r").collect()
    for g in {q.g for q in got}:
        part = sorted((q for q in got if q.g == g), key=lambda q: (-q.h, q.id))
        assert [q.r for q in part] == list(range(len(part)))


def test_second_formulation(spark):
    c = Closure.of(frame(spark, random_hyperedges(9, 15, 25)))
    pick = lambda df: sorted((r.u, r.v, r.t) for r in df.select("u", "v", "t").collect())
    assert pick(c.edge_difference) == pick(c.edge_cross)


def test_sampled_triples_are_the_drawn_edges(spark):
    c = Closure.of(frame(spark, random_hyperedges(7, 16, 24))).persisted()
    key = lambda r: (min(r.x, r.y), max(r.x, r.y))
    some = c.sampled_cross(10).collect()
    drawn = {key(r) for r in some}
    assert some and sorted((r.x, r.y, r.z) for r in some) == sorted((r.x, r.y, r.z) for r in c.cross.collect() if key(r) in drawn)


def test_guard_comes_before_listing(spark):
    two = frame(spark, random_hyperedges(3, 8, 10), "small").unionByName(frame(spark, random_hyperedges(4, 20, 40), "large"))
    c = Closure.of(two)
    n = {r.graph: r.n for r in c.degrees.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).collect()}
    guard = {r.graph: r for r in c.c4_guard(max_n=n["small"]).collect()}
    assert guard["small"].ok and guard["large"].reason == "vertices" and guard["large"].n_c4 is None
    left = c.within_guard(max_n=n["small"])
    assert {r.graph for r in left.hyperedges.select("graph").distinct().collect()} == {"small"}


def test_report_helpers(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("b", 3, "x"), ("c", 5, "y")], "graph string, m int, best string")
    d = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "graph string, domain string")
    got = {q.domain: (q.graphs, q.m_min, q.m_max, q.m_mean, q.m_std) for q in reports.summary(r, d, ["m"]).collect()}
    assert got == {"p": (2, 1, 3, 2.0, 1.0), "q": (1, 5, 5, 5.0, 0.0)}
    assert {q.best: q.graphs for q in reports.wins(r).collect()} == {"x": 2, "y": 1}


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(correlation("a", "b")).first()[0] == 0.0
