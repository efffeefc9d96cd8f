"""Queries on inputs that the driver's small tables do not have: no hyperedge of a fitting size, vertices dealt over many blocks."""

import datetime
import random
import re

import duckdb
import pytest

from hyperloom.operators import blocks, graphs, scores
from hyperloom.operators.hypergraph import Closure
from hyperloom.plans import registry

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Events of three minutes, each with more users than a hyperedge may have."""
    d = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '{START}' + INTERVAL 1 MINUTE * (i % 3) AS ts, CAST(i AS BIGINT) AS user_id, 'view' AS event_type FROM range(120) r(i)) TO '{d}/events.parquet'")
    return str(d)


def same_as_sql(spark, name, sf_dir, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    return found


def test_guard_without_hyperedges(spark, crowded):
    assert same_as_sql(spark, "c4_guard", crowded, "events") == [("minute_user", 0, True, "")]


def test_caps_without_hyperedges(spark, crowded):
    assert len(same_as_sql(spark, "cap_sensitivity", crowded, "events")) == 2


def random_incidence(spark):
    r = random.Random(5)
    rows = [(g, i, v * 7 + 3) for g in ("a", "b") for i in range(90) for v in r.sample(range(26), r.randint(1, 6))]
    return spark.createDataFrame(rows, "graph string, hid long, v long")


@pytest.mark.parametrize("pairs", [10, 120, 10**9])
def test_blocks_find_what_joins_find(spark, monkeypatch, pairs):
    """Many small blocks, some and one, chunks of few wedges: the triangles and counts of the plain joins."""
    monkeypatch.setattr(blocks, "PAIRS", pairs)
    monkeypatch.setattr(blocks, "WEDGES", 7)
    monkeypatch.setattr(blocks, "CELLS", 60)
    monkeypatch.setattr(blocks, "PART", 5)
    inc = random_incidence(spark)
    c, plain = Closure.of(inc), Closure.of(inc)
    assert (len(c.blocks.bounds) == 0) == (pairs == 10**9)
    tri = graphs.triangles(plain.edges, plain.degrees)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(c.triangles) == rows(tri.select(c.triangles.columns))
    free = plain._uncovered(tri)
    assert rows(c.cross) == rows(free.select(c.cross.columns))
    t = {r[:3]: r[3] for r in rows(graphs.triangle_edges(free).groupBy("graph", "u", "v").count())}
    every = {r[:3]: r[3] for r in rows(graphs.copy_bearing_k3(plain.edges))}
    held = graphs.triangle_edges(plain.covered.toDF("graph", "x", "y", "z"))
    covn = {r[:3]: r[3] for r in rows(held.groupBy("graph", "u", "v").count())}
    deg = {r[:2]: r[2] for r in rows(plain.degrees)}
    assert rows(c.blocks.degrees) == sorted((*k, d) for k, d in deg.items())
    want = [(g, u, v, *rest, t.get((g, u, v), 0), covn.get((g, u, v), 0), every.get((g, u, v), 0), deg[g, u], deg[g, v]) for g, u, v, *rest in rows(plain.edges)]
    assert rows(c.edge_table) == want and len(t) > 100


def test_triple_sensitivity_has_a_short_plan(spark):
    """The closure's tables are read, not planned anew for each cap and weighting."""
    df = registry.QUERIES["triple_sensitivity"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") < 60


@pytest.mark.parametrize("pairs", [10, 120, 10**9])
def test_blocks_count_the_cycles_that_joins_list(spark, monkeypatch, pairs):
    """Four-cycles per edge without a list of them, over blocks of any size and with the wedges of one vertex counted in parts."""
    monkeypatch.setattr(blocks, "PAIRS", pairs)
    monkeypatch.setattr(blocks, "WEDGES", 7)
    c = Closure.of(random_incidence(spark))
    ends = c.c4.selectExpr("graph", "stack(2, u1, v1, u2, v2) as (u, v)").groupBy("graph", "u", "v").count().collect()
    listed = {tuple(r)[:3]: r["count"] for r in ends}
    assert sorted(map(tuple, c.c4_edge_t.collect())) == sorted((*e, listed.get(e, 0)) for e in map(tuple, c.edges.select("graph", "u", "v").collect())) and sum(listed.values()) > 1000
    assert not re.search("x#.*y#", c.c4_edge_t._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("pairs", [10, 120])
def test_blocks_weigh_as_joins_do(spark, monkeypatch, pairs):
    """Weights meet the triangles where these are listed, so no listed triangle is shuffled; an edge without a weight meets none."""
    monkeypatch.setattr(blocks, "PAIRS", pairs)
    c = Closure.of(random_incidence(spark)).persisted()
    for w in (scores.weighting(c, "perfect"), scores.weighting(c, "mindeg").drop("t").filter("u % 3 > 0")):
        found, want = scores._weighed(c, w, None), scores.weighted_cross(c.cross, w)
        rows = lambda df: sorted(map(tuple, df.select(*want.columns).collect()))
        assert rows(found) == rows(want) and found.count() > 20
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        for f in (scores.p_succ, scores.second_moment):
            assert [r[1] for r in f(c, w).orderBy("graph").collect()] == pytest.approx([r[1] for r in f(c, w, cross=c.cross).orderBy("graph").collect()])


def joins(plan):
    """The joins of a plan."""
    below = [x for i in range(plan.children().size()) for x in joins(plan.children().apply(i))]
    return [plan, *below] if plan.nodeName() == "Join" else below


@pytest.mark.parametrize("name", ["edge_local_cost", "normalizer_inflation"])
def test_edges_do_not_meet_their_graph_by_a_join(spark, name):
    """A join by the graph's name alone would put all edges into one task; both sides are sums."""
    found = joins(registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
    alone = [j for j in found if j.condition().toString().count("=") == 1 and "(graph" in j.condition().toString()]
    assert alone and all("Aggregate" in side.toString() for j in alone for side in (j.left(), j.right()))
