"""Readers, sinks, learning, bootstraps and streaming."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.operators import cores, learning, mining, sampling, scores
from hyperloom.operators.hypergraph import Closure, normalise
from hyperloom.sources import generators, readers
from hyperloom.streaming import windows


def test_simplices(spark, tmp_path):
    sizes, ids = [2, 3, 1, 4], list(range(10, 20))
    (tmp_path / "n.txt").write_text("\n".join(map(str, sizes)) + "\n")
    with gzip.open(tmp_path / "s.txt.gz", "wt") as f:
        f.write("\n".join(map(str, ids)))
    got = readers.read_simplices(spark, str(tmp_path / "n.txt"), str(tmp_path / "s.txt.gz"), "g")
    assert sorted((r.hid, r.v) for r in got.collect()) == [(0, 10), (0, 11), (1, 12), (1, 13), (1, 14), (2, 15), (3, 16), (3, 17), (3, 18), (3, 19)]


def test_lines_edges_temporal(spark, tmp_path):
    (tmp_path / "h.txt").write_text("# c\n1, 2 3\n\n a\tb \n")
    got = readers.read_hyperedge_lines(spark, str(tmp_path / "h.txt"), "g").collect()
    assert sorted((r.hid, r.label) for r in got) == [(0, "1"), (0, "2"), (0, "3"), (1, "a"), (1, "b")]
    (tmp_path / "e.txt").write_text("# c\nx y 5\ny z\n")
    assert [(r.pos, r.u, r.v) for r in readers.read_edge_list(spark, str(tmp_path / "e.txt"), "g").orderBy("pos").collect()] == [(0, "x", "y"), (1, "y", "z")]
    (tmp_path / "t.txt").write_text("1 2 30\n3 4\n5 6 10\n")
    assert [(r.ts, r.u, r.v) for r in readers.read_temporal(spark, str(tmp_path / "t.txt"), "g").orderBy("ts").collect()] == [(10, 5, 6), (30, 1, 2)]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"incidences": [{"edge": "e", "node": "x"}, {"edge": "e", "node": "y"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"edge-dict": {"p": ["x", "y"], "q": ["z"]}}))
    (tmp_path / "c.json").write_text("{}")
    read = lambda n: sorted((r.edge, r.label) for r in readers.read_hif(spark, str(tmp_path / n), "g").collect())
    assert read("a.json") == [("e", "x"), ("e", "y")] and read("b.json") == [("p", "x"), ("p", "y"), ("q", "z")]
    with pytest.raises(Exception, match="neither"):
        read("c.json")
    urls = spark.createDataFrame([(None, "h", "l"), ("u", None, None)], "url string, href string, link string")
    assert [r[0] for r in urls.select(readers.entry_url(F.col("url"), F.col("href"), F.col("link"))).collect()] == ["h", "u"]


def test_sinks(spark, tmp_path):
    h = normalise(generators.cliques_and_cross(spark, 2, 4, 3))
    readers.save_graphs(readers.union_graphs([h, h.withColumn("graph", F.lit("other"))]), str(tmp_path / "g"))
    assert readers.load_graphs(spark, str(tmp_path / "g"), ["other"]).count() == h.count()
    rep = spark.createDataFrame([("a", "m", 1.5)], readers.REPORT)
    readers.write_report(rep, str(tmp_path / "r"))
    assert readers.read_report(spark, str(tmp_path / "r"), readers.REPORT).collect() == rep.collect()
    assert readers.latex_rows(rep, ["label", "value"], 2).first().line == "a & 1.50 \\\\"
    assert readers.domains(spark, [("a", "x")]).first().domain == "x"


@pytest.fixture(scope="module")
def two(spark):
    inc = generators.cliques_and_cross(spark, 3, 6, 12, seed=1, graph="a").unionByName(generators.random_uniform(spark, 16, 30, 3, 2, "b"))
    c = Closure.of(inc).persisted()
    feats = mining.features(c, cores.core_numbers(c.edges.select("graph", "u", "v"))).cache()
    return c, feats


def test_ridge_is_least_squares(two):
    _, feats = two
    pdf = feats.filter("graph = 'b'").toPandas()
    x, y = pdf[[f"f{i}" for i in range(1, 14)]].to_numpy(), pdf.y.to_numpy()
    sx, sy = x.std(0) + 1e-12, y.std() + 1e-12
    z, t = (x - x.mean(0)) / sx, (y - y.mean()) / sy
    beta = np.linalg.solve(z.T @ z + 0.5 * np.eye(13), z.T @ t)
    model = learning.ridge_fit(feats, "ABC", 0.5)["b"]
    got = feats.filter("graph = 'b'").select(model.predicted().alias("p")).toPandas().p.to_numpy()
    assert got == pytest.approx((z @ beta) * sy + y.mean(), abs=1e-6)
    assert learning.ridge_weights(model, feats).agg(F.min("w")).first()[0] >= 0


def test_transfer_and_diagnosis(two):
    c, feats = two
    pairs = learning.transfer(c, feats, ("A", "ABC"), (0.1,)).cache()
    assert sorted({(r.train, r.test) for r in pairs.collect()}) == [("a", "b"), ("b", "a")]
    assert learning.block_difference(pairs).count() == 2 and learning.best_setting(pairs).count() == 2
    d = {r.graph: r for r in mining.feature_diagnosis(c, feats).collect()}
    pdf = feats.filter("graph = 'b'").toPandas()
    x = np.column_stack([pdf[[f"f{i}" for i in range(1, 8)]].to_numpy(), np.ones(len(pdf))])
    beta = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0]
    assert d["b"].A_r2_in_sample == pytest.approx(1 - (pdf.y - x @ beta).var(ddof=0) / pdf.y.var(ddof=0), abs=1e-6)


def test_trees(two):
    c, feats = two
    t = learning.trees_fit(feats.filter("graph = 'b'"), "A", rounds=3, depth=2)["b"]
    w = learning.trees_weights(t, feats)
    assert w.count() == feats.count() and scores.p_succ(c, w).count() == 2


def test_bootstraps(spark):
    pairs = spark.createDataFrame([(a, b, float(i + j)) for i, a in enumerate("abcd") for j, b in enumerate("abcd") if a != b], "train string, test string, capture double")
    m = sampling.bootstrap_mean(pairs, "capture", 300).first()
    assert m.lo < m.mean == 3.0 < m.hi
    c = sampling.cluster_bootstrap(pairs, "capture", b=300).first()
    assert c.lo < 3 < c.hi and c.hi - c.lo > m.hi - m.lo
    line = spark.createDataFrame([(float(i), 2.0 * i + (i % 2)) for i in range(12)], "x double, y double")
    s = sampling.bootstrap_slope(line, "y", "x", 300).first()
    assert s.slope_lo < s.slope < s.slope_hi and 1.8 < s.slope < 2.2
    assert sampling.bootstrap_slope(line.limit(3), "y", "x", 50).first().slope is None


def test_streaming(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", 1, [3, 1, 2, 2]), ("2024-01-01 00:40:00", 2, [1, 2]), ("2024-01-01 02:30:00", 3, [4, 5]), ("2024-01-01 06:00:00", 4, [7])]
    df = spark.createDataFrame(rows, "ts string, hid long, members array<bigint>").select(F.to_timestamp("ts").alias("ts"), "hid", "members")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.hyperedge_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = windows.window_pairs(stream).writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.u, r.v): r.nhy for r in spark.sql("select * from pairs").collect()}
    assert got.get((1, 2)) == 2 and got.get((1, 3)) == 1
    seen = []
    windows.closures(stream, lambda d, n: seen.extend(d.collect()), str(tmp_path / "c2")).awaitTermination()
    assert {r.graph: r.m for r in seen} == {"2024-01-01 00:00:00": 3}  # the window from 02:00 on is still open


def test_a_window_is_handed_over_once(spark, tmp_path):
    """A window whose hyperedges come in several micro-batches is counted whole, when the watermark has passed it."""
    kind = "ts string, hid long, members array<bigint>"
    parts = [[("2024-01-01 00:05:00", 1, [1, 2, 3])], [("2024-01-01 00:40:00", 2, [1, 4])], [("2024-01-01 03:00:00", 3, [8, 9])], [("2024-01-01 09:00:00", 4, [8, 9])]]
    seen = []
    schema = spark.createDataFrame(parts[0], kind).select(F.to_timestamp("ts").alias("ts"), "hid", "members").schema
    for i, rows in enumerate(parts):  # each run of the stream is a micro-batch
        spark.createDataFrame(rows, kind).select(F.to_timestamp("ts").alias("ts"), "hid", "members").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.hyperedge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        windows.closures(stream, lambda d, n: seen.extend(d.collect()), str(tmp_path / "c")).awaitTermination()
        assert i >= 2 or not seen
    assert sorted((r.graph, r.m) for r in seen) == [("2024-01-01 00:00:00", 4), ("2024-01-01 03:00:00", 1)]


def test_numbers_and_folders(spark, tmp_path):
    """Several numbers a line, and files of a folder in the order of their names."""
    (tmp_path / "sizes").mkdir()
    (tmp_path / "sizes" / "b.txt").write_text("2\n\n 1 3\n")
    (tmp_path / "sizes" / "a.txt").write_text("2 3\n")
    (tmp_path / "ids.txt").write_text("1 2 3\n4\t5\n\n6 7\n8\n9 10 11\n")
    got = readers.read_simplices(spark, str(tmp_path / "sizes"), str(tmp_path / "ids.txt"), "g")
    sets = {}
    for r in got.collect():
        sets.setdefault(r.hid, set()).add(r.v)
    assert sets == {0: {1, 2}, 1: {3, 4, 5}, 2: {6, 7}, 3: {8}, 4: {9, 10, 11}}
    (tmp_path / "many").mkdir()
    for name, n in (("a.txt", 1), ("b.txt", 5), ("c.txt", 2)):
        (tmp_path / "many" / name).write_text("".join(f"{name[0]}{i} x\n" for i in range(n)))
    lines = readers.read_edge_list(spark, str(tmp_path / "many"), "g").orderBy("pos").collect()
    assert [r.u for r in lines] == ["a0", "b0", "b1", "b2", "b3", "b4", "c0", "c1"] and [r.pos for r in lines] == list(range(8))
    (tmp_path / "t.txt").write_text("5 1 30\n2 9 10\n2 3 10\nshort\n")
    assert [(r.ts, r.u, r.v) for r in readers.read_temporal(spark, str(tmp_path / "t.txt"), "g").collect()] == [(10, 2, 3), (10, 2, 9), (30, 5, 1)]
