"""Jaccard join, substring dedup and vector dedup against brute force, with planted groups and odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import _rank, embed_dedup, jaccard_join, substring
from hyperloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = text(60)
    rows, i = [], 0
    for _ in range(25):
        base = text(r.randint(1, 80))
        for k in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(k * r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.2:
                at = r.randrange(len(w) + 1)
                w[at:at] = passage
            rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
            i += 3
    hot = text(120)  # a large group of near copies, and one of exact copies
    for k in range(60):
        w = list(hot)
        for _ in range(2):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, "exact copy of words that all these texts have and a few more " * 2) for k in range(40)]
    rows += [(5001, None), (5002, ""), (5003, " \n\t"), (5004, "One"), (5005, "one"), (5006, "a b c d"), (5007, "A B c d"), (5008, "a b c"), (5009, "w " * 400)]
    r.shuffle(rows)
    return rows


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = union(ids, links)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    rows, found = jaccard_join.jaccard_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()} == {i: (len(sets[i]), comp[i]) for i in ids}
    assert {tuple(sorted((r.a, r.b))) for r in found.collect()} <= set(links)
    stay = jaccard_join.one_per_component(docs.withColumn("component_id", F.lit(1)))
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i in ids if comp[i] == i) and stay.columns == ["doc_id", "text", "component_id"]


def test_jaccard_odd_ids(spark):
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t), (None, None)], "doc_id long, text string")
    rows, _ = jaccard_join.jaccard_components(docs)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows.collect() if r.doc_id) == [(4, 3, 4), (4, 3, 4), (9, 3, 4)]
    assert [r.component_id for r in rows.collect() if r.doc_id is None] == [None, None]
    assert jaccard_join.jaccard_components(docs.limit(0))[0].count() == 0


def test_jaccard_gives_every_link(spark, corpus, monkeypatch):
    sets = {i: shingles(t) for i, t in corpus}
    ids = sorted(sets)
    links = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    for block in (128, 7):  # the near copies in one block, and in many
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "MEETING", block)
        monkeypatch.setattr(jaccard_join, "LOT", block)
        monkeypatch.setattr(_rank, "HOT_ROWS", 5 * block)
        rows, found = jaccard_join.jaccard_components(docs)
        assert sorted((r.a, r.b) for r in found.collect()) == sorted(links)
        assert {r.doc_id: r.n_links for r in rows.collect()} == {i: sum(i in p for p in links) for i in ids}


def test_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 8)
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 90).astype(np.uint64) * np.uint64(2)
    a, b = ([r.choice(pool, r.integers(1, 70), replace=False) for _ in range(m)] for m in (9, 5))
    assert jaccard_join.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_suffix_bound_holds():
    r = np.random.default_rng(1)
    for _ in range(50):
        pool = r.integers(0, 2**63, 40).astype(np.uint64)
        a, b = r.choice(pool, 25, replace=False), r.choice(pool, 20, replace=False)
        c = r.choice(pool, 9, replace=False)
        bounds = jaccard_join.suffix_bounds(a, np.concatenate([b, c]), np.repeat([0, 1], [len(b), len(c)]), 2)
        assert (bounds >= [len(np.intersect1d(a, b)), len(np.intersect1d(a, c))]).all()


def test_similar_is_exact():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
    others = [np.concatenate([r.choice(base, k, replace=False), r.integers(0, 2**63, m).astype(np.uint64)]) for k in (60, 55, 52, 45, 44, 3) for m in (0, 1, 8, 30)]
    want = [100 * len(np.intersect1d(base, y)) >= 75 * len(np.union1d(base, y)) for y in others]
    assert jaccard_join.similar(base, others, 75).tolist() == want and 3 < sum(want) < 20


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(_rank, "HOT_ROWS", 20)
    rows = spark.range(300).select(F.col("id").alias("x"), F.when(F.col("id") < 100, 7).otherwise(F.col("id") % 50).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("m")).filter("k <> 3")
    got = sorted(tuple(q) for q in _rank.join_hot(rows, table, ["k"], "n", 300).select("x", "k", "m").collect())
    assert got == sorted(tuple(q) for q in rows.join(table, "k").select("x", "k", "m").collect()) and len(got) > 250


def test_components_of_paths_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(_rank, "HOT_ROWS", 30)
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(5, 5), (None, 3), (60, 50), (50, 60)]
    r.shuffle(links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [(a, b) for a, b in links if a and b and a != b]
    assert got == union({n for e in clean for n in e}, clean)


def brute_removal(rows, k=13):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out, words


def test_substring(spark, corpus):
    want, words = brute_removal(corpus)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id long, text string, spans string, n_chars int")
    got = substring.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: w[:3] for i, w in want.items()}
    for r in got:
        assert r.text == (None if r.doc_id == 5001 else want[r.doc_id][3])
        for s in r.spans:  # each path is the source's, window by window
            n = s["last"] - s["first"] + 13
            assert s["source"] < r.doc_id and words[r.doc_id][s["first"] : s["first"] + n] == words[s["source"]][s["source_first"] : s["source_first"] + n]
    back = substring.deduplicated(docs.drop("spans"))
    assert back.columns == ["doc_id", "text", "n_chars"] and back.count() == len(corpus)
    assert back.filter("n_chars <> length(text)").count() == 0


def test_nothing_goes_without_paths(spark, corpus, monkeypatch):
    """What is removed stands on compacted paths."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    plain = substring.compact
    monkeypatch.setattr(substring, "compact", lambda parts: plain(parts).limit(0))
    assert substring.remove_repeats(docs).filter("n_removed > 0").count() == 0


def test_words_are_compared(spark, corpus, monkeypatch):
    """With hashes of 13 bits many windows share one, but only equal words go, and only if no smaller document has the hash."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    want, _ = brute_removal(corpus)
    plain = substring._walk

    def garbled(chunk, e, answers, k):
        table = plain(chunk, e, answers, k)
        words = [x and x.replace(b"a", b"z") for x in table["words"].to_pylist()]
        return table.set_column(table.column_names.index("words"), "words", pa.array(words, pa.binary()))

    monkeypatch.setattr(substring, "_walk", garbled)  # sources whose words are others than their hashes say
    got = {q.doc_id: q.n_removed for q in substring.remove_repeats(docs).collect()}
    assert all(got[i] <= want[i][1] for i in got) and sum(got.values()) < sum(x[1] for x in want.values()) / 2


def test_paths_compact_across_sources(spark):
    """Nodes with one interval in and one out join intervals of different sources; a branch and a ring do not."""
    rows = [(1, 0, 5, 100, 101), (2, 7, 4, 101, 102), (3, 0, 2, 102, 103), (3, 2, 3, 103, 104), (4, 0, 9, 103, 105), (5, 0, 6, 200, 201), (6, 0, 6, 201, 200)]
    parts = spark.createDataFrame(rows, "src long, at long, n long, head long, tail long").withColumn("run", F.lit(0)).withColumn("starts", F.lit(1))
    got = {(q.src, q.at): (q.path_src, q.path_at, q.path_offset) for q in substring.compact(parts).collect()}
    assert got == {(1, 0): (1, 0, 0), (2, 7): (1, 0, 5), (3, 0): (1, 0, 9), (3, 2): (3, 2, 0), (4, 0): (4, 0, 0), (5, 0): (5, 0, 0), (6, 0): (6, 0, 0)}


def test_hot_passage_in_lots(spark, monkeypatch):
    monkeypatch.setattr(substring, "LOT", 3)
    monkeypatch.setattr(_rank, "HOT_ROWS", 10)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} " + passage + f" c{i}") for i in range(90)]
    got = {q.doc_id: (q.n_removed, q.text) for q in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (30 if i else 0, t if not i else f"a{i} b{i} c{i}") for i, t in rows}


def test_substring_odd_ids(spark):
    t = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, t), (8, t), (8, t), (9, t), (-3, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeats(docs).collect())
    assert got == [("-3", 0), ("8", 0), ("8", 0), ("9", 20), ("None", 0)]
    # rows of one id with different texts at the same places
    u = " ".join(f"u{i}" for i in range(25))
    docs = spark.createDataFrame([(3, t), (3, u), (3, u), (7, u + " " + t), (9, t), (9, "x " + u)], "doc_id long, text string")
    got = sorted((q.doc_id, q.n_words, q.n_removed) for q in substring.remove_repeats(docs).collect())
    assert got == [(3, 20, 0), (3, 25, 0), (3, 25, 0), (7, 45, 45), (9, 20, 20), (9, 26, 25)]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("aim", [1024, 24])
def test_vectors(spark, aim, monkeypatch):
    """With few rows in one cell, and with many cells, tables and blocks."""
    r = np.random.default_rng(3)
    rows, i = [], 0
    for label in range(3):
        for _ in range(60):
            base = r.normal(size=16)
            for k in range(int(r.integers(1, 4))):
                rows.append((i, [float(v) for v in (base + k * r.normal(size=16) * 0.22).astype(np.float32)], label))
                i += 2
    hot = r.normal(size=16)
    rows += [(3000 + k, [float(v) for v in hot.astype(np.float32)], 1) for k in range(30)]
    rows += [(4000 + k, [float(v) for v in (hot + r.normal(size=16) * 0.02).astype(np.float32)], 1) for k in range(90)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [None] + [1.0] * 15, 1), (9004, rows[0][1], None), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [1.0], 1), (9007, [], 1), (9008, [1e-30 * v for v in rows[-1][1]], 1)]
    plain = embed_dedup.Plan.make
    monkeypatch.setattr(embed_dedup.Plan, "make", staticmethod(lambda d, c, n: plain(d, c, n, aim=aim)))
    monkeypatch.setattr(embed_dedup, "BLOCK", 50 if aim == 24 else 2048)
    short = [(9100, [1.0, 2.0], 1), (9102, [1.0, 2.0], 1), (9104, [1.1, 2.0], 1), (9106, [2.0, -1.0], 1), (9108, [5.0], 2), (9110, [3.0], 2), (9112, [-3.0], 2)]
    good = rows + [odd[-1]]
    ids, lab = [x[0] for x in good], np.array([x[2] for x in good])
    x = np.array([x[1] for x in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    comp = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(link)))])
    want = {n: (int(k), comp[n], comp[n] == n) for n, k in zip(ids, link.sum(1))} | {o[0]: (0, o[0], True) for o in odd[:-1]}
    want |= {9100: (2, 9100, True), 9102: (2, 9100, False), 9104: (2, 9100, False), 9106: (0, 9106, True), 9108: (1, 9108, True), 9110: (1, 9108, False), 9112: (0, 9112, True)}
    del want[9006]
    want[9006] = (0, 9006, True)
    df = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<double>, label int")
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in embed_dedup.near_duplicates(df).collect()}
    assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_windows_are_counted():
    """Window collisions in the sorted orders are what comparing all projections gives."""
    r = np.random.default_rng(4)
    p = embed_dedup.Plan.make(16, 0.93, 100)
    x, y = r.normal(size=(70, 16)), r.normal(size=(90, 16))
    y[:20] = x[:20] + 0.05 * r.normal(size=(20, 16))
    counted = p.directions()[2]
    px, py = x @ counted.T, y @ counted.T
    got = embed_dedup.collisions(*embed_dedup.query_windows(px, py, p.window))
    assert (got == (np.abs(px[:, None] - py[None]) <= p.window).sum(2)).all() and got[:20, :20].diagonal().min() >= p.least


def test_links_need_the_count(monkeypatch):
    """Pairs whose windows collide too seldom are not verified."""
    x = np.eye(16)[[0, 0]]
    p = embed_dedup.Plan.make(16, 0.93, 2)
    cells = np.zeros((2, 1), np.int64)
    assert embed_dedup.link_block(x, None, cells, None, 0, p)[0].tolist() == [0]
    monkeypatch.setattr(embed_dedup, "collisions", lambda place, begin, width: np.zeros((len(begin), len(place)), np.int8))
    assert embed_dedup.link_block(x, None, cells, None, 0, p)[0].tolist() == []


def test_vectors_odd_tables(spark):
    df = spark.createDataFrame([("7", [1.0, 0.0], 1, 5), ("8", [1.0, 0.01], 1, 5), ("x", [1.0, 0.0], 1, 5), (None, [1.0, 0.0], 1, 5), ("9", [1.0] * 5000, 1, 5), ("11", [1.0] * 5000, 1, 5)], "vec_id string, embedding array<double>, label int, n_links int")
    got = sorted((str(q.vec_id), q.n_links, str(q.component_id)) for q in embed_dedup.near_duplicates(df).collect())
    assert got == [("11", 1, "9"), ("7", 1, "7"), ("8", 1, "7"), ("9", 1, "9"), ("None", 0, "None"), ("None", 0, "None")]


def test_plan_recall():
    """The planned recall, measured on pairs exactly at the threshold."""
    r = np.random.default_rng(8)
    p = embed_dedup.Plan.make(64, 0.93, 200_000)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    meet = (embed_dedup._cells(x, p) == embed_dedup._cells(y, p)).any(1)
    counted = p.directions()[2]
    count = (np.abs(x @ counted.T - y @ counted.T) <= p.window).sum(1)
    assert p.coarse > 0 and (meet & (count >= p.least)).mean() >= 0.999
