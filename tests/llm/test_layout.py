"""Mixing, packing and the pipeline."""

import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hyperloom.llm import mixing, packing
from hyperloom.llm._rank import told_apart
from hyperloom.llm._scratch import written

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= w[s] * level}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.fixture(scope="module")
def sources(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 90), "hot" if r.random() < 0.6 else r.choice(["a", "b", "Z", "é", None])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, " ", "only empty"), (7, rows[7][1], rows[7][2]), (None, "x y z", "b")]
    return rows, written(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")), "docs")


def test_mix(sources):
    rows, docs = sources
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size)
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "spans").collect()
    assert len(got) == len(rows)
    for s in size:
        own = [q for q in got if q.source == s]
        assert {q.source_size for q in own} == {size[s]} and own[0].target == pytest.approx(want[s])
        assert abs(sum(q.taken for q in own) - want[s]) <= max(0.01 * want[s], 4 * 32)
    for q in got:
        assert q.taken <= 2 * q["size"] and q.taken == sum(p["last"] - p["first"] for p in q.spans)
    again = mixing.mix(docs).select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(doc_id=q.doc_id, taken=q.taken)) for q in got)


def test_schedule_is_even(spark, sources):
    _, docs = sources
    sized = docs.select("source", mixing.word_count(F.col("text")).alias("size"))
    t = mixing.targets(sized, mixing.MixPlan())
    total = t.agg(F.sum("target")).first()[0]
    share = {r.sid: r.target / total for r in t.collect()}
    s = mixing.schedule(spark, t, mixing.MixPlan()).toPandas().sort_values("slot")
    for n in (50, 200, len(s)):
        for sid, k in s[:n].groupby("sid").size().items():
            assert abs(k - share[sid] * n) <= 6  # low discrepancy, at every stretch


def test_mix_reaches_every_target(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 90), "hot") for i in range(900)] + [(2000 + i, "w " * (1 + i % 40), f"s{i % 60:02}") for i in range(150)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, source string"), "docs")
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    want = brute_targets(size)
    for plan in (mixing.MixPlan(most_slots=20), mixing.MixPlan(), mixing.MixPlan(least_block=7)):
        got = mixing.mix(docs, plan).groupBy("source").agg(F.sum("taken").alias("n")).collect()
        assert len(got) == len(size) and all(abs(q.n - want[q.source]) <= 0.5 + 1e-6 for q in got)


def test_blocks_do_not_grow_with_the_corpus(spark):
    sizes = spark.createDataFrame([("big", 5_000_000_000), ("small", 200)], "source string, size long")
    t = {q.source: q for q in mixing.targets(sizes, mixing.MixPlan()).collect()}
    assert {q.block for q in t.values()} == {32} and t["small"].slots == 2 * 7 and t["small"].words == 400
    ids = [0, 1, 4_000_000, 13_600_000, 234_375_017, 2**40 + 3]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing.golden(F.col("id")).alias("u")).collect()
    assert all(q.u == q.id * mixing.GOLDEN % mixing.UNIT for q in got)


def test_mixed_texts(sources):
    rows, docs = sources
    words = sum(len((t or "").split()) for _, t, _ in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert n == mixing.mix(docs).agg(F.sum("taken")).first()[0] and abs(n - 1.5 * words) < 0.02 * words
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_bounds_are_optimal():
    r = random.Random(9)
    for _ in range(40):
        n = r.randint(1, 9)
        x, c = sorted(r.sample(range(1, 60), n)), [r.randint(1, 20) for _ in range(n)]
        k = r.randint(1, 5)
        cost = lambda b: sum(m * (min(t for t in b if t >= v) - v) for v, m in zip(x, c))
        got = packing.choose_bounds(x, c, k)
        assert len(got) <= k and got[-1] == x[-1]
        assert cost(got) == min(cost([*p, x[-1]]) for j in range(min(k, n)) for p in itertools.combinations(x[:-1], j))
    assert packing.choose_bounds([], [], 4) == []


def test_pack(spark):
    r = random.Random(2)
    rows = [(i, "w " * (40 if i % 3 == 0 else r.randint(0, 600))) for i in range(900)] + [(900, None), (901, "w " * 70_000), (3, "w " * 40), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = packing.pack_documents(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for t in {t for _, t in rows}}
    assert sorted(q.n_tokens for q in got) == sorted(n[t] for _, t in rows)
    assert {q.bucket_tokens for q in got} <= set(n.values())
    batches = {}
    for q in got:
        assert q.n_tokens <= q.bucket_tokens
        batches.setdefault((q.bucket, q.batch), []).append(q)
    for b in batches.values():
        assert sorted(q.slot for q in b) == list(range(len(b)))
        assert len({q.bucket_tokens for q in b}) == 1 and (len(b) == 1 or len(b) * b[0].bucket_tokens <= packing.TOKEN_BUDGET)
    for k in {q.bucket for q in got}:  # all but the last batch of a bucket are full
        n = [len(batches[k, i]) for i in range(max(b for c, b in batches if c == k) + 1)]
        assert len(set(n[:-1])) <= 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_bins_are_few_and_above(spark):
    x = spark.range(1, 300_000).select(F.col("id"), packing.bin_top(F.col("id")).alias("top"))
    q = x.agg(F.countDistinct("top").alias("n"), F.min(F.col("top") - F.col("id")).alias("least"), F.max(F.col("top") / F.col("id")).alias("most")).first()
    assert q.n < 3500 and q.least == 0 and q.most < 1.006


def test_pipeline_stages(spark):
    r = random.Random(4)
    vocab = ["the", "of", "and"] * 8 + [*("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(200))]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = [(i, text(80), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, text(50) + " " + passage, "en", "s1", 0), (102, passage + " " + text(70), "en", "s2", 0), (103, "short", "en", "s0", 0), (104, None, None, None, None), (105, "$$$ ### " * 60, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "stage")
        seen.append((name, docs.collect()))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [{q.doc_id for q in s} for _, s in seen]
    assert kept[0] == {*range(40), 100, 101, 102}
    assert kept[1] == kept[0] - {100}
    cut = {q.doc_id: q for q in seen[2][1]}
    assert set(cut) == kept[1] and len(cut[102].text.split()) == 70 and len(cut[101].text.split()) == 110 and cut[102].n_chars == len(cut[102].text)
    words = sum(len(q.text.split()) for q in seen[2][1])
    mixed = sum(len(q.text.split()) for q in seen[3][1])
    library = Tokenizer.from_file(PATH)
    assert abs(mixed - 1.5 * words) < 0.05 * words
    assert sorted(q.n_tokens for q in seen[4][1]) == sorted(len(library.encode(q.text, add_special_tokens=False).ids) for q in seen[3][1])
    assert len(seen[4][1]) == len(seen[3][1])


def test_pipeline_odd_tables(spark, tmp_path):
    """An empty table, null and repeated ids, clashing and extra columns, a hot source and a hot group of equal rows."""
    r = random.Random(8)
    vocab = ["the", "of", "and"] * 8 + [*("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(400))]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    same = text(50)
    rows = [(i, text(60), "en", "hot" if i % 3 else f"s{i}", 0, i) for i in range(60)] + [(7, same, "en", None, 0, 7)] * 40 + [(None, same, None, "hot", 0, None)] * 3 + [(200, "", "en", "hot", 0, 1), (201, None, "en", "hot", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, batch long")
    (tmp_path / "odd").mkdir()
    (tmp_path / "none").mkdir()
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "bucket", "bucket_tokens", "batch", "slot"]
    got = got.collect()
    assert {q.doc_id for q in got} <= {*range(60), None} and sum(q.doc_id is None for q in got) >= 3
    # all rows of one doc_id are one node: the forty equal rows and the other row 7 stay, and share the target of the null source
    assert sum(q.doc_id == 7 for q in got) >= 40


def test_equal_rows_are_told_apart(spark):
    rows = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") < 3000, F.lit(5)).otherwise(F.xxhash64("id")).alias("o"))
    rows = written(rows, "rows")
    one, two = (told_apart(x, "o", "row", 5000) for x in (rows, written(rows.repartition(7), "again")))
    assert one.select("o").distinct().count() == 5000
    assert sorted(q.o for q in one.collect()) == sorted(q.o for q in two.collect())


def test_mixing_broadcasts_no_pieces(spark):
    """Pieces are many more than the documents whose size Spark takes them for; sent to all, they went through the driver."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution()
    at = plan.sparkPlan().toString().splitlines()
    assert any("SortMergeJoin" in x and "block_no" in x for x in at) and not any("BroadcastHashJoin" in x and "block_no" in x for x in at)
