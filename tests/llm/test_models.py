"""Language id, quality rules and language-model scores."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import langid, lm_score, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98 and got.score.between(0, 1).all()


def test_language_odd_texts(spark):
    rows = [(i, f"{'ab ba ' * 40}", "x") for i in range(40)] + [(100 + i, f"{'yz zy ' * 40}", "y") for i in range(40)] + [(200, "ab ba " * 12, None), (201, None, "x"), (202, "12 34", "x"), (203, "", "y"), (None, "zy yz " * 9, "y"), (204, "ab ba " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = langid.train(docs, F.lit(True), plan=langid.NetPlan(epochs=6))
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert [got[i].lang_pred for i in (0, 100, 200, 201, 202, 203, None, 204)] == ["x", "y", "x", "und", "und", "und", "y", "x"]
    assert got[201].score == 0 and 0.5 < got[204].score <= 1
    none = docs.limit(0)
    assert langid.train(none, F.lit(True)) is None and {r.lang_pred for r in langid.identify(docs.limit(3), None).collect()} == {"und"}


def test_gradient_is_the_slope():
    plan = langid.NetPlan(window=12, widths=(2, 3), filters=3, vector=2, epochs=1, batch=4, rate=0.0)
    r = np.random.default_rng(0)
    x, y = r.integers(1, 200, (4, 12)).astype(np.uint8), np.array([0, 1, 1, 0])
    net = langid.ByteNet(["a", "b"], plan)
    loss = lambda: -np.log(net.probabilities(x, net.tables())[np.arange(4), y]).mean()
    before = loss()
    langid.ByteNet.train(net, x, y)
    assert loss() == pytest.approx(before, abs=1e-6)  # a rate of 0 changes nothing
    object.__setattr__(plan, "rate", 0.01)
    for _ in range(30):
        net.train(x, y)
    assert loss() < before


def brute_quality(t):
    w = WORD.findall(t or "")
    seen, rep = {}, [False] * len(w)
    for i in range(len(w) - 7):
        j = seen.setdefault(tuple(w[i : i + 8]), i)
        if j != i:
            rep[i : i + 8] = rep[j : j + 8] = [True] * 8
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n, r = len(w), sum(rep)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_quality(spark):
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n \t\x0b"), (3, "a " * 100), (4, "x\n\ny\nx\n x"), (5, "日本 é 😀 #$ " * 9)]
    for i in range(60):
        w = [r.choice(["the", "of", "wort", "Les", "a|b", "c$", "\n", "ab", "xyz"]) for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            w += w[5:25] * r.randint(0, 3)
        rows.append((10 + i, r.choice([" ", "  ", "\n", " \t"]).join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = quality.quality_rules(docs).collect()
    want = {i: brute_quality(t) for i, t in rows}
    assert {q.doc_id: (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) for q in got} == want
    assert all(not (q.base_failed and q.kept) for q in got) and quality.quality_rules(docs.limit(0)).count() == 0


def test_rules_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_rules(docs).join(labels, "doc_id").toPandas()
    good = got[~got.base_failed]
    assert good[good.quality == 1].kept.mean() > 0.99 and good[good.quality == 0].kept.mean() < 0.1


def test_scores_are_the_automaton(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["a", "B", "cc", "d", "E\n", "f"]) + r.choice(["", "", "x", "y"]) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(200, None), (201, ""), (202, "never seen"), (None, "a b"), (3, "a a")]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    lower = lambda t: WORD.findall((t or "").lower())
    a = lm_score.BackoffAutomaton([lower(t) for i, t in rows if train(i)])
    n, v = sum(a.seen.values()), len(a.seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.score_texts(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2).collect()
    key = lambda i, t: (i is None, i or 0, round(t, 6))
    want = sorted((key(i, a.score(lower(t))), len(lower(t)) + 1, sum(w in a.seen for w in [*lower(t), a.end]), round(sum(np.log10((a.seen.get(w, 0) + 1) / (n + v + 1)) for w in [*lower(t), a.end]), 6)) for i, t in rows)
    assert sorted((key(q.doc_id, q.score), q.n_tokens, q.n_known, round(q.base_score, 6)) for q in got) == want
    assert {q.train_tokens for q in got} == {n}
    assert lm_score.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert {q.score for q in lm_score.score_texts(docs, F.lit(None).cast("boolean")).collect()} == {0.0}


def test_automaton_sums_to_one():
    a = lm_score.BackoffAutomaton([list("abca"), list("ab"), list("abab"), []], strength=2.0)
    assert any(len(h) == 2 for h in a.states) and ("b", "c") not in a.states  # seen once: no state
    for h in a.states:
        total = 0
        for w in [*a.seen, "unseen"]:
            at, lp = h, 0.0
            while at and (at, w) not in a.arcs:
                lp, at = lp + a.failure[at], at[1:]
            total += 10 ** (lp + a.arcs.get((at, w), np.log10(a.unseen)))
        assert h[-1:] == (a.end,) and len(h) == 2 or total == pytest.approx(1)


def test_triples_matter(spark):
    """Texts whose pairs are alike and whose triples differ: only a state of two words tells them apart."""
    rows = [(i, "x b y") for i in range(30)] + [(100 + i, "z b w") for i in range(30)] + [(200, "x b w"), (201, "x b y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {q.doc_id: q.score for q in lm_score.score_texts(docs, F.col("doc_id") < 200, strength=1.0).collect()}
    assert got[201] > got[200] + 0.5


def test_arcs_fall_back():
    # state 1 follows word 0, state 2 the pair (0, 0); words 0 and 1
    arcs = lm_score.Arcs(2, np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1]), np.array([-1.0, -2.0, -0.5, -0.1]), np.array([0, 0, 1]), np.array([0.0, -0.3, -0.7]))
    assert arcs.read(np.array([0, 1, 1, 2, 2]), np.array([1, 0, 1, 1, 0])).tolist() == pytest.approx([-2.0, -0.5, -2.3, -0.1, -1.2])
