"""The text kernel, the exchange's packing and bounded running sums."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.llm import _exchange as x
from hyperloom.llm import _text
from hyperloom.llm._rank import running_sum

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\t\n\x0bé😀\x1f ", max_size=40)), max_size=8)


@settings(deadline=None, max_examples=150)
@given(texts, st.sampled_from([1, 7, 1 << 20]))
def test_words(ts, slab):
    before, _text._SLAB = _text._SLAB, slab
    try:
        w = _text.Words(pa.array(ts, pa.string()))
    finally:
        _text._SLAB = before
    want = [WORD.findall(t or "") for t in ts]
    got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[f : f + n], w.end[f : f + n])] for f, n in zip(w.first, w.count)]
    assert got == want
    flat = [v for t in want for v in t]
    assert len({*zip(flat, w.hash.tolist())}) == len(set(flat)) == len(set(w.hash.tolist()))
    g, at = _text.windows(w, 2)
    pairs = [tuple(t[i : i + 2]) for t in want for i in range(len(t) - 1)]
    assert len({*zip(pairs, g.tolist())}) == len(set(pairs)) == len(set(g.tolist())) and len(at) == len(pairs)


def test_lower_case_is_ascii_alone():
    a, b = (_text.Words(pa.array([t]), lower=True).hash for t in ("ABC É", "abc é"))
    assert a[0] == b[0] and a[1] != b[1]


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(v):
    h = np.array(sorted(v), np.uint64)
    assert (x.unpack_sorted(x.pack_sorted(h)) == h).all() and (x.unpack(x.pack(h)) == h).all()
    u = np.array(v, np.uint64)
    assert (x.stable_order(u) == np.argsort(u, kind="stable")).all()
    c = x.cuts(h, 5)
    assert c[0] == 0 and c[-1] == len(h) and (np.diff(c.astype(np.int64)) >= 0).all()


def test_running_sum_in_hot_groups(spark):
    df = spark.range(40_000).select((F.col("id") % 7 == 0).cast("int").alias("k"), "id").withColumn("o", F.xxhash64("id"))
    got = running_sum(df, ["k"], F.col("o"), F.lit(2), "at", 40_000).select("k", "o", "at").toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("o")
        assert (g["at"].to_numpy() == 2 * np.arange(len(g))).all()
