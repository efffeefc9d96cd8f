"""Token counts and files against the tokenizers library, on odd texts too."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hyperloom.llm import token_count as tc
from hyperloom.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "re", "ll", " ", "  ", "\n", "\t", "a", "b", "the", "12", "!!", "é", "日本", "<|endoftext|>", "\x1c", "don't", "I've", " hello", "\r\n", "😀", "'s", "ß", "×", "Ÿ", "\x85", " ", "　", "aaaaaaa", " internationalization"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd():
    r = random.Random(11)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(400)] + ["", " ", "x" * 3000, " " * 500 + "a", "<|endoftext|>"]


def test_counts_and_every_prefix(library, odd):
    with open(PATH, encoding="utf-8") as f:
        c = tc.PrefixCounter(f.read())
    for s in odd:
        assert c.count(s) == len(library(s)), s
    for s in odd[:250]:
        p = c.prefix_counts(s)
        assert p.tolist() == [len(library(s[:i])) for i in range(len(s) + 1)], s
        if len(p) > 3:
            k = tc.fits(p, 3)
            assert p[k] <= 3 and (k == len(s) or (p[k + 1 :] > 3).all())


def test_encoder_is_the_library(library, odd):
    with open(PATH, encoding="utf-8") as f:
        e = tf.PieceEncoder(f.read())
    for _ in range(2):  # new and remembered pieces
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(odd)] == [library(s) for s in odd]


def test_tables(spark, library, tmp_path):
    rows = [(5, "a b c", 1), (None, "null id", 2), (3, None, 3), (5, "same id", 4), (-2, "", 5), (7, "long " * 5000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tc.token_counts(docs, PATH, prefixes=True).collect()
    assert sorted((r.n_bytes, r.n_tokens, len(r.prefix_tokens)) for r in got) == sorted((len((t or "").encode()), len(library(t or "")), len(t or "") + 1) for _, t, _ in rows)
    path = str(tmp_path / "orc")
    tf.write_token_files(docs, path, PATH, end_id=2)
    back = tf.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, -2, 3, 5, 5, 7]
    ids = [i for r in back for i in r.ids]
    assert [r.start for r in back] == [0, *np.cumsum([len(r.ids) for r in back])[:-1].tolist()] and ids.count(2) >= 6
    dig = tf.digests(spark, path).orderBy("start").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in dig] == [(len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back]
    empty = docs.limit(0)
    assert tc.token_counts(empty, PATH).count() == 0
    tf.write_token_files(empty, str(tmp_path / "none"), PATH)


def test_fits_without_tables(library, odd):
    with open(PATH, encoding="utf-8") as f:
        c = tc.PrefixCounter(f.read())
    r = random.Random(3)
    plain = ["".join(r.choice([" ", "  ", "\n", "a", "the", "'re", "'", "9", "!!", "é", " thing"]) for _ in range(30)) for _ in range(60)]
    for s in odd[:150] + plain:
        counts = [len(library(s[:i])) for i in range(len(s) + 1)]
        for budget in (0, 1, 2, 5, 9, 10_000):
            assert c.fits(s, budget) == max(i for i, n in enumerate(counts) if n <= budget), (s, budget)


def test_budget_column(spark, library):
    rows = [(1, "word " * 40), (2, None), (3, "short")]
    got = {q.doc_id: q for q in tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, budget=10).collect()}
    assert got[2].fit_chars == 0 and got[3].fit_chars == 5
    text, n = rows[0][1], got[1].fit_chars
    assert len(library(text[:n])) <= 10 < len(library(text[: n + 1]))


def test_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 9)], "n_tokens long, text string, ids int")
    assert tc.token_counts(docs, PATH, id_column="n_tokens").collect()[0][2] == 2


def test_memory_forgets_nothing_needed(monkeypatch, library):
    monkeypatch.setattr(tc, "REMEMBERED", 5)
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    e, c = tf.PieceEncoder(spec), tc.PrefixCounter(spec)
    texts = [f"word{i % 17} other{i % 13} the thing" for i in range(100)]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [library(t) for t in texts]
    assert [c.count(t) for t in texts] == [len(library(t)) for t in texts]
    assert len(e.words) <= 5 and len(c.plain_words) <= 5 and len(c.plain_words.older) <= 5


def _rows_scanned(found) -> tuple[int, int]:
    """Rows found, and rows that the scan handed on."""
    n = len(found.collect())
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    return n, leaves.apply(0).metrics().apply("numOutputRows").value()


def test_an_id_search_reads_few_row_groups(spark, tmp_path):
    docs = spark.range(5000).select((F.col("id") * 2).alias("doc_id"), F.lit("some words here").alias("text"))
    path = str(tmp_path / "orc")
    tf.write_token_files(docs, path, PATH)
    n, scanned = _rows_scanned(spark.read.orc(path).filter("doc_id = 8642"))
    assert n == 1 and scanned <= 1000  # one row group of the index's stride
    missing = [_rows_scanned(spark.read.orc(path).filter(f"doc_id = {i}"))[1] for i in range(4001, 4061, 2)]
    assert sum(x == 0 for x in missing) >= 27  # within the statistics' ranges: only the Bloom filters can tell, one in a hundred fails


def test_bases_follow_file_numbers(spark, tmp_path):
    path = tmp_path / "orc"
    tf.write_token_files(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), str(path), PATH)
    first = next(path.glob("part-*.orc"))
    tf.write_token_files(spark.createDataFrame([(2, "a")], "doc_id long, text string"), str(tmp_path / "two"), PATH)
    second = next((tmp_path / "two").glob("part-*.orc"))
    for x in (first, second):
        crc = x.parent / f".{x.name}.crc"
        crc.unlink(missing_ok=True)
    first.rename(path / "part-99999-x.orc")
    second.rename(path / "part-100000-x.orc")
    assert {q.file: q.base for q in tf.file_bases(spark, str(path)).collect()} == {"part-99999-x.orc": 0, "part-100000-x.orc": 3}
    assert {q.doc_id: q.start for q in tf.digests(spark, str(path)).collect()} == {1: 0, 2: 3}


def test_empty_table_reads_back(spark, tmp_path):
    path = str(tmp_path / "none")
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH, end_id=2)
    assert tf.digests(spark, path).count() == 0 and tf.read_token_files(spark, path).count() == 0


def test_blocks_and_memory_change_nothing(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        e = tf.PieceEncoder(f.read())
    r = random.Random(7)
    plain = [p for p in PARTS if tc.PLAIN.fullmatch(p) and not p.startswith("<|")] + ["ve", "s", "t", "\x0b", "÷", "ſ", ","]
    texts = ["".join(r.choice(plain) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["x" * 300 + " y", " " * 300]
    want = [library(s) for s in texts]
    for block, words in ((4 << 20, 600_000), (40, 600_000), (4 << 20, 40), (1, 1)):
        monkeypatch.setattr(tf, "BLOCK_BYTES", block)
        monkeypatch.setattr(tc, "REMEMBERED", words)
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want
    ids, sizes = e.encode_column(pa.array(["skipped", "a b", None, "c"]).slice(1))
    assert sizes.tolist() == [2, 0, 1] and ids.tolist() == library("a b") + library("c")
