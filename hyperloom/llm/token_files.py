"""Token ids in ORC: integer run-length encoded lists in id order, with row indexes and Bloom filters on the document id.

Rows are dealt by ranges of ids, so files and the stripes in them follow one another in id order.  A reader takes stripes
in parallel, and a search for an id skips files, stripes and row groups by their statistics and filters.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import token_count
from .token_count import ODD_SPACE, PIECE, PLAIN, STANDARD, byte_letters

#: Text bytes of a file, text bytes of a block of words, and pieces that a batch of texts brings to a worker's memory.  Words remembered after a block
#: are ``token_count.REMEMBERED`` at most; what is forgotten is encoded again, which changes no result.
FILE_BYTES, BLOCK_BYTES, PIECES = 32 << 20, 4 << 20, 250_000
_NONE, _LETTER, _DIGIT, _MARK, _SPACE, _WHITE = range(6)
_BREAK = re.compile(rb"(?<=[^\t-\r ])[\t-\r ]")


def _classes() -> np.ndarray:
    """The class of each byte of a text of ``PLAIN`` characters; bytes from 128 on belong to letters there, and other texts have a byte of none."""
    out = np.zeros(256, np.uint8)
    out[33:127] = _MARK
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = _LETTER
    out[9:14], out[32] = _WHITE, _SPACE
    out[0x80:0xC0] = out[0xC3:0xC6] = _LETTER
    return out


_CLASS = _classes()


def plain_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of the texts data[at[i] : at[i + 1]] has ``PLAIN`` characters alone."""
    odd = _CLASS[data] == _NONE
    lead = np.flatnonzero(data[:-1] == 0xC3)
    odd[lead[np.isin(data[lead + 1], (0x97, 0xB7))]] = True  # the signs of multiplication and division
    out = np.ones(len(at) - 1, bool)
    out[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = False
    return out


def word_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the words of ``token_count.WORD`` start in plain texts that follow one another and start at ``firsts``.  Words leave nothing out."""
    kind = _CLASS[data]
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[firsts] = after[firsts[firsts > 0] - 1] = _NONE
    white = kind >= _SPACE
    start = ~white & (kind != before) & (before != _SPACE)
    start |= white & ((before < _SPACE) | ((after != _NONE) & (after < _SPACE)))
    tick = np.flatnonzero((data == ord("'")) & start & (after == _LETTER))
    if len(tick):
        one = tick[np.isin(data[tick + 1], np.frombuffer(b"stmd", np.uint8))]
        two = tick[after[tick + 1] == _LETTER]
        x, y = data[two + 1], data[two + 2]
        two = two[((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l")))]
        for ticks, size in ((one, 2), (two, 3)):
            start[ticks + 1] = False
            ends = ticks + size
            start[ends[ends < len(data)]] = True
    return np.flatnonzero(start)


def _spread(lists: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ids[at[k] : at[k + 1]] for the numbers ``lists`` one after another, and their borders."""
    size = at[lists + 1] - at[lists]
    ends = np.concatenate(([0], np.cumsum(size)))
    return ids[np.repeat(at[lists] - ends[:-1], size) + np.arange(ends[-1])], ends


class PieceEncoder:
    """Token ids as the library gives them.

    Texts of plain characters fall into words by the pre-tokenizer's pattern, whole blocks of texts at once, and the library's BPE model encodes
    each word that the worker does not remember.  Other texts are cut into pieces that the pre-tokenizer never joins; plain pieces go the same
    way, all others, and all pieces of a tokenizer with another pre-tokenizer, go through the library as they are.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(tokenizer_json)
        own = spec.get("pre_tokenizer") or {}
        self.plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and all(own.get(k) == v for k, v in STANDARD.items())
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}
        self.words = pa.array([], pa.binary())
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, fresh: list[bytes]) -> None:
        """Adds the ids of new words to the memory."""
        if not fresh:
            return
        letters = b"\0".join(fresh).decode("latin-1").translate(self.letters).split(self.letters[0])  # no plain text holds a zero byte
        lists = [[t.id for t in self.model.tokenize(w)] for w in letters]
        self.words = pa.concat_arrays([self.words, pa.array(fresh, pa.binary())])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in lists])])

    def _forget(self, most: int) -> None:
        """Keeps the ``most`` words that most blocks have asked for."""
        kept = np.sort(np.argpartition(-self.uses, most)[:most])
        self.ids, self.at = _spread(kept, self.ids, self.at)
        self.words, self.uses = self.words.take(pa.array(kept)), self.uses[kept] // 2

    def _block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the plain texts data[at[i] : at[i + 1]], at[0] = 0, and the borders of their lists."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        starts = word_starts(data, np.unique(at[:-1][at[:-1] < len(data)]))
        borders = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(data)])
        which = pc.index_in(words, value_set=self.words)
        if which.null_count:
            new = np.flatnonzero(which.is_null())
            which = which.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            missing = words.take(pa.array(new))
            fresh = missing.unique()
            base = len(self.words)
            self._learn(fresh.to_pylist())
            which[new] = base + pc.index_in(missing, value_set=self.words.slice(base)).to_numpy(zero_copy_only=False)
        else:
            which = which.to_numpy(zero_copy_only=False)
        asked = np.zeros(len(self.words), bool)
        asked[which] = True
        self.uses = np.concatenate([self.uses, np.zeros(len(asked) - len(self.uses), np.int64)]) + asked
        ids, ends = _spread(which, self.ids, self.at)
        if len(self.words) > token_count.REMEMBERED:
            self._forget(token_count.REMEMBERED // 2)
        return ids, ends[np.searchsorted(starts, at)]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, in blocks; a text longer than a block is cut where white space follows something else."""
        data, at = _raw(texts)
        ids, sizes, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
            cuts = [int(at[i])]
            while j == i + 1 and cuts[-1] + BLOCK_BYTES < at[j]:
                cut = _BREAK.search(data, cuts[-1] + BLOCK_BYTES, int(at[j]))
                if cut is None:
                    break
                cuts.append(cut.start())
            total = 0
            for a, b in zip(cuts, [*cuts[1:], int(at[j])]):
                found, ends = self._block(data[a:b], at[i : j + 1] - a if len(cuts) == 1 else np.array([0, b - a]))
                ids.append(found)
                total += len(found)
            sizes.append(np.diff(ends) if len(cuts) == 1 else np.array([total]))
            i = j
        return np.concatenate(ids), np.concatenate(sizes)

    def _others(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are not plain."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        cut, whole, new = {}, [], set()
        for k, t in enumerate(texts):
            if ODD_SPACE.search(t) or any(s in t for s in self.specials):
                whole.append(k)
            else:
                cut[k] = PIECE.findall(t)
                new.update(cut[k])
        known = self.known
        fresh = [p for p in new if p not in known]
        if len(known) + len(fresh) > PIECES:
            known.clear()
            fresh = list(new)
        simple = [p for p in fresh if self.plain and PLAIN.fullmatch(p)]
        if simple:
            ids, sizes = self._plain(pa.array(simple, pa.string()))
            known.update(zip(simple, np.split(ids, np.cumsum(sizes)[:-1])))
        other = [p for p in fresh if p not in known]
        known.update(zip(other, self._whole(other)))
        for k, pieces in cut.items():
            out[k] = np.concatenate([known[p] for p in pieces]) if pieces else out[k]
        for k, ids in zip(whole, self._whole([texts[k] for k in whole])):
            out[k] = ids
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another as unsigned 32-bit integers, and how many each has."""
        texts = texts.fill_null("")
        plain = plain_rows(*_raw(texts)) if self.plain else np.zeros(len(texts), bool)
        for s in self.specials:
            plain &= ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._plain(texts)
        ids, sizes = self._plain(texts.filter(pa.array(plain)))
        lists = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        others = iter(self._others(texts.filter(pa.array(~plain)).to_pylist()))
        rows = [next(lists if p else others) for p in plain]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        raw = ids.astype("<u4")
        return [raw[e - n : e].tobytes() for e, n in zip(ends, sizes)]


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and its borders, the first of which is 0."""
    _, borders, data = texts.buffers()
    at = np.frombuffer(borders, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if borders and len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


_encoders: dict[int, PieceEncoder] = {}


def _encoder(spec: str) -> PieceEncoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(spec)
    return _encoders[key]


def _slices(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_column: str = "doc_id", text: str = "text") -> None:
    """Writes id, offset (ids of earlier rows in the same file), n_tokens and ids per row, in ascending id order over and inside the files.

    A null text counts as empty and has the end id alone; a null id sorts first; rows with one id stay together in one file.  Other columns are not
    written; the id's column must not be named like one of the other three.  An empty table gives a folder that reads back empty.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, offset = _encoder(spec), 0
        for part in _slices(batches):
            ids, sizes = encoder.encode_column(part.column(1))
            ends = np.concatenate(([0], np.cumsum(sizes + len(tail))))
            if len(tail):
                ids = np.insert(ids, np.cumsum(sizes), tail[0])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends[:-1] + offset, pa.int64()), pa.array(np.diff(ends), pa.int32()), lists], [id_column, "offset", "n_tokens", "ids"])
            offset += int(ends[-1])

    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")).repartitionByRange(max(1, math.ceil(size / FILE_BYTES)), F.col(id_column)).sortWithinPartitions(id_column)
    rows = rows.mapInArrow(run, f"`{id_column}` {key}, offset long, n_tokens int, ids array<int>")
    options = {"orc.bloom.filter.columns": id_column, "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}
    rows.write.options(**options).orc(path)


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """file, base: the ids of all files before it, by the number in a file's name.  One row per file, from the columns offset and n_tokens alone."""
    sizes = spark.read.orc(path).select(F.col("_metadata.file_name").alias("file"), (F.col("offset") + F.col("n_tokens")).alias("end")).groupBy("file").agg(F.max("end").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    return sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """id, start (ids of all rows before it), ids."""
    rows = spark.read.orc(path).select("*", F.col("_metadata.file_name").alias("file"))
    return rows.join(file_bases(spark, path), "file").select(id_column, (F.col("offset") + F.col("base")).alias("start"), "ids")


def digests(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 from the files.  Ids are digested where they are read; only the digests meet the files' bases."""
    rows = spark.read.orc(path).select(id_column, "offset", F.col("_metadata.file_name").alias("file"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = np.asarray(lists.offsets).astype(np.int64) * 4
            raw = np.asarray(lists.values).astype("<i4").tobytes()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at) // 4, pa.int64()), pa.array(crc, pa.int64())], [id_column, "offset", "file", "n_tokens", "ids_crc32"])

    key = rows.schema[id_column].dataType.simpleString()
    out = rows.mapInArrow(run, f"`{id_column}` {key}, offset long, file string, n_tokens long, ids_crc32 long")
    return out.join(file_bases(spark, path), "file").select(id_column, (F.col("offset") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_lengths(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The columns of ``docs`` but the text, and how many ids the library gives each whole text (null: none)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    kept = [c for c in docs.columns if c not in (text, out)]
    kinds = ", ".join([*(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "_n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(spec)
        for part in _slices(batches):
            _, n = encoder.encode_column(part.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], [*(f"_c{i}" for i in range(len(kept))), "_n"])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("_t")).mapInArrow(run, kinds)
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], F.col("_n").alias(out))
