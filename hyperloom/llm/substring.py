"""Removal of passages that an earlier document holds, over the de Bruijn graph of word k-mers.

Windows of k words are edges between their first and last k-1 words.  The steps:

* Chunks of documents ask hash ranges which edges occur in other chunks too (one exchange of a few bytes per edge), then ask for the source of the
  repeated ones alone: the smallest doc_id that holds the edge, and where.
* Each document walks along its edges.  A stretch of edges whose source coordinates advance with the document's is one row, a span; spans by which
  a source document goes over its own edges carry its words.
* The ends of all spans cut the sources into intervals inside which no walk begins, ends or branches.  Two intervals that meet in a node with one edge in
  and one edge out are joined, and pointer jumping over these joins numbers the intervals of each nonbranching path.
* Spans that lead to an earlier document take their place on a path and their source's words from joins.  Each chunk compares these words with its own
  documents, window by window, and removes what agrees.

Rows of the joins are spans and intervals, not edges; frequent keys are spread by ``join_hot`` and by lots.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._exchange import chunk_of, cuts, groups_of, hash_bits, pack, pack_sorted, plan_sizes, stable_order, unpack, unpack_sorted, volume
from ._rank import join_hot
from ._scratch import forget, written
from ._text import Words, gram_hash, windows

WINDOW = 13
_SIGN = np.uint64(1 << 63)
#: Positions of the n-th row of a doc_id begin at n times this.
ROW = 1 << 32
#: Chunks that get a source's words from one task.
LOT = 1000
SPANS = "array<struct<first:bigint,last:bigint,source:bigint,source_first:bigint,path_source:bigint,path_first:bigint,path_offset:bigint>>"
STEPS = "chunk int, doc long, row int, first long, n long, src long, at long, head long, tail long, own boolean, words binary"
PAYLOAD = "chunk int, doc long, row int, first long, n long, src long, at long, run long, path_src long, path_at long, path_offset long, words binary"


class _Edges:
    """The edges of a chunk, by hash and then in the order of its rows; rows without an id hold none."""

    def __init__(self, table: pa.Table, k: int, shift: np.uint64):
        self.words = w = Words(table["text"])
        ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
        known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(0)).view(np.uint64) ^ _SIGN  # ordered as unsigned numbers
        g, at = windows(w, k)
        if not known.all():
            some = known[w.doc[at]]
            g, at = g[some], at[some]
        order = stable_order(g)
        self.hash, self.at = g[order], at[order]
        self.doc = w.doc[self.at]
        self.row = _rows_of_id(self.ids, known, w)
        self.pos = self.at - w.first[self.doc] + self.row[self.doc] * ROW
        self.first, self.group = groups_of(self.hash >> shift)  # as the first exchange names them
        self.short = (self.hash >> shift)[self.first]

    def repeated(self, flags: np.ndarray) -> np.ndarray:
        """Distinct short hashes that occur in other chunks, or here under two ids."""
        if not len(self.first):
            return flags
        i = self.ids[self.doc]
        return flags | (np.minimum.reduceat(i, self.first) != np.maximum.reduceat(i, self.first))

    def sources(self, asked: np.ndarray):
        """Of the asked edges: which, their distinct hashes, each one's first index, run, smallest id and its smallest position there."""
        which = np.flatnonzero(asked[self.group]) if len(self.group) else np.zeros(0, np.int64)
        h, i, p = self.hash[which], self.ids[self.doc[which]], self.pos[which]
        first, run = groups_of(h)
        if not len(first):
            z = np.zeros(0, np.uint64)
            return which, z, first, run, z, z
        low = np.minimum.reduceat(i, first)
        at = np.minimum.reduceat(np.where(i == low[run], p, np.iinfo(np.int64).max), first)
        return which, h[first], first, run, low, at.astype(np.uint64)


def _rows_of_id(ids: np.ndarray, known: np.ndarray, words: Words) -> np.ndarray:
    """A number for each row among those of its id, all of which are in the chunk: 0 for most; otherwise by the text, equal rows in any order."""
    out = np.zeros(len(ids), np.int64)
    unique, at, count = np.unique(ids[known], return_inverse=True, return_counts=True)
    of = np.flatnonzero(known)
    for k in np.flatnonzero(count > 1):
        for n, i in enumerate(sorted(of[at == k].tolist(), key=words.text)):
            out[i] = n
    return out


def _source_coordinates(e: _Edges, answers: pa.Table) -> tuple[np.ndarray, ...]:
    """The repeated edges of a chunk in the order of its words: word where it begins, text, source, position there."""
    which, _, _, run, low, at = e.sources(_joined(answers, "asked", _flags, np.zeros(0, bool)))
    other = _joined(answers, "other", _flags, np.zeros(0, bool))
    none = np.zeros(0, np.uint64)
    low[other], at[other] = _joined(answers, "ids", unpack, none), _joined(answers, "at", unpack, none)
    word, src, src_at = e.at[which], low[run], at[run].astype(np.int64)
    order = np.argsort(word)
    word, src, src_at = word[order], src[order], src_at[order]
    return word, e.words.doc[word], src, src_at


def _signed(ids: np.ndarray) -> np.ndarray:
    return (ids ^ _SIGN).view(np.int64)


def _walk(chunk: int, e: _Edges, answers: pa.Table, k: int) -> pa.Table:
    """The spans of a chunk's documents; a span by which a document goes over its own edges has its words."""
    w = e.words
    word, doc, src, at = _source_coordinates(e, answers)
    new = np.ones(len(word), bool)
    if len(word):
        new[1:] = (word[1:] != word[:-1] + 1) | (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(word)))
    word, doc, src, at = word[begin], doc[begin], src[begin], at[begin]
    nodes = gram_hash(w.hash, k - 1)
    own = (src == e.ids[doc]) & (at == word - w.first[doc] + e.row[doc] * ROW)
    texts = [b" ".join(w.data[w.start[i] : w.end[i + m + k - 2]].tobytes().split()) if mine else None for i, m, mine in zip(word.tolist(), n.tolist(), own.tolist())]
    return pa.table(
        {"chunk": pa.array([chunk] * len(n), pa.int32()), "doc": pa.array(_signed(e.ids[doc]), pa.int64()), "row": pa.array(e.row[doc], pa.int32()), "first": pa.array(word - w.first[doc], pa.int64()), "n": pa.array(n, pa.int64()), "src": pa.array(_signed(src), pa.int64()), "at": pa.array(at, pa.int64()), "head": pa.array(nodes[word].view(np.int64), pa.int64()), "tail": pa.array(nodes[word + n].view(np.int64), pa.int64()), "own": pa.array(own), "words": pa.array(texts, pa.binary())}
    )


def intervals(steps: DataFrame) -> DataFrame:
    """src, at, n, head, tail, run, starts: the sources' windows at to at+n-1, between whose ends no span begins or ends; the nodes at their ends, where
    the run of repeated edges begins that holds them, and how many spans begin there.  A source has no more rows than windows."""
    begin = steps.select("src", "at", F.col("head").alias("node"), F.col("own").cast("int").alias("step"), F.when(F.col("own"), F.col("at")).alias("run"), F.lit(1).alias("starts"))
    end = steps.select("src", (F.col("at") + F.col("n")).alias("at"), F.col("tail").alias("node"), (-F.col("own").cast("int")).alias("step"), F.lit(None).cast("long").alias("run"), F.lit(0).alias("starts"))
    marks = begin.unionByName(end).groupBy("src", "at").agg(F.max("node").alias("head"), F.sum("step").alias("step"), F.max("run").alias("run"), F.sum("starts").alias("starts"))
    line = Window.partitionBy("src").orderBy("at")
    marks = marks.select("src", "at", "head", "starts", F.sum("step").over(line).alias("inside"), F.last("run", ignorenulls=True).over(line).alias("run"), F.lead("at").over(line).alias("to"), F.lead("head").over(line).alias("tail"))
    return marks.filter("inside > 0 and to is not null").select("src", "at", (F.col("to") - F.col("at")).alias("n"), "head", "tail", "run", "starts")


def compact(parts: DataFrame) -> DataFrame:
    """``parts`` with path_src, path_at (the first interval of the path that an interval is on) and path_offset (windows of the path before it).

    Intervals are joined where a node has one of them in and one out.  Those on a ring, which has no first one, are paths of their own.
    """
    into = parts.groupBy(F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("src", "at", "n")).alias("x")).filter("many = 1")
    out = parts.groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("src", "at")).alias("y")).filter("many = 1")
    links = into.drop("many").join(out.drop("many"), "node")
    links = links.select(F.col("y.src").alias("src"), F.col("y.at").alias("at"), F.col("x.src").alias("path_src"), F.col("x.at").alias("path_at"), F.col("x.n").alias("path_offset"))
    links = written(links, "substring-links")
    before = None
    while True:
        ahead = links.toDF("path_src", "path_at", "next_src", "next_at", "more")
        longer = links.join(ahead, ["path_src", "path_at"], "left")
        moved = written(longer.select("src", "at", F.coalesce("next_src", "path_src").alias("path_src"), F.coalesce("next_at", "path_at").alias("path_at"), (F.col("path_offset") + F.coalesce("more", F.lit(0))).alias("path_offset"), F.col("next_at").isNotNull().alias("open")), "substring-links")
        open_ = moved.filter("open").count()
        forget(links)
        links = moved.filter("not open").drop("open") if open_ == before else moved.drop("open")
        if open_ in (0, before):
            break
        before = open_
    found = parts.join(links, ["src", "at"], "left")
    return found.select(*parts.columns, F.coalesce("path_src", "src").alias("path_src"), F.coalesce("path_at", "at").alias("path_at"), F.coalesce("path_offset", F.lit(0)).alias("path_offset"))


def removals(steps: DataFrame) -> DataFrame:
    """What each chunk needs: its spans that lead to an earlier document, with their place on a compacted path, and once the words of each run they lead to."""
    parts = written(intervals(steps), "substring-intervals")
    paths = written(compact(parts), "substring-paths")
    spans = steps.filter("src < doc").select("chunk", "doc", "row", "first", "n", "src", "at")
    spans = join_hot(spans, paths.select("src", "at", "run", "path_src", "path_at", "path_offset", "starts"), ["src", "at"], "starts", steps.count())
    spans = written(spans.drop("starts"), "substring-spans")
    asked = written(spans.select("chunk", "src", "run").distinct(), "substring-asked")
    times = asked.groupBy("src", "run").agg(F.count(F.lit(1)).alias("times"))
    lots = F.ceil(F.col("times") / LOT)
    asked = join_hot(asked, times, ["src", "run"], "times", asked.count()).select("chunk", "src", "run", F.pmod(F.xxhash64("chunk"), lots).cast("int").alias("lot"))
    words = steps.filter("own").select("src", F.col("at").alias("run"), "words").join(times, ["src", "run"])
    words = words.select("src", "run", "words", F.explode(F.sequence(F.lit(0), (lots - 1).cast("int"))).alias("lot"))
    words = asked.join(words, ["src", "run", "lot"])
    none = lambda kind: F.lit(None).cast(kind)
    order = [f.split(" ") for f in PAYLOAD.split(", ")]
    return spans.withColumn("words", none("binary")).select(*[n for n, _ in order]).unionByName(words.select(*[F.col(n) if n in ("chunk", "src", "run", "words") else none(kind).alias(n) for n, kind in order]))


def _verified(w: Words, payload: pa.Table, rows: dict[tuple[int, int], int], k: int) -> tuple[np.ndarray, dict[int, list]]:
    """Which words of a chunk are covered by windows whose words are the source's, and the spans of each text."""
    is_run = np.asarray(pa.compute.is_valid(payload["words"]))
    runs = payload.filter(pa.array(is_run))
    source = {(s, r): x.as_py().split(b" ") for s, r, x in zip(runs["src"].to_pylist(), runs["run"].to_pylist(), runs["words"])}
    cover = np.zeros(len(w.start) + 1, np.int64)
    spans: dict[int, list] = {}
    texts: dict[int, list[bytes]] = {}
    for s in payload.filter(pa.array(~is_run)).to_pylist():
        i = rows[s["doc"], s["row"]]
        if i not in texts:
            texts = {i: w.text(i).split()}
        a, n, b = s["first"], s["n"], s["at"] - s["run"]
        mine, theirs = texts[i][a : a + n + k - 1], source[s["src"], s["run"]][b : b + n + k - 1]
        at = int(w.first[i]) + a
        if mine == theirs:
            parts = [(0, n)]
        else:  # two sequences of words with one hash: windows that agree word by word
            same = np.array([x == y for x, y in zip(mine, theirs)] + [False] * (len(mine) - len(theirs)))
            good = np.convolve(same, np.ones(k), "valid") == k
            edge = np.flatnonzero(np.diff(np.concatenate(([0], good, [0]))))
            parts = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        for x, y in parts:
            cover[at + x] += 1
            cover[at + y + k - 1] -= 1
            spans.setdefault(i, []).append((a + x, a + y - 1, s["src"], s["at"] % ROW + x, s["path_src"], s["path_at"] % ROW, s["path_offset"] + x))
    return np.cumsum(cover[:-1]) > 0, spans


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def _flags(b: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int.from_bytes(b[:4], "little")).astype(bool)


def _joined(table: pa.Table, column: str, read, empty) -> np.ndarray:
    table = table.sort_by("r")
    return np.concatenate([read(x.as_py()) for x in table[column]] or [empty])


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_column: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed, kept_sha256 and spans; with ``texts`` the text is replaced by the kept words joined by one space.

    A word goes if a window of k words covers it that also starts in a row with a smaller id, judged on the input.  ``spans`` say what was found:
    windows first to last (word numbers of their starts, from 0) of the row are those of the source from source_first on, and begin path_offset windows
    into the compacted path that begins at path_first of path_source.
    A null text stays null and has no words.  Rows with one id do not remove each other; rows without an id neither remove nor lose
    anything.  Texts shorter than k words stay whole, texts of any length are walked whole.  Columns named like an output are replaced.  An
    empty table gives an empty result.  k is 2 at least.
    """
    own = ["n_words", "n_removed", "kept_sha256", "spans"]
    passed = [c for c in docs.columns if c not in (*own, id_column, text)]
    names = {c: f"_e{i}" for i, c in enumerate(passed)}
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(names[c]) for c in passed])
    n_bytes, _ = volume(rows)
    n_chunks, n_ranges = plan_sizes(n_bytes)
    shift = np.uint64(64 - hash_bits(n_bytes, 12))
    rows = rows.select(chunk_of(n_chunks).alias("chunk"), "doc_id", "text", *names.values())

    def ask(key, table):
        e = _Edges(table, k, shift)
        at = cuts(e.short << shift, n_ranges)
        some = np.flatnonzero(np.diff(at))
        return pa.table({"r": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()), "edges": pa.array([pack_sorted(e.short[at[r] : at[r + 1]]) for r in some], pa.binary())})

    def repeated(key, table):
        asked = [unpack_sorted(x.as_py()) for x in table["edges"]]
        every = np.sort(np.concatenate(asked))
        twice = every[1:][every[1:] == every[:-1]]
        first, _ = groups_of(twice)
        twice = np.append(twice[first], np.uint64((1 << 64) - 1))
        return pa.table({"chunk": table["chunk"], "r": table["r"], "flags": pa.array([_bits(twice[np.searchsorted(twice[:-1], x)] == x) for x in asked], pa.binary())})

    def ask_source(key, left, right):
        e = _Edges(left, k, shift)
        asked = e.repeated(_joined(right, "flags", _flags, np.zeros(0, bool)))
        _, h, _, _, low, at = e.sources(asked)
        short_cut, cut = cuts(e.short << shift, n_ranges), cuts(h, n_ranges)
        some = np.flatnonzero(np.diff(short_cut))
        part = lambda x, c, f: pa.array([f(x[c[r] : c[r + 1]]) for r in some], pa.binary())
        return pa.table({"r": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()), "edges": part(h, cut, pack_sorted), "ids": part(low, cut, pack), "at": part(at, cut, pack), "asked": part(asked, short_cut, _bits)})

    def source(key, table):
        read = lambda c, f: [f(x.as_py()) for x in table[c]]
        asked, ids, at = read("edges", unpack_sorted), np.concatenate(read("ids", unpack)), np.concatenate(read("at", unpack))
        every = np.concatenate(asked)
        order = stable_order(every)
        first, run = groups_of(every[order])
        low, where = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
        if len(every):
            i, p = ids[order], at[order]
            least = np.minimum.reduceat(i, first)[run]
            low[order] = least
            where[order] = np.minimum.reduceat(np.where(i == least, p, np.uint64((1 << 64) - 1)), first)[run]
        other = (low < ids) | ((low == ids) & (where < at))
        ends = np.cumsum([0] + [len(x) for x in asked])
        part = lambda f: pa.array([f(a, b) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        return pa.table({"chunk": table["chunk"], "r": table["r"], "asked": table["asked"], "other": part(lambda a, b: _bits(other[a:b])), "ids": part(lambda a, b: pack(low[a:b][other[a:b]])), "at": part(lambda a, b: pack(where[a:b][other[a:b]]))})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", *(("text",) if texts else ()), *names.values())]) + f", n_words long, n_removed long, kept_sha256 string, spans {SPANS}"

    def walk(key, left, right):
        return _walk(key[0].as_py(), _Edges(left, k, shift), right, k)

    def remove(key, left, right):
        w = Words(left["text"], hashed=False)
        ids = left["doc_id"]
        known = ~np.asarray(ids.is_null())
        numbers = np.asarray(ids.combine_chunks().fill_null(0) if isinstance(ids, pa.ChunkedArray) else ids.fill_null(0)).astype(np.int64)
        nth = _rows_of_id(numbers, known, w)
        covered, found = _verified(w, right, {(int(d), int(n)): i for i, (d, n) in enumerate(zip(numbers, nth)) if known[i]}, k)
        before = np.concatenate(([0], np.cumsum(covered)))
        removed = before[w.first + w.count] - before[w.first]
        digest, kept_text, null = [], [], np.asarray(left["text"].is_null())
        for i in range(w.n_docs):
            kept = w.text(i).split()
            if removed[i]:
                kept = compress(kept, ~covered[w.first[i] : w.first[i] + w.count[i]])
            kept = b" ".join(kept)
            digest.append(hashlib.sha256(kept).hexdigest())
            if texts:
                kept_text.append(None if null[i] else kept.decode())
        names_of = ["first", "last", "source", "source_first", "path_source", "path_first", "path_offset"]
        lists = [found.get(i, ()) for i in range(w.n_docs)]
        flat = np.array([x for part in lists for x in sorted(part)], np.int64).reshape(-1, len(names_of))
        spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat.T], names_of)
        offsets = np.cumsum([0] + [len(x) for x in lists])
        out = {"doc_id": left["doc_id"]} | ({"text": pa.array(kept_text, pa.string())} if texts else {}) | {x: left[x] for x in names.values()}
        return pa.table(out | {"n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)})

    narrow = rows.select("chunk", "doc_id", "text")
    flags = narrow.groupBy("chunk").applyInArrow(ask, "r int, chunk int, edges binary").groupBy("r").applyInArrow(repeated, "chunk int, r int, flags binary")
    asks = narrow.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(ask_source, "r int, chunk int, edges binary, ids binary, at binary, asked binary")
    answers = asks.groupBy("r").applyInArrow(source, "chunk int, r int, asked binary, other binary, ids binary, at binary")
    answers = written(answers, "substring-sources")
    steps = written(narrow.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(walk, STEPS), "substring-walks")
    forget(answers)
    payload = written(removals(steps), "substring-payload")
    forget(steps)
    out = rows.groupBy("chunk").cogroup(payload.groupBy("chunk")).applyInArrow(remove, schema)
    order = [*((id_column, text) if texts else (id_column,)), *passed]
    back = {id_column: "doc_id", text: "text"} | names
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns if c in order], *own)


def deduplicated(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """``docs`` with the texts that are left, and ``n_chars`` after them; every row stays, if with an empty text."""
    out = remove_repeats(docs, k).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
