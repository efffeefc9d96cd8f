"""Jaccard join of documents on word n-grams with rare-first prefixes, length, positional and suffix filters.

Shingles are counted over the whole corpus by ``_exchange``; a document orders its shingles from rare to frequent.  Two similar
documents share a shingle in their prefixes, so those that appear in one document alone rule most documents out before any join.
Classes of equal sets are joined once, by a representative.  Components come first: a first round tests each document against one or two
leaders per prefix shingle; a second round tests every pair of documents that share a prefix shingle and are not connected yet.  Two linked
documents are in one component, so all links follow by testing all pairs inside each component, in blocks of members that
meet block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import chunked, cuts, groups_of, hash_bits, pack, pack_sorted, plan_sizes, stable_order, unpack, unpack_sorted, volume
from ._rank import join_hot
from ._scratch import bucketed, forget, written
from ._text import Words, gram_hash, mix, windows
from .components import components

SHINGLE, PERCENT = 5, 75
#: Members of a prefix shingle's group up to which its central member alone leads; larger groups draw a second leader per shingle.
SMALL_GROUP = 16
#: Members and bytes of sets in a block, in which the pairs of a component are tested, and columns of the blocks' products taken at once.
#: A member is sent once for each block of its component; blocks of very long sets have fewer members.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 2 << 20, 4096
#: Pairs that a set is sent for at once, bytes of sets in a group of them, and members of a prefix shingle that meet in one group.
LOT, GROUP_BYTES, MEETING = 256, 4 << 20, 512


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's distinct shingles, by hash and then text.  A text with fewer than k words has one, its whole sequence."""
    g, at = windows(words, k)
    parts, docs = [g], [words.doc[at]]
    for n in range(1, k):  # shorter texts by their length; the length is part of the hash
        few = np.flatnonzero(words.count == n)
        if len(few):
            h = gram_hash(words.hash, n, salt=n + 1)
            parts.append(h[words.first[few]])
            docs.append(few)
    g, d = np.concatenate(parts), np.concatenate(docs)
    by_doc = np.argsort(d, kind="stable")
    g, d = g[by_doc], d[by_doc]
    order = stable_order(g)
    g, d = g[order], d[order]
    if len(g):
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        g, d = g[new], d[new]
    return g, d


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def document_frequencies(rows: DataFrame, k: int, n_bytes: int, lower: bool = True) -> tuple[DataFrame, int]:
    """Answers (chunk, r, counts): for each chunk's distinct shingles, cut to so many bits and in order, the number of documents that hold them."""
    _, n_ranges = plan_sizes(n_bytes)
    bits = hash_bits(n_bytes, 16)
    shift = np.uint64(64 - bits)

    def ask(key, table):
        g, _ = shingles(Words(table["text"], lower=lower), k)
        g = g >> shift
        first, _ = groups_of(g)
        n = np.diff(np.append(first, len(g)))
        g = g[first]
        at = cuts(g << shift, n_ranges)
        some = np.flatnonzero(np.diff(at))
        return pa.table(
            {"r": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()), "grams": pa.array([pack_sorted(g[at[r] : at[r + 1]]) for r in some], pa.binary()), "n": pa.array([pack(n[at[r] : at[r + 1]]) for r in some], pa.binary())}
        )

    def answer(key, table):
        g = [unpack_sorted(x.as_py()) for x in table["grams"]]
        n = np.concatenate([unpack(x.as_py()) for x in table["n"]])
        every = np.concatenate(g)
        order = stable_order(every)
        first, group = groups_of(every[order])
        total = np.empty(len(every), np.uint64)
        total[order] = np.add.reduceat(n[order], first)[group]
        ends = np.cumsum([0] + [len(x) for x in g])
        return pa.table({"chunk": table["chunk"], "r": table["r"], "counts": pa.array([pack(total[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    asked = rows.groupBy("chunk").applyInArrow(ask, "r int, chunk int, grams binary, n binary")
    return asked.groupBy("r").applyInArrow(answer, "chunk int, r int, counts binary"), bits


def ordered_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """row, doc_id, n, d1, d2 (digest of the set), rare (shingles of one document alone) and, where enough shingles are shared for a link
    to be possible, grams: the set from rare to frequent."""
    n_bytes, _ = volume(docs)
    n_chunks, _ = plan_sizes(n_bytes)
    rows = chunked(docs, n_chunks)
    answers, bits = document_frequencies(rows, k, n_bytes)
    shift = np.uint64(64 - bits)

    def emit(key, left, right):
        g, d = shingles(Words(left["text"], lower=True), k)
        n_docs = left.num_rows
        _, group = groups_of(g >> shift)
        right = right.sort_by("r")
        df = np.concatenate([unpack(x.as_py()) for x in right["counts"]] or [np.zeros(0, np.uint64)])[group]
        n = np.bincount(d, minlength=n_docs)
        shared = np.bincount(d[df >= 2], minlength=n_docs)
        d1, d2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
        np.add.at(d1, d, mix(g + np.uint64(1)))
        np.add.at(d2, d, mix(g ^ np.uint64(0xA5A5A5A5DEADBEEF)))
        ids = left["doc_id"]
        known = ~np.asarray(ids.is_null())
        able = (n > 0) & known & (shared >= -(-percent * n // 100))
        keep = np.flatnonzero(able[d])
        order = keep[np.lexsort((g[keep], df[keep], d[keep]))]
        at = np.searchsorted(d[order], np.arange(n_docs + 1))
        raw = g[order].astype("<u8").tobytes()
        sets = [raw[8 * a : 8 * b] if able[i] else None for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]
        row = (np.int64(key[0].as_py()) << np.int64(32)) + np.arange(n_docs)
        return pa.table(
            {"row": pa.array(row, pa.int64()), "doc_id": ids.cast(pa.int64()), "n": pa.array(n, pa.int64()), "d1": pa.array(d1.view(np.int64), pa.int64()), "d2": pa.array(d2.view(np.int64), pa.int64()), "rare": pa.array(n - shared, pa.int64()), "grams": pa.array(sets, pa.binary())}
        )

    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(emit, "row long, doc_id long, n long, d1 long, d2 long, rare long, grams binary")
    return written(out, "sets")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """gram, row, doc_id, n, rare, pos for the shared shingles in each set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, doc, n, rare = (np.asarray(b.column(i)) for i in range(4))
            grams, owner, pos = [], [], []
            for i, x in enumerate(b.column(4)):
                last = int(n[i]) - least_overlap(int(n[i]), percent) + 1
                if rare[i] < last:
                    grams.append(np.frombuffer(x.as_py(), "<i8")[int(rare[i]) : last])
                    pos.append(np.arange(int(rare[i]), last))
                    owner.append(np.full(last - int(rare[i]), i))
            if grams:
                o = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(row[o]), pa.array(doc[o]), pa.array(n[o]), pa.array(rare[o]), pa.array(np.concatenate(pos))], ["gram", "row", "doc_id", "n", "rare", "pos"])

    return sets.select("row", "doc_id", "n", "rare", "grams").mapInArrow(run, "gram long, row long, doc_id long, n long, rare long, pos long")


def suffix_bounds(x: np.ndarray, y: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Upper bounds of how many hashes x shares with each of n sets, whose hashes are y: hashes are cut into 64 ranges, and a range shares at
    most its smaller side."""
    cells = np.bincount(owner * 64 + (y >> np.uint64(58)).astype(np.int64), minlength=64 * n).reshape(n, 64)
    return np.minimum(cells, np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=64)).sum(1)


def similar(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar to x, by the suffix filter and then exactly."""
    n = np.array([len(y) for y in others], np.int64)
    y, owner = np.concatenate(others), np.repeat(np.arange(len(others)), n)
    need = -(-percent * (len(x) + n) // (100 + percent))
    may = suffix_bounds(x, y, owner, len(others)) >= need
    y, owner = y[may[owner]], owner[may[owner]]
    x = np.sort(x)
    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    return may & (np.bincount(owner[hit], minlength=len(others)) >= need)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (doc_ids) of the pairs (row_a, row_b) whose sets are similar.

    A set of row_a goes once to each lot of up to ``LOT`` of its pairs; lots share groups of about ``GROUP_BYTES``.
    """
    n = pairs.count()
    mean = sets.agg(F.coalesce(F.avg(F.octet_length("grams")), F.lit(0.0)).alias("b")).first()["b"]
    groups = max(1, int(n * mean // GROUP_BYTES))
    lots = F.ceil(F.col("m") / LOT)
    many = pairs.groupBy("row_a").agg(F.count(F.lit(1)).alias("m"))
    p = written(join_hot(pairs, many, ["row_a"], "m", n).select("row_a", "row_b", F.pmod(F.xxhash64("row_b"), lots).cast("int").alias("lot")), "lots")
    group = F.pmod(F.xxhash64("row_a", "lot"), F.lit(groups)).cast("int").alias("g")
    s = sets.select("row", "doc_id", "grams")
    leads = p.select("row_a", "lot").distinct().join(s.toDF("row_a", "doc", "grams"), "row_a").select(group, "row_a", "lot", "doc", "grams").toDF("g", "row_a", "lot", "doc", "grams")
    follow = p.join(s.toDF("row_b", "doc", "grams"), "row_b").select(group, F.col("row_a").alias("lead"), F.col("lot").alias("of"), "doc", "grams").toDF("g", "row_a", "lot", "doc", "grams")

    def run(key, left, right):
        read = lambda t: list(zip(t["row_a"].to_pylist(), t["lot"].to_pylist()))
        lead = {k: (d, x) for k, d, x in zip(read(left), left["doc"].to_pylist(), left["grams"])}
        lots: dict[tuple, list] = {}
        for k, d, y in zip(read(right), right["doc"].to_pylist(), right["grams"]):
            lots.setdefault(k, []).append((d, y))
        a_out, b_out = [], []
        for k, many in lots.items():
            a, x = lead[k]
            ok = similar(np.frombuffer(x.as_py(), "<u8"), [np.frombuffer(y.as_py(), "<u8") for _, y in many], percent)
            b_out += [d for (d, _), yes in zip(many, ok) if yes]
            a_out += [a] * int(ok.sum())
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return leads.groupBy("g").cogroup(follow.groupBy("g")).applyInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of ``sets`` shares with each of ``others``; the hashes of a set are distinct."""
    out = np.zeros((len(sets), len(others)), np.int64)
    g, code = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(x) for x in (*sets, *others)])
    left = owner < len(sets)
    both = np.zeros(len(g), bool)
    both[code[left]] = True
    right = np.zeros(len(g), bool)
    right[code[~left]] = True
    both &= right
    here = both[code]
    column, owner, left = (np.cumsum(both) - 1)[code[here]], owner[here], left[here]
    by_column = np.argsort(column, kind="stable")
    column, owner, left = column[by_column], owner[by_column], left[by_column]
    for at in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        c, o, x = column[a:b] - at, owner[a:b], left[a:b]
        m, n = np.zeros((len(sets), COLUMNS), np.float32), np.zeros((len(others), COLUMNS), np.float32)
        m[o[x], c[x]] = 1
        n[o[~x] - len(sets), c[~x]] = 1
        out += (m @ n.T).astype(np.int64)
    return out


def links_inside(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """row, n_links, others: every link between the representatives ``sets`` (row, grams) of a component.

    ``members``: row, component, rows (in the class), n (shingles) for each representative in a component.  A link stands in ``others`` of one of its ends and in
    ``n_links``, in rows of the linked class, of both; a representative may have several rows of this table.  Components of more than
    ``BLOCK`` members are dealt over blocks, a group for each pair of blocks; smaller ones share groups.
    """
    room = F.least(F.lit(BLOCK), F.greatest(F.lit(16), F.floor(F.lit(BLOCK_BYTES) / (8 * F.avg("n")))))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), room.alias("room")).filter("m > 1")
    m = members.join(size, "component").withColumn("blocks", F.ceil(F.col("m") / F.col("room")).cast("int"))
    large = F.col("blocks") > 1
    total = size.agg(F.coalesce(F.sum(F.when(F.col("m") <= F.col("room"), F.col("m"))), F.lit(0)).alias("n")).first()["n"]
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    m = m.withColumn("own", F.when(large, own).otherwise(-1)).withColumn("g", F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(total // BLOCK + 1))))
    m = m.withColumn("other", F.explode(F.when(large, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))))
    m = m.select("row", "component", "rows", "own", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key, table):
        row, comp, rows, own, j = (np.asarray(table[c]) for c in ("row", "component", "rows", "own", "j"))
        grams = [np.frombuffer(x.as_py(), "<u8") for x in table["grams"]]
        n = np.array([len(x) for x in grams], np.int64)
        count, others = np.zeros(len(row), np.int64), [[] for _ in row]
        by_comp = np.argsort(comp, kind="stable")
        for part in np.split(by_comp, np.flatnonzero(np.diff(comp[by_comp])) + 1):
            second = own[part] == j[part]
            a, b = (part[~second], part[second]) if not second.all() else (part, part)
            if not len(a) or not len(b):
                continue
            shared = overlaps([grams[i] for i in a], [grams[i] for i in b])
            linked = (100 + percent) * shared >= percent * (n[a][:, None] + n[b][None, :])
            if a is b:
                linked = np.triu(linked, 1)
            for x, y in zip(*np.nonzero(linked)):
                others[a[x]].append(int(row[b[y]]))
            count[a] += linked @ rows[b]
            count[b] += linked.T @ rows[a]
        return pa.table({"row": pa.array(row, pa.int64()), "n_links": pa.array(count, pa.int64()), "others": pa.array(others, pa.list_(pa.int64()))})

    rows = m.join(sets.select("row", "grams"), "row")
    return written(rows.groupBy("g", "i", "j").applyInArrow(run, "row long, n_links long, others array<long>"), "links-inside")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, links).  rows: doc_id, n_shingles, component_id, n_links (other rows with a doc_id and a similar set) per row of ``docs`` (doc_id, text).
    links: every pair (a, b) of different doc_ids, a the smaller, with similar sets.

    Words are taken after A-Z are made small.  A null or empty text has no shingle and links with nothing; rows with one doc_id are one node;
    a row without doc_id links with nothing and has a null component.  An empty table gives empty results.
    """
    every, able, classes, sets, parts = _connected(docs, k, percent)
    same = ["n", "d1", "d2"]
    reps = classes.select(*same, F.col("rep.row").alias("row"), F.col("rep.doc_id").alias("node"), F.col("members").alias("rows"))
    inside = links_inside(sets, reps.join(parts, "node").select("row", "component", "rows", "n"), percent)
    more = inside.groupBy("row").agg(F.sum("n_links").alias("more"))
    member = reps.join(more, "row", "left").join(parts, "node", "left").select(*same, F.coalesce("component", "node").alias("component"), (F.coalesce("more", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    rows = every.drop("grams", "rare").join(member, same, "left").select("doc_id", F.col("n").alias("n_shingles"), _component().alias("component_id"), n_links.alias("n_links"))
    ids = able.select(*same, "doc_id").distinct().join(reps.select(*same, "row"), same).select("row", "doc_id")
    one, two = ids.toDF("row_a", "x"), ids.toDF("row_b", "y")
    pairs = inside.select(F.col("row").alias("row_a"), F.explode("others").alias("row_b")).unionByName(reps.filter("rows > 1").select(F.col("row").alias("row_a"), F.col("row").alias("row_b")))
    links = pairs.join(one, "row_a").join(two, "row_b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return rows, links


def _groups(p: DataFrame, lead, draw) -> DataFrame:
    """Shingles that several prefixes hold, with their members, the central one and a drawn one."""
    return p.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), lead("rare").alias("centre"), lead(draw.alias("h")).alias("drawn")).filter("members > 1")


def _component():
    return F.when(F.col("doc_id").isNotNull(), F.coalesce(F.least("component", "doc_id"), "doc_id"))


def _connected(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, ...]:
    """All sets, those that can have links, classes of equal sets, the sets of their representatives, and node, component of the doc_ids
    of linked representatives."""
    every = ordered_sets(docs, k, percent)
    able = every.filter(F.col("grams").isNotNull())
    # one representative per class of equal sets, the one with the smallest doc_id
    classes = written(able.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    reps = classes.select(F.col("rep.row").alias("row"))
    sets = bucketed(able.join(reps, "row", "left_semi"), "sets-of-classes", "row")
    p = prefixes(sets, percent)
    draw = F.xxhash64("gram", "row")
    # the member with the fewest shingles of its own leads: in a group of near copies, what they were copied from
    lead = lambda *first: F.min(F.struct(*first, "doc_id", "row", "n"))
    centre, drawn = F.struct("centre.row", "centre.n"), F.struct("drawn.row", "drawn.n")
    leads = F.when(F.col("members") <= SMALL_GROUP, F.array(centre)).otherwise(F.array(centre, drawn))
    p = written(p, "prefix-shingles")
    groups = written(_groups(p, lead, draw).select("gram", "members", leads.alias("leads")), "leads")
    n_members = groups.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first()["n"]
    shared = written(join_hot(p, groups, ["gram"], "members", n_members), "prefixes")
    forget(p, groups)
    p = shared
    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    stars = p.select("row", "n", F.explode("leads").alias("lead")).filter((F.col("row") != F.col("lead.row")) & near(F.col("n"), F.col("lead.n")))
    stars = written(stars.select(F.least("row", "lead.row").alias("row_a"), F.greatest("row", "lead.row").alias("row_b")).distinct(), "pairs")
    links = written(verified(stars, sets, percent), "links")
    parts = components(links)
    # second round: pairs that share a prefix shingle but no component yet
    here = p.select("gram", "row", "doc_id", "n", "pos").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    here = written(here, "prefixes-in-components")
    mixed = here.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo < hi").select("gram", "members")
    # a shingle of many members: they are dealt over blocks, which meet two by two
    here = join_hot(here, mixed, ["gram"], "members", n_members).withColumn("blocks", F.ceil(F.col("members") / MEETING).cast("int"))
    here = here.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = written(here.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")), "unconnected")
    one = here.select("gram", "i", "j", *[F.col(c).alias(f"{c}_a") for c in ("row", "n", "pos", "c", "own")])
    two = here.select("gram", "i", "j", *[F.col(c).alias(f"{c}_b") for c in ("row", "n", "pos", "c", "own")])
    apart = (F.col("i") == F.col("j")) | (F.col("own_a") != F.col("own_b"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent))
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    more = one.join(two, ["gram", "i", "j"]).filter(apart & (F.col("row_a") < F.col("row_b")) & (F.col("c_a") != F.col("c_b")) & near(F.col("n_a"), F.col("n_b")) & (left >= need))
    more = more.select("row_a", "row_b").distinct().join(stars, ["row_a", "row_b"], "left_anti")
    new_links = written(verified(written(more, "pairs"), sets, percent), "links")
    parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new_links))
    return every, able, classes, sets, parts


def one_per_component(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id; rows without doc_id stay."""
    every, _, classes, _, parts = _connected(docs.select("doc_id", "text"), k, percent)
    member = classes.select("n", "d1", "d2", F.col("rep.doc_id").alias("node")).join(parts, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"))
    rows = every.select("n", "d1", "d2", "doc_id").join(member, ["n", "d1", "d2"], "left")
    out = rows.filter(F.col("doc_id") != _component()).select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti")
