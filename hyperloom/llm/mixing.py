"""Mixing sources to target weights with a low-discrepancy schedule.

Points of the golden-ratio sequence fall into the sources' shares of the unit interval, so that every stretch of the
schedule holds each source in its proportion.  The k-th slot of a source takes the k-th block of its documents, which lie
end to end in shuffled order and are cut into blocks of equal length; after the last block a second cycle begins.
Each source has as many slots as its target needs: slots that the sequence gives beyond them are left out, missing ones follow
at the schedule's end, and the last block is cut, so every source is taken to the word of its target.
Everything is DataFrame expressions; only word counts, never texts, are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._rank import running_sum, told_apart
from ._scratch import written

SPACES = r"[\x20\x09-\x0D]+"
#: 2**40 over the golden ratio: n times it, modulo 2**40, is the sequence as whole numbers.
GOLDEN, UNIT = 679486854955, 1 << 40
#: Parts of the unit interval, by which slots meet the few sources whose share overlaps theirs.
CELLS = 4096


@dataclass(frozen=True)
class MixPlan:
    """Weights of the sources in code point order, repeating; share of all words to take; most cycles; size of a block.

    A block has ``least_block`` words.  ``most_slots``, if given, bounds the schedule by longer blocks; what is taken stays the same.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cycles: int = 2
    least_block: int = 32
    most_slots: int | None = None
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")


def targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """sid, source, source_size, target, from, to (the source's share of the unit), block (words of a block), words (the target as a whole
    number), slots (blocks that hold them) per source.

    ``sizes`` has source and size.  A source gets its weight's share, at most ``cycles`` times its size; what that leaves over goes to
    the others by weight, until none is above.  Sorted by size over weight the capped sources come first, so running sums tell all.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in plan.weights]), (F.col("sid") % len(plan.weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", (F.col("source_size") * plan.cycles).cast("double"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(every) * plan.share)
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    capped = F.col("cap") <= F.col("w") * F.col("level")
    per = per.withColumn("final", F.max(F.when(~capped, F.col("level"))).over(every))
    per = per.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.col("w") * F.col("final")))
    longer = F.ceil(F.col("budget") / plan.most_slots) if plan.most_slots else F.lit(0)
    per = per.withColumn("block", F.greatest(F.lit(plan.least_block), longer).cast("long"))
    # whole cycles, and the blocks of the last one; a source without words has none
    size = F.greatest("source_size", F.lit(1))
    per = per.withColumn("words", F.round("target").cast("long"))
    whole, rest = F.floor(F.col("words") / size), F.col("words") % size
    per = per.withColumn("slots", (whole * F.ceil(size / F.col("block")) + F.ceil(rest / F.col("block"))).cast("long"))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("slots").over(every)
    edge = F.when(total > 0, F.round(F.sum("slots").over(upto) / total * UNIT)).otherwise(0).cast("long")
    per = per.withColumn("to", edge).withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("sid")), F.lit(0)))
    return per.select("sid", "source", "source_size", "target", "from", "to", "block", "words", "slots")


def golden(n: Column) -> Column:
    """n times GOLDEN modulo UNIT, by halves of 20 bits, since the product itself leaves the longs above 13 M."""
    low, high = n % (1 << 20), F.floor(n / (1 << 20))
    return (low * F.lit(GOLDEN) + (high * F.lit(GOLDEN)) % (1 << 20) * (1 << 20)) % F.lit(UNIT)


def schedule(spark, sources: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per slot of the mix: slot, sid, cycle, block_no, stop (the word of the source before which the slot's block ends).
    The k-th slot of a source takes its block k, over and over, until the source's words are reached."""
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("all")).first()["all"]
    width = UNIT // CELLS
    slots = spark.range(n).select(F.col("id").alias("slot"), golden(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / width))
    shares = sources.filter("to > from").select("sid", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))).alias("cell"))
    slots = slots.join(shares, "cell").filter("u >= from and u < to").select("slot", "sid", F.shiftright("slot", 12).alias("part"))
    # a slot's rank in its source: what earlier parts of the schedule hold, and the place inside its part
    counts = written(slots.groupBy("sid", "part").count(), "mix-counts")
    bases = counts.select("sid", "part", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(bases, ["sid", "part"]).select("slot", "sid", (F.col("inside") + F.col("base")).alias("rank"))
    # the sequence is a few slots off a source's number; what is missing comes at the end
    few = sources.join(counts.groupBy("sid").agg(F.sum("count").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    before = F.coalesce(F.sum(F.col("slots") - F.col("got")).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("before", before).select("sid", "got", "before", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    ranked = ranked.unionByName(few.select((F.col("before") + F.col("rank") - F.col("got") + n).alias("slot"), "sid", "rank"))
    ranked = ranked.join(sources.select("sid", "source_size", "block", "words", "slots"), "sid").filter("rank < slots")
    blocks = F.ceil(F.col("source_size") / F.col("block"))
    ranked = ranked.withColumn("cycle", F.floor(F.col("rank") / blocks)).withColumn("block_no", F.col("rank") % blocks)
    stop = F.least((F.col("block_no") + 1) * F.col("block"), "source_size", F.col("words") - F.col("cycle") * F.col("source_size"))
    return ranked.select("slot", "sid", "cycle", "block_no", stop.alias("stop"))


def _mix(sized: DataFrame, plan: MixPlan) -> DataFrame:
    """``sized`` is a written table with _row (no two alike), _order (a hash of the row's content), source, size and any other columns.
    These with source_size, target, taken and spans."""
    spark = sized.sparkSession
    sources = written(targets(sized, plan), "mix-targets")
    n_rows = sized.count()
    rows = told_apart(sized, "_order", "_row", n_rows)
    rows = rows.join(F.broadcast(sources.select(F.col("source").alias("_s"), "sid", "source_size", "target", "block")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = written(running_sum(rows, ["sid"], F.col("_order"), F.col("size"), "at", n_rows).drop("_order"), "mix-rows")
    full = rows.filter("size > 0")
    pieces = full.select("sid", "at", "size", "block", F.explode(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))).alias("block_no"))
    first = F.greatest(F.col("block_no") * F.col("block") - F.col("at"), F.lit(0))
    last = F.least(F.col("stop") - F.col("at"), F.col("size"))
    # Spark takes the pieces for as small as the rows they come from, and would broadcast millions of them
    taken = pieces.hint("merge").join(schedule(spark, sources, plan), ["sid", "block_no"]).select("sid", "at", "cycle", first.alias("first"), last.alias("last")).filter("first < last")
    # blocks of one cycle are taken from the source's start on, so a row's pieces of a cycle adjoin
    spans = taken.groupBy("sid", "at", "cycle").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("last") - F.col("first")).alias("words"))
    spans = spans.groupBy("sid", "at").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("cycle", "first", "last"))).alias("spans"))
    spans = spans.withColumnRenamed("sid", "_sid").withColumnRenamed("at", "_at")
    out = rows.join(spans, (F.col("sid") == F.col("_sid")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left")
    none = F.array().cast("array<struct<cycle:bigint,first:bigint,last:bigint>>")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("spans", F.coalesce("spans", none)).drop("sid", "at", "block", "_sid", "_at")


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), keep: tuple[str, ...] = ("doc_id",), source: str = "source", text: str = "text") -> DataFrame:
    """What the mix takes of each row: the columns of ``keep`` with source, size, source_size, target (double), taken (words, repeats counted) and
    ``spans``, an array of (cycle, first, last): words first to last-1, counted from 0, are taken in that cycle.

    A null text has no words; it and an empty text get taken 0 and no spans.  Null is a source of its own, the last one.
    Repeated rows are rows of their own, each taken at most ``cycles`` times.  An empty table gives an empty result.  Other columns are not read, and
    a column of ``keep`` may bear an output's name.  A text of any length is a run of blocks like many short ones.
    Reruns agree: the order of documents is that of a hash of the kept columns, source and size.
    """
    names = [f"_x{i}" for i in range(len(keep))]
    sized = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    sized = sized.select("*", F.xxhash64(F.lit(plan.seed), *names, "source", "size").alias("_order"), F.monotonically_increasing_id().alias("_row"))
    out = _mix(written(sized, "mix-sizes"), plan)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "source", "size", "source_size", "target", "taken", "spans")


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan(), source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each cycle in which a document is taken, whole texts as they are, others as the
    taken words joined by one space.  ``n_chars``, if there, follows the text.  Documents without words are not taken by any slot, so they are left out.

    Rows are numbered and written once; the mix works on numbers, sources and sizes, and texts meet their spans by the number, in one shuffle.
    """
    keep = tuple(docs.columns)
    c = [f"_c{i}" for i in range(len(keep))]
    t, s = F.col(c[keep.index(text)]), F.col(c[keep.index(source)])
    base = docs.toDF(*c).select("*", word_count(t).alias("_size"), F.monotonically_increasing_id().alias("_row"))
    base = written(base.withColumn("_order", F.xxhash64(F.lit(plan.seed), *c)), "mix-documents")
    took = _mix(base.select("_row", "_order", s.alias("source"), F.col("_size").alias("size")), plan)
    took = took.filter("taken > 0").select("_row", "spans")
    rows = base.drop("_order").join(took, "_row").select("*", F.explode("spans").alias("_span"))
    words = F.array_remove(F.split(t, SPACES), "")
    whole = (F.col("_span.first") == 0) & (F.col("_span.last") == F.col("_size"))
    cut = F.array_join(F.slice(words, (F.col("_span.first") + 1).cast("int"), (F.col("_span.last") - F.col("_span.first")).cast("int")), " ")
    rows = rows.withColumn("_t", F.when(whole, t).otherwise(cut))
    out = []
    for name, column in zip(keep, c):
        x = F.col("_t") if name == text else F.length("_t").cast(docs.schema[name].dataType) if name == "n_chars" else F.col(column)
        out.append(x.alias(name))
    return rows.select(*out)
