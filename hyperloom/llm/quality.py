"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Measures and rules are data.  ``measures()`` has an expression per measure, ``RULES`` a row per threshold, and
``quality_rules`` turns both into one ``select`` without a shuffle, a join or a user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages that the corpus is known to hold.
STOP_WORDS = {
    "en": "a and are as at be but by for from had have he her his in is it not of on or she that the their they this to was were which with you",
    "de": "aber als am an auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nicht sich sie sind und von war zu",
    "fr": "au aux avec ce dans de des du elle en est et il je la le les leur mais ne par pas plus pour que qui se son sur un une",
    "es": "a al como con de del el en es esta ha la las lo los más no para pero por que se son su sus un una y",
}
SPACES, MARKS = r"[\x20\x09-\x0D]+", r"[^A-Z#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` times 100 is below ``least`` or above ``most`` per cent of ``per``; the rule holds from ``words`` words on."""

    name: str
    measure: str
    per: str
    least: int | None = None
    most: int | None = None
    words: int = 0


#: The method's verdict. Each row is one comparison of whole numbers, so there is no rounding to differ in.
RULES = (
    Rule("short words", "word_chars", "n_words", least=250),
    Rule("long words", "word_chars", "n_words", most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("capitals", "n_capitals", "word_chars", most=40),
    Rule("no stop words", "n_stop_words", "n_words", least=1, words=100),
    Rule("duplicate lines", "n_dup_lines", "n_lines", most=50),
    Rule("runs of a word", "n_runs", "n_words", most=20),
)
#: The base rule, which the contract fixes.
MIN_WORDS, MAX_REPEATED = 20, 30


def measures(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Arrays to be projected first, and the measures over them (columns ``_words`` and ``_lines``)."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({v for w in " ".join(STOP_WORDS.values()).split() for v in (w, w.capitalize())})
    arrays = {
        "_words": F.array_remove(F.split(text, SPACES), ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""),
        "_marks": F.regexp_replace(text, MARKS, ""),
    }
    words, n = F.col("_words"), F.size("_words")
    own = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(F.regexp_replace("_marks", "[A-Z]+", "")),
        "n_capitals": F.length(F.regexp_replace("_marks", "[^A-Z]+", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stops))),
        "n_runs": F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))),
    }
    return arrays, own


def _window_columns(df: DataFrame) -> DataFrame:
    """Adds ``_repeat``: the words inside 8-word windows that occur twice or more, the first time included.

    Windows are compared by a 64-bit hash of 64-bit word hashes.  A set of plain longs tells the many texts without a repeated
    window from the others; only the others pay for the sort of (hash, position) that finds where the repeats stand.
    """
    # Each array is named more than once below, so that the optimizer keeps it as a column and does not repeat it for each element.
    # Windows of 8 words are made in three steps, of 2, 4 and 8; the last 7 entries hold less than a window and are cut off.
    n = F.size("_h")
    for step in (1, 2, 4):
        df = df.withColumn("_h", F.zip_with("_h", F.slice("_h", F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_win", F.when(n >= WINDOW, F.slice("_h", F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_win")) < F.size("_win")
    none = F.lit(None).cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_pairs", F.when(some, F.sort_array(F.arrays_zip(F.col("_win").alias("h"), F.sequence(F.lit(0), F.size("_win") - 1).alias("i")))).otherwise(none))
    pairs = F.col("_pairs")
    last = F.size(pairs) - 1
    df = df.withColumn(
        "_at",
        F.when(
            pairs.isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(pairs, lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == p["h"]))),
                    lambda p: p["i"],
                )
            ),
        ),
    )
    at = F.col("_at")
    gap = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return df.withColumn("_repeat", F.when(F.size(at) > 0, F.aggregate(gap, F.lit(WINDOW), lambda s, x: s + x)).otherwise(F.lit(0)))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: no rule is broken."""
    ok = F.lit(True)
    for r in rules:
        value, per = F.col(r.measure).cast("long") * 100, F.col(r.per).cast("long")
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (value < per * r.least)
        if r.most is not None:
            bad = bad | (value > per * r.most)
        ok = ok & ~(bad & (F.col("n_words") >= r.words))
    return ok


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with the measures (long), ``base_failed``, ``kept`` and ``broken`` (names of the rules broken).

    A null text has no words, so it fails the base rule; so does an empty one.  Input columns pass through, but for those
    that bear the name of a measure, which are replaced.  Repeated rows are judged alike; an empty table stays empty.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines", "n_stop_words", "n_runs"]
    arrays, own = measures(F.col("_text"))
    # input columns travel one by one under other names, so that those nobody asks for are pruned before the arrays are built
    passed = [F.col(f"_in{i}") for i in range(len(docs.columns))]
    df = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("_text"))
    df = df.select(*passed, *[c.alias(k) for k, c in arrays.items()])
    df = df.select(*passed, *[c.cast("long").alias(k) for k, c in own.items()], F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    df = _window_columns(df).withColumn("n_repeat_words", F.col("_repeat").cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~compile_rules((r,)), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    df = df.select(*passed, *names, failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"), broken.alias("broken"))
    own_names = {*names, "base_failed", "kept", "broken"}
    return df.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns) if c not in own_names], *names, "base_failed", "kept", "broken")


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are.

    The filter also asks for a number that Spark may not work out twice.  Without it the optimizer would push the filter below the projections and
    work every measure out again for each mention of it.
    """
    n = len(docs.columns)
    renamed = docs.toDF(*[f"_d{i}" for i in range(n)]).withColumn("_text_", F.col(f"_d{docs.columns.index(text)}"))
    rated = quality_rules(renamed, "_text_", rules).withColumn("_once", F.monotonically_increasing_id())
    return rated.filter(F.col("kept") & (F.col("_once") >= 0)).select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)])
