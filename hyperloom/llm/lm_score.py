"""Language-model scores from a weighted backoff automaton over words, pairs and triples of words.

States are the empty context, the words that occur in training and the pairs that occur there at least ``LEAST`` times.  An arc (state, word) has the
smoothed log10 probability of the word after the state's words; the state's failure arc drops its first word and has the weight that is left for words
not seen after it; the empty context has an arc for every word.  Smoothing is by a Dirichlet prior of ``STRENGTH`` draws from the shorter context, so
probabilities of a state sum to one and need counts alone.  A text is read from left to right: failure arcs until the state has an arc for the
word, then that arc, which leads to the longest state that the text so far ends with.

Counts come from the whole training part through ``_exchange``: words and pairs first, then triples whose pair is a state.  Each chunk of
documents builds the part of the automaton that its own texts can reach and runs them through it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import chunk_of, cuts, groups_of, hash_bits, pack, pack_sorted, plan_sizes, stable_order, unpack, unpack_sorted, volume
from ._scratch import written
from ._text import Words, mix

STRENGTH, LEAST = 200.0, 2
#: The end of a text, which is also the context of its first word.
END = np.uint64(0x3C79AC492BA7B653)
_PAIR, _TRIPLE = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x9FB21C651E98DF25)


class BackoffAutomaton:
    """The automaton as explicit states and arcs, for sequences of hashable words; ``end`` closes and opens each sequence.  States are tuples of words."""

    def __init__(self, texts: list[list], strength: float = STRENGTH, least: int = LEAST):
        end = object()
        self.end, self.root = end, ()
        words, pairs, triples = Counter(), Counter(), Counter()
        for t in texts:
            tokens = [end, *t, end]
            words.update(tokens[1:])
            pairs.update(zip(tokens, tokens[1:]))
            triples.update(zip(tokens, tokens[1:], tokens[2:]))
        n, v = sum(words.values()), len(words)
        self.seen, self.unseen = words, 1 / (n + v + 1)
        p = {(w,): (c + 1) / (n + v + 1) for w, c in words.items()}
        p |= {(h, w): (c + strength * p[w,]) / (words[h] + strength) for (h, w), c in pairs.items()}
        self.states = {self.root, *((w,) for w in words), *(k for k, c in pairs.items() if c >= least)}
        p |= {(g, h, w): (c + strength * p[h, w]) / (pairs[g, h] + strength) for (g, h, w), c in triples.items() if (g, h) in self.states}
        self.arcs = {(k[:-1], k[-1]): np.log10(x) for k, x in p.items()}
        count = lambda k: words[k[0]] if len(k) == 1 else pairs[k]
        self.failure = {k: np.log10(strength / (count(k) + strength)) for k in self.states if k}

    def longest(self, words: tuple) -> tuple:
        """The longest state that ends the words."""
        while words not in self.states:
            words = words[1:]
        return words

    def score(self, text: list) -> float:
        state, total = self.longest((self.end,)), 0.0
        for w in [*text, self.end]:
            at = state
            while at and (at, w) not in self.arcs:
                total += self.failure[at]
                at = at[1:]
            total += self.arcs.get((at, w), np.log10(self.unseen))
            state = self.longest((*state, w)[-2:])
        return total


class Arcs:
    """A part of the automaton in arrays: arcs sorted by state and word, and each state's failure arc.  State 0 is the empty context."""

    def __init__(self, n_words: int, states: np.ndarray, words: np.ndarray, weights: np.ndarray, failure_to: np.ndarray, failure: np.ndarray):
        key = states.astype(np.int64) * n_words + words
        order = np.argsort(key, kind="stable")
        self.key, self.weights, self.n_words = key[order], weights[order], n_words
        self.failure_to, self.failure = failure_to, failure

    def read(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """What reading each word in each state adds: failure arcs as long as the state has no arc for the word, then the arc."""
        out, state, todo = np.zeros(len(words)), states.copy(), np.arange(len(words))
        while len(todo):
            key = state[todo] * self.n_words + words[todo]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            out[todo[found]] += self.weights[at[found]]
            todo = todo[~found]
            out[todo] += self.failure[state[todo]]
            state[todo] = self.failure_to[state[todo]]
        return out


class _Tokens:
    """The words and ends of a chunk's texts in order, their distinct hashes, and the distinct pairs of a context and a word."""

    def __init__(self, table: pa.Table, shift: np.uint64):
        w = Words(table["text"], lower=True)
        self.n = w.count + 1
        at = np.cumsum(self.n) - 1  # of the ends
        tokens = np.empty(int(self.n.sum()), np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[at] = False
        tokens[at], tokens[inside] = END, w.hash
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        context[: min(1, len(context))] = END
        self.first = at - w.count
        self.train = np.repeat(np.asarray(table["train"].combine_chunks().fill_null(False)) if len(w.count) else np.zeros(0, bool), self.n)
        self.shift, self.tokens, self.context = shift, tokens, context
        self.word, self.word_of, self.word_n = self._distinct(tokens >> shift, self.train)
        self.pair, self.pair_of, self.pair_n = self._distinct(mix(context * _PAIR + tokens) >> shift, self.train)

    def _distinct(self, h: np.ndarray, train: np.ndarray):
        """Distinct hashes, which of them each token has, and their number in training texts."""
        order = stable_order(h)
        first, run = groups_of(h[order])
        of = np.empty(len(h), np.int64)
        of[order] = run
        return h[order][first], of, np.bincount(of, weights=train, minlength=len(first)).astype(np.uint64)

    def triples(self, pair_counts: np.ndarray, least: int):
        """Tokens whose two words before are a state; their distinct triples, which of them each has, and their number in training texts."""
        at = np.arange(1, len(self.tokens))
        at = at[pair_counts[self.pair_of[at - 1]] >= least] if len(at) else at
        begins = np.zeros(len(self.tokens), bool)
        begins[self.first] = True
        at = at[~begins[at]]
        before = mix(self.context[at - 1] * _TRIPLE + self.context[at])
        return at, *self._distinct(mix(before * _PAIR + self.tokens[at]) >> self.shift, self.train[at])


def _ask(chunk: int, n_ranges: int, shift: np.uint64, **grams) -> pa.Table:
    """A row for each range that any of the named grams (hashes, counts) falls into."""
    at = {name: cuts(h << shift, n_ranges) for name, (h, _) in grams.items()}
    some = np.flatnonzero(sum(np.diff(x) for x in at.values()))
    out = {"r": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int32())}
    for name, (h, n) in grams.items():
        parts = [(at[name][r], at[name][r + 1]) for r in some]
        out[name] = pa.array([pack_sorted(h[a:b]) for a, b in parts], pa.binary())
        out[f"{name}_n"] = pa.array([pack(n[a:b]) for a, b in parts], pa.binary())
    return pa.table(out)


def _total(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """Each chunk's answer, the sums of what all chunks sent for the grams it asked about, and the sums."""
    asked = [unpack_sorted(x.as_py()) for x in table[name]]
    n = np.concatenate([unpack(x.as_py()) for x in table[f"{name}_n"]])
    every = np.concatenate(asked)
    counts, sums = np.zeros(len(every), np.uint64), np.zeros(0, np.uint64)
    if len(every):
        order = stable_order(every)
        first, run = groups_of(every[order])
        sums = np.add.reduceat(n[order], first)
        counts[order] = sums[run]
    ends = np.cumsum([0] + [len(x) for x in asked])
    return pa.array([pack(counts[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()), sums


def _counts(table: pa.Table, name: str) -> np.ndarray:
    """A chunk's answers for one kind of grams, in the order of its distinct grams."""
    if name == "triples":
        table = table.filter(pa.compute.is_valid(table["triples"]))
    else:
        table = table.filter(pa.compute.is_null(table["triples"]))
    table = table.sort_by("r")
    return np.concatenate([unpack(x.as_py()) for x in table[name]] or [np.zeros(0, np.uint64)])


_ANSWER = "chunk int, r int, words binary, pairs binary, triples binary, tokens long, distinct long"


def _answer(table: pa.Table, **columns) -> pa.Table:
    n = len(table)
    none = {"words": pa.nulls(n, pa.binary()), "pairs": pa.nulls(n, pa.binary()), "triples": pa.nulls(n, pa.binary()), "tokens": pa.nulls(n, pa.int64()), "distinct": pa.nulls(n, pa.int64())}
    return pa.table({"chunk": table["chunk"], "r": table["r"]} | none | columns)


def corpus_counts(rows: DataFrame, n_bytes: int, least: int) -> tuple[DataFrame, int, int, np.uint64]:
    """Answers with the training counts of each chunk's distinct words and pairs, and of its triples after a state, in order; training tokens and distinct ones."""
    _, n_ranges = plan_sizes(2 * n_bytes)
    shift = np.uint64(64 - hash_bits(n_bytes, 24))

    def ask(key, table):
        t = _Tokens(table, shift)
        return _ask(key[0].as_py(), n_ranges, shift, word=(t.word, t.word_n), pair=(t.pair, t.pair_n))

    def answer(key, table):
        words, sums = _total(table, "word")
        pairs, _ = _total(table, "pair")
        n = len(table)
        return _answer(table, words=words, pairs=pairs, tokens=pa.array([int(sums.sum())] * n, pa.int64()), distinct=pa.array([int((sums > 0).sum())] * n, pa.int64()))

    asked = rows.groupBy("chunk").applyInArrow(ask, "r int, chunk int, word binary, word_n binary, pair binary, pair_n binary")
    short = written(asked.groupBy("r").applyInArrow(answer, _ANSWER), "lm-words")
    sizes = short.groupBy("r").agg(F.max("tokens").alias("tokens"), F.max("distinct").alias("distinct")).agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()

    def ask_triples(key, left, right):
        t = _Tokens(left, shift)
        _, h, _, n = t.triples(_counts(right, "pairs"), least)
        return _ask(key[0].as_py(), n_ranges, shift, triple=(h, n))

    def answer_triples(key, table):
        return _answer(table, triples=_total(table, "triple")[0])

    asked = rows.groupBy("chunk").cogroup(short.groupBy("chunk")).applyInArrow(ask_triples, "r int, chunk int, triple binary, triple_n binary")
    long = written(asked.groupBy("r").applyInArrow(answer_triples, _ANSWER), "lm-triples")
    return short.unionByName(long), int(sizes.n or 0), int(sizes.v or 0), shift


def score_texts(docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", strength: float = STRENGTH, least: int = LEAST) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score per row; the model learns from the rows where ``train`` holds (null: it does not).

    A-Z are made small.  A null or empty text is its end alone.  Rows with equal or null ids are scored, and learned from, each for itself; columns of
    ``docs`` other than the id and the text serve ``train`` alone, whatever their names.  A text of any length is read whole, in memory of its length.
    If nothing is there to learn from, every token has probability one.  An empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_bytes, _ = volume(rows)
    n_chunks, _ = plan_sizes(n_bytes)
    rows = rows.select(chunk_of(n_chunks).alias("chunk"), "doc_id", "text", "train")
    answers, n, v, shift = corpus_counts(rows, max(n_bytes, 1), least)

    def score(key, left, right):
        t = _Tokens(left, shift)
        word_c, pair_c = _counts(right, "words").astype(np.float64), _counts(right, "pairs").astype(np.float64)
        at3, triple, triple_of, _ = t.triples(pair_c, least)
        triple_c = _counts(right, "triples").astype(np.float64)
        sums = lambda x: np.add.reduceat(x, t.first) if len(t.first) else np.zeros(0)
        c = word_c[t.word_of]
        p1 = (word_c + 1) / (n + v + 1)
        # states: the empty context, the known words, the frequent pairs
        word_state, pair_state = np.zeros(len(t.word), np.int64), np.zeros(len(t.pair), np.int64)
        known, frequent = np.flatnonzero(word_c > 0), np.flatnonzero(pair_c >= least)
        word_state[known] = np.arange(1, len(known) + 1)
        pair_state[frequent] = np.arange(len(known) + 1, len(known) + len(frequent) + 1)
        place = np.empty(len(t.pair), np.int64)
        place[t.pair_of] = np.arange(len(t.pair_of))  # a place of each pair in the texts, which tells its words
        before = np.empty_like(t.word_of)  # the word before each token; an end, whichever, before the first
        before[1:] = t.word_of[:-1]
        if len(before):
            before[t.first] = t.word_of[t.first + t.n - 1]
        # arcs: of the empty context for each word, of words for the pairs, of pairs for the triples that occur in training
        second, first = t.word_of[place], before[place]
        p2 = (pair_c + strength * p1[second]) / (word_c[first] + strength)
        seen = np.flatnonzero(pair_c > 0)
        place3 = np.empty(len(triple), np.int64)
        place3[triple_of] = at3
        front = t.pair_of[place3 - 1]
        p3 = (triple_c + strength * p2[t.pair_of[place3]]) / (pair_c[front] + strength)
        seen3 = np.flatnonzero(triple_c > 0)
        arcs = Arcs(
            max(1, len(t.word)),
            np.concatenate((np.zeros(len(t.word), np.int64), word_state[first[seen]], pair_state[front[seen3]])),
            np.concatenate((np.arange(len(t.word)), second[seen], t.word_of[place3[seen3]])),
            np.log10(np.concatenate((p1, p2[seen], p3[seen3]))),
            np.concatenate(([0], np.zeros(len(known), np.int64), word_state[second[frequent]])),
            np.log10(np.concatenate(([1.0], strength / (word_c[known] + strength), strength / (pair_c[frequent] + strength)))),
        )
        # the state that the text has led to before each token: the longest one that the words before it end with
        state = word_state[before]
        pair_before = np.zeros_like(state)
        pair_before[1:] = pair_state[t.pair_of[:-1]]
        if len(state):
            pair_before[t.first] = 0
        state = np.where(pair_before > 0, pair_before, state)
        return pa.table(
            {"doc_id": left["doc_id"], "n_tokens": pa.array(t.n, pa.int64()), "n_known": pa.array(sums((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([n] * len(t.n), pa.int64()), "base_score": pa.array(sums(np.log10(p1)[t.word_of]), pa.float64()), "score": pa.array(sums(arcs.read(state, t.word_of)), pa.float64())}
        )

    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_column)
