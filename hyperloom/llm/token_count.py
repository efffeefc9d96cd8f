"""Token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

The encoding of a prefix ends in one token; cutting that token off leaves the encoding of a shorter prefix.  A token may follow
another if no merge across their border would have come before the merges that made the two.  So the last token of each
prefix is the one token that ends there and may follow the last token of what it leaves, and counts add up from left to right.
Texts fall into pieces that the tokenizer's own pre-tokenizer would never join; the counts of pieces are remembered.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space and what follows it. No pre-token reaches from a non-space into the white space behind it.
PIECE = re.compile(r"\s*\S+|\s+")
#: Python takes these for white space, the tokenizer does not; texts that hold one are not cut into pieces.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters whose classes no version of Unicode has moved: ASCII without the odd spaces, and the letters up to U+017F.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
PLAIN = re.compile(f"[\t-\r -~{_LETTERS}]+")
#: The pre-tokenizer's pattern over those characters (a fixed value of byte-level vocabularies of this kind).
WORD = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")
STANDARD = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Entries of a worker's memory for words, pieces, prefixes and pairs; what was not asked for lately is forgotten, which changes no result.
REMEMBERED = 300_000
#: Letters of the longest words whose prefixes are remembered.
SHARED = 48
_inf = math.inf


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on in order."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Remembered(dict):
    """Values of a function by its argument.  Two generations of ``REMEMBERED`` entries at most are kept: when the younger one is full the
    older one goes, and what is asked for again moves to the younger one."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes, for a tokenizer file with a byte-level BPE model."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made = {a + b: (a, b) for a, b in merges}
        self.longest = max(map(len, self.made), default=1)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = Tokenizer.from_str(tokenizer_json).pre_tokenizer.pre_tokenize_str
        own = spec.get("pre_tokenizer") or {}
        self.plain = all(own.get(k) == v for k, v in STANDARD.items())
        self.letters = dict(enumerate(byte_letters()))
        self.sides: dict[str, tuple[list, list]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[int, str]] = {"": (0, "")}
        self.pieces = Remembered(self._plain)
        self.words = Remembered(self._word_count)
        self.plain_words = Remembered(lambda w: self._word_count(w.encode().decode("latin-1").translate(self.letters)))

    def _sides(self, token: str) -> tuple[list, list]:
        """What stands at the left and at the right border of a token while it is being made: (part, rank of the merge that takes it in)."""
        have = self.sides.get(token)
        if have is None:
            out = []
            for side in (0, 1):
                steps, t, taken = [], token, _inf
                while True:
                    steps.append((t, taken))
                    pair = self.made.get(t)
                    if pair is None:
                        break
                    taken = self.rank[pair]
                    t = pair[side]
                out.append(steps[::-1])
            have = self.sides[token] = (out[0], out[1])
        return have

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        key = (left, right)
        have = self.pairs.get(key)
        if have is not None:
            return have
        a, b = self._sides(left)[1], self._sides(right)[0]
        i = j = 0
        while True:
            x, leave = a[i]
            y, join = b[j]
            across = self.rank.get((x, y), _inf)
            if across < leave and across <= join and across < _inf:
                ok = False  # of equal merges the one on the left comes first
                break
            if leave == _inf and join == _inf:
                ok = True
                break
            if leave <= join:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _extend(self, word: str) -> tuple[int, str]:
        """(count, last token) of a word whose shorter prefixes are remembered."""
        n, prefixes, vocab = len(word), self.prefixes, self.vocab
        for k in range(max(0, n - self.longest), n):
            t = word[k:]
            if t in vocab:
                count, last = prefixes[word[:k]]
                if k == 0 or self.may_follow(last, t):
                    return count + 1, t
        raise ValueError("the vocabulary lacks a byte")

    def _long(self, word: str) -> list[int]:
        """The same table for a word too long to remember its prefixes."""
        counts, last = [0], [""]
        for i in range(1, len(word) + 1):
            for k in range(max(0, i - self.longest), i):
                t = word[k:i]
                if t in self.vocab and (k == 0 or self.may_follow(last[k], t)):
                    counts.append(counts[k] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def word_counts(self, word: str) -> list[int]:
        """Token counts of all prefixes of a pre-token, which is given in the vocabulary's letters; entry i is for i bytes.

        Prefixes of words of common length are remembered, so words that begin alike share the beginning's table.
        """
        if len(word) > SHARED:
            return self._long(word)
        prefixes = self.prefixes
        if len(prefixes) >= REMEMBERED:
            prefixes.clear()
            prefixes[""] = (0, "")
        counts = [0]
        for i in range(1, len(word) + 1):
            p = word[:i]
            have = prefixes.get(p)
            if have is None:
                have = prefixes[p] = self._extend(p)
            counts.append(have[0])
        return counts

    def _word_count(self, word: str) -> int:
        return 1 if word in self.made or len(word) == 1 else self.word_counts(word)[-1]

    def _is_plain(self, text: str) -> bool:
        return self.plain and PLAIN.fullmatch(text) is not None

    def _plain(self, text: str) -> int:
        if self._is_plain(text):
            return sum(map(self.plain_words.__getitem__, WORD.findall(text)))
        return sum(self.words[w] for w, _ in self.split(text)) if text else 0

    def count(self, text: str) -> int:
        """Tokens of a whole text; strings of special tokens count as one, as the library takes them by default."""
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else (text,)
        total = len(parts) - 1
        for part in parts:
            if self._is_plain(part) or ODD_SPACE.search(part):
                total += self._plain(part)
            else:
                total += sum(map(self.pieces.__getitem__, PIECE.findall(part)))
        return total

    def fits(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens.  Sums over whole words lead to the border; prefixes are
        tabled from three words before it to three words behind it, where every prefix is over the budget for good."""
        if self.cut and self.cut.search(text):
            return fits(self.prefix_counts(text), budget)
        if self._is_plain(text):
            words = WORD.findall(text)
            totals = np.cumsum([self.plain_words[w] for w in words])
        else:
            cut = self.split(text)
            words = [text[a:b] for _, (a, b) in cut]
            totals = np.cumsum([self.words[w] for w, _ in cut])
        border = int(np.searchsorted(totals, budget, side="right"))
        if border == len(words):
            return len(text)
        first = max(0, border - 3)
        begin, before = sum(map(len, words[:first])), int(totals[first - 1]) if first else 0
        return begin + fits(before + self._plain_prefixes("".join(words[first : border + 4])), budget)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i is the token count of the text's first i characters, each exactly as if only they were encoded."""
        out = np.zeros(len(text) + 1, np.int64)
        begin, base = 0, 0
        for hit in self.cut.finditer(text) if self.cut else ():
            out[begin : hit.end() + 1] = base + self._plain_prefixes(text[begin : hit.end()])
            base += self._plain(text[begin : hit.start()]) + 1
            out[hit.end()] = base
            begin = hit.end()
        out[begin:] = base + self._plain_prefixes(text[begin:])
        return out

    def _plain_prefixes(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        total, spans = 0, []
        for word, (a, b) in self.split(text):
            counts = self.word_counts(word)
            at = np.cumsum([0] + [len(c.encode()) for c in text[a:b]])
            out[a : b + 1] = total + np.asarray(counts)[at]
            # 're, 've and 'll are words of their own only as a whole
            if b - a == 3 and text[a] == "'":
                out[a + 2] = total + self._plain(text[a : a + 2])
            spans.append((a, b, total, counts[-1]))
            total += counts[-1]
        # a run of white space at the end of a prefix is one word there, even where its last character belongs to the next word
        for (a, b, before, _), (a2, _, _, _) in zip(spans[:-1], spans[1:]):
            if text[a:b].isspace() and text[a2].isspace() and not ODD_SPACE.search(text[a : a2 + 1]):
                out[a2 + 1] = before + self._plain(text[a : a2 + 1])
        return out


def fits(prefix_counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts <= budget)[-1])


_counters: dict[int, PrefixCounter] = {}


def _counter(tokenizer_json: str) -> PrefixCounter:
    key = hash(tokenizer_json)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(tokenizer_json)
    return _counters[key]


def _text_lists(batches: Iterator[pa.RecordBatch], column: int, most: int = 2000):
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield part, part.column(column).to_pylist()


def token_counts(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", prefixes: bool = False, budget: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row; with ``budget`` also fit_chars, the characters of the longest prefix that has at most so many tokens; with
    ``prefixes`` also prefix_tokens, an array whose entry i is the count of the first i characters.

    The id's column keeps its name.  A null text counts as empty: no bytes, no tokens, one prefix.  Rows with equal or null ids are counted each for
    itself; an empty table gives an empty result.  A word of any length is counted by the same table, in memory of its own length.
    The vocabulary file is read by the driver and sent along; it has the size of one vocabulary, whatever the corpus.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    key = docs.schema[id_column].dataType.simpleString()
    schema = f"_id {key}, n_bytes long, n_tokens long" + (", fit_chars long" if budget is not None else "") + (", prefix_tokens array<bigint>" if prefixes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec)
        for part, texts in _text_lists(batches, 1):
            texts = [t or "" for t in texts]
            if prefixes:
                tables = [counter.prefix_counts(t) for t in texts]
                counts = [int(p[-1]) for p in tables]
            else:
                counts = [counter.count(t) for t in texts]
            columns = [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
            names = ["_id", "n_bytes", "n_tokens"]
            if budget is not None:
                columns.append(pa.array([len(t) if n <= budget else counter.fits(t, budget) for t, n in zip(texts, counts)], pa.int64()))
                names.append("fit_chars")
            if prefixes:
                columns.append(pa.array([p.tolist() for p in tables], pa.list_(pa.int64())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_column), *out.columns[1:])
