"""Periodic runs of words: a suffix automaton whose suffix-link tree is a link-cut tree.

The automaton of a text's words grows word by word, and each state's colour is the last place where its words ended. The
states of the suffixes of what has been read are a path to the root; to append a word is to recolour that path, and
link-cut access does it segment by segment of one colour, in logarithmic amortised time. A segment of colour ``j`` met at
word ``i`` says which suffixes ended last at ``j``: those of lengths (shortest, longest] of the segment. If the distance
``d = i - j`` is one of these lengths, the last ``2 * d`` words are a primitive square, and every primitive square that ends at
``i`` is found so. A square extends, as long as words ``d`` apart are equal, to a run with smallest period ``d``.

Before that, words that cannot be in a wanted run are left out. All words of a run of length ``max(least, k * q)`` occur ``k``
times in it, and all triples of adjacent words ``k - 1`` times; so a stretch of a text is cut at every triple that does not, in
the stretch itself, until nothing changes. What is cut off holds no wanted run and no part of one.

Texts are read whole, in one pass without a shuffle; a task holds the words of one text at a time.

Defined results: a null text has no words; an empty text and one of blanks, too; a text without runs has an empty array, and its words joined
by one space; repeated rows and ids give a row each, null ids too; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquery.llm.common import BLANKS, words_by

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Rounds of cutting; more would only leave fewer words to the automaton.
ROUNDS = 12
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Automaton:
    """A suffix automaton over word numbers that knows where each of its states ended last."""

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.up, self.low, self.high = [-1], [-1], [-1]  # splay trees by depth; ``up`` of a tree's root is the parent of its path
        self.last = [-1]  # at the root of each splay tree
        self.end = 0

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.up.append(link)
        self.low.append(-1)
        self.high.append(-1)
        self.last.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its tree; the colour moves with it."""
        up, low, high, last = self.up, self.low, self.high, self.last
        while True:
            p = up[x]
            if p < 0:
                return
            left = low[p] == x
            if not left and high[p] != x:
                return
            g = up[p]
            if g >= 0 and ((above := low[g] == p) or high[g] == p):
                if above == left:  # the parent goes first
                    if left:
                        inner = low[g] = high[p]
                        high[p] = g
                    else:
                        inner = high[g] = low[p]
                        low[p] = g
                    if inner >= 0:
                        up[inner] = g
                    top = up[g]
                    up[g] = p
                else:
                    top = up[g]
                if left:
                    inner = low[p] = high[x]
                    high[x] = p
                else:
                    inner = high[p] = low[x]
                    low[x] = p
                if inner >= 0:
                    up[inner] = p
                if above != left:  # ``x`` goes between, too
                    if above:
                        inner = low[g] = high[x]
                        high[x] = g
                    else:
                        inner = high[g] = low[x]
                        low[x] = g
                    if inner >= 0:
                        up[inner] = g
                    up[g] = x
                up[p], up[x] = x, top
                if top >= 0 and low[top] == g:
                    low[top] = x
                elif top >= 0 and high[top] == g:
                    high[top] = x
                else:
                    last[x] = last[g]
                    return
            else:
                if left:
                    inner = low[p] = high[x]
                    high[x] = p
                else:
                    inner = high[p] = low[x]
                    low[x] = p
                if inner >= 0:
                    up[inner] = p
                up[p], up[x] = x, g
                last[x] = last[p]
                return

    def append(self, word: int, at: int) -> list[tuple[int, int]]:
        """Append ``word``, number ``at`` of the text: (period, longest common suffix with the text up to ``at - period``) of each primitive square that ends there."""
        length, link, following = self.length, self.link, self.next
        new = self._state(length[self.end] + 1, -1, {})
        p, self.end = self.end, new
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        parent = 0
        if p >= 0:
            parent = following[p][word]
            if length[p] + 1 < length[parent]:
                q, parent = parent, self._above(parent, length[p] + 1)
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = parent
                    p = link[p]
        link[new] = self.up[new] = parent
        return self._access(new, at)

    def _above(self, q: int, length: int) -> int:
        """A copy of ``q`` for its suffixes of up to ``length`` words, put between ``q`` and its parent; it ended last where ``q`` did."""
        self._splay(q)
        clone = self._state(length, self.link[q], dict(self.next[q]))
        higher = self.low[q]
        self.low[clone], self.up[clone], self.low[q] = higher, q, clone
        if higher >= 0:
            self.up[higher] = clone
        self.link[q] = clone
        return clone

    def _access(self, new: int, at: int) -> list[tuple[int, int]]:
        found = []
        below, x = new, self.up[new]
        while x >= 0:
            self._splay(x)
            colour, lower, above = self.last[x], self.high[x], self.up[x]
            if lower >= 0:
                self.last[lower] = colour
            d = at - colour
            if d <= self.length[x] and (self.length[above] if above >= 0 else 0) < d:
                found.append((d, self.length[x]))
            self.high[x] = below
            self.up[below] = x
            below, x = x, above
        self.last[below] = at
        return found


def maximal_runs(words: list[int], least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with ``length >= max(least, exponent * period)``, by start and period."""
    automaton = Automaton()
    upto: dict[int, int] = {}  # where the last run of each period ends
    out = []
    for i, word in enumerate(words):
        for d, common in automaton.append(word, i):
            if upto.get(d, 0) > i:
                continue
            end = i + 1
            while end < len(words) and words[end] == words[end - d]:
                end += 1
            upto[d] = end
            start = i - d - common + 1
            if end - start >= max(least, exponent * d):
                out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Disjoint or nearly disjoint parts (begin, end) of ``words`` that together hold every run of that length and exponent, each run within one part."""
    n = len(words)
    times = min(exponent - 1, max(least, exponent) - 2)  # a triple of a run starts so often in it
    if n < max(least, exponent):
        return []
    if times < 2 or least < 3:
        return [(0, n)]
    often = np.bincount(words) >= exponent
    good = often[words]
    starts = np.flatnonzero(good[:-2] & good[1:-1] & good[2:])
    wide = words.astype(np.uint64)
    triples = wide[:-2] * MIX[0] ^ (wide[1:-1] * MIX[1] + (wide[2:] * MIX[2] >> np.uint64(7)))  # alike by chance: only less is cut
    for _ in range(ROUNDS):
        label = np.cumsum(np.diff(starts, prepend=-2) != 1)
        if len(starts):
            held = np.bincount(label)[label] >= max(least, exponent) - 2
            starts, label = starts[held], label[held]
        if not len(starts):
            return []
        _, of, count = np.unique(triples[starts] + label.astype(np.uint64) * MIX[2], return_inverse=True, return_counts=True)
        kept = count[of] >= times
        closing = np.flatnonzero(np.diff(label, append=-1))
        places = np.concatenate([starts, starts[closing] + 1, starts[closing] + 2])
        _, of, count = np.unique(np.concatenate([label, label[closing], label[closing]]) * n + words[places], return_inverse=True, return_counts=True)
        enough = count[of] >= exponent
        kept &= enough[: len(starts)]
        kept[closing] &= enough[len(starts) : len(starts) + len(closing)] & enough[len(starts) + len(closing) :]
        if kept.all():
            break
        starts = starts[kept]
    cuts = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return [(int(part[0]), int(part[-1]) + 3) for part in np.split(starts, cuts[1:]) if len(part) and len(part) + 2 >= max(least, exponent)]


def runs_of(words: list[bytes], least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    numbers: dict[bytes, int] = {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    out = []
    for begin, end in stretches(coded, least, exponent):
        out += [(begin + start, length, period) for start, length, period in maximal_runs(coded[begin:end].tolist(), least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that repeat the period before them in a run."""
    if not runs:
        return words
    dropped = np.zeros(len(words), bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return [w for w, x in zip(words, dropped.tolist(), strict=True) if not x]


RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Rows that leave a task at once.
ROWS_AT_ONCE = 500


def _found(batches: Iterator[pa.RecordBatch], least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            runs, kept = [], []
            for text in batch.column("text"):
                words = (text.as_py() or b"").split()  # bytes split at the six ASCII blanks alone
                some = runs_of(words, least, exponent) if len(words) >= max(least, exponent) else []
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in some])
                kept.append(b" ".join(collapse(words, some)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Per text (doc_id, text) RUNS: its runs of ``max(least, exponent * period)`` words or more, by start and period, and its words without the repeats, joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _found(batches, least, exponent), RUNS)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), the ends of a tenth of all texts, chosen by the ids' checksums, replaced by repeats of their own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        block = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(block), F.lit(1), n - a)), " "))

    text = F.col("text").cast("string")
    once = F.transform(F.array(words_by(text, BLANKS)), repeated)[0]  # the words are made once a text
    return docs.select("doc_id", F.when(h % 10 == 0, once).otherwise(text).alias("text"))
