"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

The lexicon is learnt: words that labelled toxic texts hold far more often than others, of ``LABELLED`` rows of
either label at most, near copies among them counted once; every word that passes the test of its odds is in. It is kept as a
trie, and a word of a text is matched by running the automaton of all words within one edit (insertion, deletion,
replacement or swap of neighbours) of it over the trie, state set by state set, so misspelled terms are found without
listing their variants. Words are runs of letters, and also two such runs with one other mark between ("st*pid"). Terms
under ``FUZZY_FROM`` letters match exactly; a near form that clean labelled texts use is no misspelling.

Each hit is seen in its window of ``NEAR`` words on either side: whether it stands inside quotation marks,
and how many other hits are near. A logistic model of these figures gives the score: quoted single hits weigh
what the labelled rows say they weigh, clusters of plain hits more.

Words are counted over the labelled rows; texts are read whole, in one pass without a shuffle.

Defined results: a null or empty text has no hits; without labelled rows of both labels every score is 0; repeated rows
each give their row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowquery.llm.common import materialize
from flowquery.llm.labelled import sample

LABELLED = 8_192
#: A term's share of toxic texts is at least so many times its share of others.
ODDS = 12.0
FUZZY_FROM = 5
NEAR = 8
MEMO_ENTRIES = 300_000

WORD = re.compile(r"[^\W\d_]+")
#: Two words with one mark between.
MARKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[^\sa-z][^\W\d_]+")
#: Marks that open and close quotations.
QUOTES = re.compile("[\"«»“”„]")


class Trie:
    """Terms by their letters, forwards and backwards; ``END`` marks a whole term."""

    END = ""

    def __init__(self, words):
        self.ahead, self.back = {}, {}
        self.whole = set(words)
        #: Per length of a term: the beginnings and endings of which one edit leaves one as it is.
        self.heads, self.tails = defaultdict(set), defaultdict(set)
        for word in words:
            if len(word) < FUZZY_FROM:
                continue
            for root, letters in ((self.ahead, word), (self.back, word[::-1])):
                node = root
                for letter in letters:
                    node = node.setdefault(letter, {})
                node[self.END] = word
            a, b = self.halves(len(word))
            self.heads[len(word)].add(word[:a])
            self.tails[len(word)].add(word[-b:])

    @staticmethod
    def halves(length: int) -> tuple[int, int]:
        """An edit touches two adjacent letters at most, so not both the first a and the last b."""
        a = (length - 1) // 2
        return a, length - 1 - a

    def near(self, word: str) -> str | None:
        """A term of FUZZY_FROM letters or more within one edit of ``word``."""
        n = len(word)
        for length in (n, n - 1, n + 1):
            if length not in self.heads:
                continue
            a, b = self.halves(length)
            if word[:a] in self.heads[length] and (found := self.walk(self.ahead, word, a)):
                return found
            if word[n - b :] in self.tails[length] and (found := self.walk(self.back, word[::-1], b)):
                return found
        return None

    def walk(self, node: dict, word: str, same: int) -> str | None:
        """Intersect the trie below the first ``same`` letters with the automaton of all words one edit from ``word``.

        A state is (letters of the word used, edits made, letter that a swap still owes). A branch is
        left when no state survives its letter.
        """
        for letter in word[:same]:
            node = node.get(letter)
            if node is None:
                return None
        n = len(word)
        stack = [(node, {(same, 0, None), (same + 1, 1, None)})]
        while stack:
            node, states = stack.pop()
            for letter, below in node.items():
                if letter == self.END:
                    if any(owed is None and n - at + edits <= 1 for at, edits, owed in states):
                        return below
                    continue
                after = set()
                for at, edits, owed in states:
                    if owed is not None:
                        if letter == owed:
                            after.add((at + 2, 1, None))
                        continue
                    if at < n and word[at] == letter:
                        after.add((at + 1, edits, None))
                        if not edits:
                            after.add((at + 2, 1, None))  # the word has a letter too many after this one
                    if not edits:
                        after.add((at, 1, None))  # it lacks a letter
                        after.add((at + 1, 1, None))  # a letter is replaced
                        if at + 1 < n and word[at + 1] == letter:
                            after.add((at, 0, word[at]))  # two letters are swapped
                after = {s for s in after if s[0] <= n}
                if after:
                    stack.append((below, after))
        return None


@dataclass
class Lexicon:
    terms: tuple[str, ...] = ()
    clean: frozenset[str] = frozenset()
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.trie = Trie(self.terms)
        self.memo: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """2: a term; 1: a misspelled term; 0: neither."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            found = 2 if word in self.trie.whole else 1 if word not in self.clean and self.trie.near(word) else 0
            self.memo[word] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        low = (text or "").lower()
        words = WORD.findall(low)
        kinds = np.array(list(map(self.kind, words)))
        marked = [(m.start(), kind) for m in MARKED.finditer(low) if (kind := self.kind(m.group()))]
        if not marked and not kinds.any():
            return np.zeros(8)
        places = np.array([m.start() for m in WORD.finditer(low)])
        for start, kind in marked:
            k = np.searchsorted(places, start)
            kinds[k] = max(kinds[k], kind)
        at = np.flatnonzero(kinds)
        kind, places = kinds[at], places[at]
        marks = np.array([m.start() for m in QUOTES.finditer(low)])
        before = np.searchsorted(marks, places)
        quoted = (before % 2 == 1) & (before < len(marks))
        near = np.searchsorted(at, at + NEAR, "right") - np.searchsorted(at, at - NEAR) - 1
        plain, fuzzy = (kind == 2) & ~quoted, (kind == 1) & ~quoted
        return np.array([
            1.0, np.log1p(plain.sum()), np.log1p(fuzzy.sum()), np.log1p(quoted.sum()),
            np.log1p(near[plain].max(initial=0)), float(plain.any()), 20 * plain.sum() / (20 + len(words)), float(len({words[i] for i in at[kind == 2]}) > 1),
        ])

    def score(self, texts) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        x = np.stack([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -30, 30)))


def _sketch(texts: pd.Series) -> pd.Series:
    """The least hash of a text's runs of five words: near copies mostly share it."""
    found = []
    for text in texts:
        words = (text or "").lower().encode().split()
        runs = zip(*(words[k:] for k in range(5)), strict=False) if len(words) > 5 else [words]
        found.append(min(zlib.crc32(b" ".join(r)) for r in runs))
    return pd.Series(found)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            low = (text or "").lower()
            words = sorted({*WORD.findall(low), *MARKED.findall(low)})
            yield pd.DataFrame({"word": np.array(words, object), "label": label})


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant first) of a ridge logistic model, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame) -> Lexicon:
    """From (text, label, share). Words are counted in Spark; the terms and 8 figures a labelled row come to the driver, bounded by the labelled rows."""
    alike = Window.partitionBy("sketch").orderBy(F.desc("label"), "doc_id")
    single = labelled.withColumn("sketch", F.pandas_udf(_sketch, "long")(F.col("text"))).withColumn("n", F.row_number().over(alike)).where("n = 1")
    single = materialize(single.select("text", "label"), "labelled")  # 2 * LABELLED rows at most
    sizes = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Lexicon()
    counts = single.mapInPandas(_words, "word string, label int").groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    counts = materialize(counts, "word_counts")
    odds = (F.col("toxic") + 0.1) / sizes[1] / ((F.col("all") - F.col("toxic") + 0.1) / sizes[0])
    common = counts.where((F.col("toxic") >= max(2, round(sizes[1] ** 0.5 / 4))) & (F.length("word") >= 3) & (odds >= ODDS))
    terms = tuple(r.word for r in common.orderBy("word").collect())

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(terms)
        for batch in batches:
            yield pd.DataFrame({"word": [w for w in batch["word"] if trie.near(w) is not None]}, dtype=object)

    others = counts.where((F.col("all") > F.col("toxic")) & (odds < 3)).select("word")
    clean = frozenset(r.word for r in others.mapInPandas(near, "word string").collect())
    first = Lexicon(terms, clean)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "share": batch["share"], "x": [first.features(t).tolist() for t in batch["text"]]})

    rows = labelled.select("text", "label", "share").mapInPandas(features, "label int, share double, x array<double>").toPandas()
    x = np.stack(rows["x"])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights = _logistic((x - mean) / scale, rows["label"].to_numpy(float), rows["share"].to_numpy())
    return Lexicon(terms, clean, mean, scale, weights)


def scorer(docs: DataFrame, labels: DataFrame) -> Column:
    """A column function of ``text``: the score of each text, by what ``labels`` (doc_id, toxic) teach about ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, "toxic", LABELLED)))

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts.tolist()) if len(texts) else np.zeros(0))

    return score(F.col("text"))
