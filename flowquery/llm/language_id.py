"""Language identification: words first, ever shorter character n-grams where a word is unknown.

A model holds how often each language's labelled texts have a word, and each n-gram (of ``GRAM`` to 1 characters, ends of words included).
A known word adds the logarithm of its share in each language; a language without it adds one common floor. An unknown word is
spelt in the longest n-grams that any language knows and adds the mean of their logarithms. The language with the largest sum
(with the logarithm of its share of labelled texts) is predicted; the score is its share of the sum of all languages' likelihoods.

What is learnt comes from ``LABELLED`` labelled texts of each language or somewhat more, chosen by a hash of id and text, equal ones counted once. Counting is
Spark's. The words and n-grams that come to the driver and are broadcast are the most frequent ones: ``WORDS`` and ``GRAMS`` of all languages together (for
each length of n-gram) at most, of the ``LANGUAGES`` most frequent languages; what is rarer counts as unknown. Texts are read whole, in one pass without a shuffle.

Defined results: words are runs of letters and the marks on them, in lower case; a null text, and one without a letter, is ``und`` with score 0, and so is any text if no
language was learnt; of equally likely languages the one first in order is taken; rows with a null id or language teach nothing; repeated
rows each give their row; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LABELLED = 4_000
LANGUAGES = 256
WORDS, GRAMS = 400_000, 100_000
GRAM = 5
UNKNOWN = "und"
#: What a language without a word is taken to hold of it, as a share of one occurrence in the largest sample.
UNSEEN = 0.5
#: Unknown words whose sums a worker remembers.
REMEMBERED = 200_000

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Logarithms of shares, a row a word or n-gram and a column a language."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: list[dict[str, int]]  # of 1 to GRAM characters
    gram_logs: list[np.ndarray]
    unknown: dict[str, int] = field(default_factory=dict)
    unknown_logs: list[np.ndarray] = field(default_factory=list)

    def backed_off(self, word: str) -> np.ndarray:
        for n in range(len(self.grams), 0, -1):
            at = [k for g in grams(word, n) if (k := self.grams[n - 1].get(g)) is not None]
            if at:
                return self.gram_logs[n - 1][at].mean(axis=0)
        return np.zeros(len(self.languages))

    def _number(self, word: str) -> int:
        """The row of an unknown word, behind those of the known ones."""
        if word not in self.unknown:
            self.unknown[word] = len(self.words) + len(self.unknown_logs)
            self.unknown_logs.append(self.backed_off(word))
        return self.unknown[word]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if len(self.unknown) > REMEMBERED:
            self.unknown, self.unknown_logs = {}, []
        held = [words(t) for t in texts]
        sizes = np.array([len(w) for w in held], np.int64)
        if not self.languages or not sizes.sum():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = self.words
        at = np.array([k if (k := known.get(w)) is not None else self._number(w) for some in held for w in some], np.int64)
        logs = np.concatenate([self.word_logs, *[np.array(self.unknown_logs)] * bool(self.unknown_logs)])[at]
        upto = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(logs, axis=0)])
        ends = np.cumsum(sizes)
        sums = self.prior + upto[ends] - upto[ends - sizes]
        best = sums.argmax(axis=1)
        likelihoods = np.exp(sums - sums.max(axis=1, keepdims=True))
        scores = np.where(sizes > 0, 1 / likelihoods.sum(axis=1), 0.0)
        return [self.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), sizes.tolist(), strict=True)], scores


def held_out(doc_id: Column) -> Column:
    """Whether nothing may be learnt from this document: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """How many rows each language has to learn from, and (lang, text) of about LABELLED distinct ones of each; docs: doc_id, text, lang."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, LABELLED / n)) for k, n in sorted(counts.items())], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.withColumn("place", place).join(F.broadcast(shares), "lang").where("place < share")
    return counts, chosen.groupBy("lang", F.xxhash64("text").alias("digest"), F.sha1("text").alias("check")).agg(F.first("text").alias("text")).select("lang", "text")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.update((lang, w) for w in words(text))
        yield pd.DataFrame([(lang, w, n) for (lang, w), n in counts.items()], columns=["lang", "term", "n"])


def most(counts: DataFrame, group: str, limit: int) -> DataFrame:
    """The rows with the largest ``n`` of each value of ``group``, ``limit`` at most; equal ones stay or go together.

    Only how often each count occurs is collected: their distinct values are few, as they sum to what was counted.
    """
    held: dict[object, list] = {}
    for r in counts.groupBy(group, "n").agg(F.count("*").alias("rows")).collect():
        held.setdefault(r[group], []).append((r["n"], r["rows"]))
    least = []
    for value, some in held.items():
        some = sorted(some, reverse=True)
        fits = np.cumsum([rows for _, rows in some]) <= limit
        least.append((value, some[int(fits.sum()) - 1][0] if fits.any() else some[0][0] + 1))
    bounds = counts.sparkSession.createDataFrame(least, f"{group} {counts.schema[group].dataType.simpleString()}, least long")
    return counts.join(F.broadcast(bounds), group).where("n >= least").drop("least")


def logs(rows: list[tuple[str, str, int]], languages: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """The number of each term, and the logarithms of its shares."""
    numbers = {t: k for k, t in enumerate(sorted({t for _, t, _ in rows}))}
    floor = np.log(UNSEEN / max(totals.values(), default=1))
    out = np.full((len(numbers), len(languages)), floor)
    column = {x: k for k, x in enumerate(languages)}
    for lang, term, n in rows:
        out[numbers[term], column[lang]] = np.log(n / totals[lang])
    return numbers, out


def spelt(word: str, n: int) -> Column:
    """``grams`` of a column; null if there are none."""
    padded = F.concat(F.lit(" "), F.col(word), F.lit(" "))
    places = F.sequence(F.lit(1), F.char_length(padded) - (n - 1))
    return F.when(F.char_length(padded) >= n, F.transform(places, lambda i: F.substr(padded, i, F.lit(n))))


def fit(docs: DataFrame) -> Model:
    """From the labelled rows of ``docs`` (doc_id, text, lang) that are not held out."""
    counts, chosen = sampled(docs)
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), [], [])
    counted = chosen.mapInPandas(_counted, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    def brought(frame: DataFrame, limit: int, totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
        table = most(frame, "lang", limit // len(languages)).toArrow()
        return logs(list(zip(*(table[c].to_pylist() for c in ("lang", "term", "n")), strict=True)), languages, totals)

    held = [brought(counted, WORDS, totals)]
    for n in range(1, GRAM + 1):
        summed = counted.select("lang", F.explode(spelt("term", n)).alias("term"), "n").groupBy("lang", "term").agg(F.sum("n").alias("n")).persist()
        held.append(brought(summed, GRAMS, {r["lang"]: r["n"] for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}))
        summed.unpersist()
    counted.unpersist()
    every = sum(counts.values())
    prior = np.log(np.array([counts[x] / every for x in languages]))
    return Model(languages, prior, *held[0], [numbers for numbers, _ in held[1:]], [values for _, values in held[1:]])


PREDICTED = "lang_pred string, score double"


def predictor(model: Model, spark) -> Column:
    """A column function of ``text``: (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(StructType.fromDDL(PREDICTED))
    def predicted(texts: pd.Series) -> pd.DataFrame:
        parts = [shared.value.predict(texts.iloc[at : at + 64].tolist()) for at in range(0, len(texts), 64)]
        return pd.DataFrame({"lang_pred": [x for some, _ in parts for x in some], "score": np.concatenate([s for _, s in parts]) if parts else np.zeros(0)})

    return predicted(F.col("text").cast("string"))


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs``' doc_id with held_out, lang_pred and score, learnt from ``labelled`` (doc_id, text, lang; ``docs`` if not given)."""
    model = fit(docs if labelled is None else labelled)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model, docs.sparkSession).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
