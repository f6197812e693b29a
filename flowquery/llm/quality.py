"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, the shapes of its words ("Aa", "a,", "A!!"), pairs of adjacent
shapes, and how much it repeats words and lines. Terms that two labelled rows hold are weighted by the root of their
share in the text and their rarity, and a truncated singular value decomposition of ``LABELLED`` labelled rows of
either label at most turns them into vectors of ``RANK`` numbers. These labelled vectors and the terms' projections (bounded
by the labelled rows, whatever the corpus) are broadcast; each batch of documents is multiplied with all vectors, and
a document's score is the share of label 1 among its ``NEIGHBOURS`` nearest, each weighted by its cosine to the power
``SHARPNESS`` and by how many labelled rows it stands for.

Texts are read whole, in one pass without a shuffle.

Defined results: a null text counts as empty; a text without known terms, as an empty one, scores the labelled rows' share of
label 1, or 0.5 without labelled rows; of equally near labelled rows at the last place the first vote, in the order of
label, terms and shares; repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowquery.llm.common import materialize
from flowquery.llm.labelled import sample

LABELLED = 2_048
RANK = 48
NEIGHBOURS, SHARPNESS = 15, 4
SEED = 3
#: Columns of a product over all terms that are made at once.
BLOCK = 32

#: Bytes as letters (also all beyond ASCII), capitals, digits, blanks, line ends or themselves.
SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else 32 if b in (9, 11, 12, 13) else b for b in range(256)
)


def shapes(text: bytes) -> list[bytes]:
    """The words' shapes: runs of letters, capitals or digits count once."""
    s = text.translate(SHAPES)
    for c in (b"a", b"A", b"9"):
        for k in (32, 8, 3, 2):
            s = s.replace(c * k, c)
        while c * 2 in s:
            s = s.replace(c * 2, c)
    return s.split()


def counted(text: bytes) -> tuple[int, list[Counter], dict[str, float]]:
    """The number of words, how often each word, shape and pair of shapes occurs, and by what share words, lines and runs of them are repeated."""
    words = text.split()
    n = len(words)
    counts = Counter(words)
    form = shapes(text)
    lines = text.split(b"\n")
    repeated = {
        "words": 1 - len(counts) / n,
        "runs": sum(map(eq, words, words[1:])) / n,
        "top": max(counts.values()) / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "trigrams": 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
    }
    return n, [counts, Counter(form), Counter(pairwise(form))], repeated


def terms(text: bytes | None) -> dict[tuple, float]:
    """Each term (kind, value) and its share in ``text``; shares of a kind sum to 1."""
    if not (text or b"").split():
        return {}
    n, kinds, repeated = counted(text)
    return {(kind, t): c / n for kind, counts in enumerate(kinds) for t, c in counts.items()} | {(len(kinds), bin_of(k, v)): 0.1 for k, v in repeated.items()}


def bin_of(name: str, share: float) -> bytes:
    return f"{name}:{min(9, int(10 * share))}".encode()


@dataclass
class Neighbours:
    """What is broadcast: the terms in order (as ``_named``) with their projections, and the labelled vectors."""

    terms: pa.BinaryArray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    @cached_property
    def index(self) -> list[dict]:
        """The terms' numbers, a dictionary for each kind. It is made where texts are scored: the driver never holds it."""
        found: list[dict] = [{}, {}, {}, {}]
        for i, t in enumerate(self.terms.to_pylist()):
            kind, value = int(t[:1]), t[2:]
            found[kind][tuple(value.split(b" ")) if kind == 2 else value] = i
        return found

    @property
    def prior(self) -> float:
        return float(self.labels @ self.weights / self.weights.sum()) if len(self.labels) else 0.5

    def vector(self, text: bytes | None) -> np.ndarray:
        """As the sum over ``terms``, without a look at those that are not known."""
        if not (text or b"").split():
            return np.zeros(self.project.shape[1])
        n, kinds, repeated = counted(text)
        at, count = [], []
        for numbers, counts in zip(self.index, kinds, strict=False):
            known = counts.keys() & numbers.keys() if len(counts) > len(numbers) else [t for t in counts if t in numbers]
            at += [numbers[t] for t in known]
            count += [counts[t] for t in known]
        share = np.array(count, float) / n
        bins = [self.index[-1][b] for k, v in repeated.items() if (b := bin_of(k, v)) in self.index[-1]]
        order = np.array(at + bins, np.int64)
        return np.sqrt(np.concatenate([share, np.full(len(bins), 0.1)])).astype(np.float32) @ self.project[order]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        x = np.stack([self.vector(t) for t in texts])
        length = np.linalg.norm(x, axis=1)
        near = (x / np.maximum(length, 1e-12)[:, None]) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, -k, axis=1)[:, -k][:, None]
        tied = near == least
        chosen = near > least
        chosen |= tied & (np.cumsum(tied, axis=1) <= k - chosen.sum(axis=1)[:, None])  # the first of equally near ones
        top = np.nonzero(chosen)[1].reshape(-1, k)
        votes = np.maximum(np.take_along_axis(near, top, 1), 0) ** SHARPNESS * self.weights[top]
        total = votes.sum(axis=1)
        score = np.where(total > 0, (votes * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-300), self.prior)
        return np.clip(np.where(length > 0, score, self.prior), 0, 1)


def _named(term: tuple) -> bytes:
    """A term as bytes: its kind, and its value, of a pair both with a blank between."""
    kind, value = term
    return b"%d:" % kind + (b" ".join(value) if isinstance(value, tuple) else value)


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [terms(t) for t in batch["text"]]
        yield pd.DataFrame({"label": batch["label"], "share": batch["share"], "terms": [list(map(_named, f)) for f in found], "shares": [list(f.values()) for f in found]})


def _coded(batches: Iterator[pd.DataFrame], known_terms: pa.BinaryArray) -> Iterator[pd.DataFrame]:
    """Each row's known terms as packed numbers, rising, and their shares."""
    numbers = {t: i for i, t in enumerate(known_terms.to_pylist())}
    for batch in batches:
        at, shares = [], []
        for terms_, values in zip(batch["terms"], batch["shares"], strict=True):
            known = sorted((numbers[t], v) for t, v in zip(map(bytes, terms_), values, strict=True) if bytes(t) in numbers)
            at.append(np.array([i for i, _ in known], "<i4").tobytes())
            shares.append(np.array([v for _, v in known], "<f8").tobytes())
        yield pd.DataFrame({"label": batch["label"], "share": batch["share"], "at": at, "shares": shares})


def fit(labelled: DataFrame) -> Neighbours:
    """From (text, label, share). Terms are counted in Spark; those that two rows hold, and 2 * LABELLED rows at most of packed numbers, come to the driver.

    There terms and rows stay Arrow buffers, and products over all terms are made ``BLOCK`` columns at a time; only the projections are whole.
    """
    rows = labelled.select(F.col("text").cast("binary").alias("text"), "label", "share").mapInPandas(_terms, "label int, share double, terms array<binary>, shares array<double>")
    rows = materialize(rows, "labelled_terms")
    common = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    found = common.toArrow().sort_by("term")
    known, held_by = whole(found["term"]), found["n"].to_numpy()
    shared = labelled.sparkSession.sparkContext.broadcast(known)
    packed = rows.mapInPandas(lambda batches: _coded(batches, shared.value), "label int, share double, at binary, shares binary").toArrow()
    shared.destroy()
    packed = packed.sort_by([(c, "ascending") for c in ("label", "at", "shares", "share")])
    rarity = np.log(1 + len(packed) / held_by).astype(np.float32)
    labels, weights = packed["label"].to_numpy().astype(float), packed["share"].to_numpy()
    x = Sparse(cells(packed["at"], "<i4"), cells(packed["shares"], "<f8"), rarity)
    # A randomised range finder on the side of the rows, then the small decomposition.
    basis = np.random.default_rng(SEED).standard_normal((len(packed), min(RANK + 16, len(packed)))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.squared_times(basis))
    values, turned = np.linalg.eigh((basis.T @ x.squared_times(basis)).astype(float))
    best = np.argsort(-values)[:RANK]
    project = x.transposed_times(basis @ (turned[:, best] / np.sqrt(np.maximum(values[best], 1e-12))).astype(np.float32))
    vectors = x.times(project).astype(float)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    project *= rarity[:, None]
    return Neighbours(known, project, vectors, labels, weights)


def whole(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def cells(column: pa.ChunkedArray, kind: str) -> Iterator[np.ndarray]:
    """Each row's packed numbers."""
    return (np.frombuffer(x.as_buffer(), kind) for x in column)


class Sparse:
    """The labelled rows' terms: roots of shares times rarity."""

    def __init__(self, terms_: Iterable[np.ndarray], shares: Iterable[np.ndarray], rarity: np.ndarray):
        self.width = len(rarity)
        self.rows = [(at, (np.sqrt(v) * rarity[at]).astype(np.float32)) for at, v in zip(terms_, shares, strict=True)]

    def times(self, y: np.ndarray) -> np.ndarray:
        return np.stack([v @ y[at] for at, v in self.rows]) if self.rows else np.zeros((0, y.shape[1]), np.float32)

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, y.shape[1]), np.float32)
        for (at, v), own in zip(self.rows, y, strict=True):
            out[at] += v[:, None] * own  # a row holds each term once
        return out

    def squared_times(self, y: np.ndarray) -> np.ndarray:
        """The product of these rows, their transpose and ``y``, BLOCK columns of ``y`` at a time."""
        blocks = [self.times(self.transposed_times(y[:, at : at + BLOCK])) for at in range(0, y.shape[1], BLOCK)]
        return np.hstack(blocks) if blocks else np.zeros(y.shape, np.float32)


def scorer(docs: DataFrame, labels: DataFrame) -> Column:
    """A column function of ``text``: the score of each text, by what ``labels`` (doc_id, quality) teach about ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, "quality", LABELLED)))

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        parts = [model.value.scores(texts.iloc[at : at + 512].tolist()) for at in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col("text").cast("binary"))
