"""Approximate nearest neighbours by largest inner product: a forest of sorted hash strings.

Each of ``TREES`` trees gives a vector a string of ``LENGTH`` bits, the signs of its products with random
directions; a tree is the array of its strings in order. A query descends in each tree to the range
that shares its longest prefix and then ascends in all trees at once, a bit at a time, until the ranges
hold as many candidates as the forest asks for. All candidates are scored exactly.

``fit`` draws directions and looks at a sample of ``SAMPLE`` vectors at most: it cuts each tree into leaves
(ranges of strings with a common prefix, of about ``LEAF`` vectors, fewer bits where strings are dense), and measures
on the sample which share of the vectors the candidates must make up for a recall of ``TARGET``. Everything
else covers all rows: each vector is filed in every tree, each query goes to the leaves that its ranges
touch, a leaf scores its queries in blocks and returns the best of each, and the best of all trees
are merged. Which leaf a range touches follows from the sample's cuts, so no row is left out. Leaves are counted: where
one holds over ``BLOCK`` vectors or queries (equal strings cannot be cut), its vectors and its queries are dealt to blocks, and
every block of the one meets every block of the other in a task of its own, so no task grows with the table.

Rows repeated with id and vector are one. Copies of a vector are ranked by id and the K+1 smallest ids of each class
are filed, which is all that any K nearest can hold; equal queries are searched once. Vectors are filed as original minus mean, with one
coordinate more that gives all the same length, so the order of angles is that of inner products.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components take no part, nor do rows with a null ``vec_id``; a row is no candidate of a query with
its id; an id with several vectors counts by its best score, both as a query and as a candidate; fewer candidates give fewer rows; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquery.llm.common import materialize

K = 20
TREES, LENGTH = 32, 48
SAMPLE, TRIALS, TARGET = 16_384, 128, 0.95
LEAF = 8_192
BLOCK = 16_384
SEED = 7


@dataclass
class Forest:
    mean: np.ndarray
    reach: float  # the common length of filed vectors, at least
    planes: np.ndarray  # TREES x LENGTH x (dimension + 1)
    strings: list[np.ndarray]  # the sample's, in order, per tree
    cuts: list[np.ndarray]  # the first string of each leaf, per tree
    scale: float  # vectors for each of the sample
    wanted: float  # candidates (in all trees together) for each query
    blocks: list[np.ndarray] | None = None  # 2 x leaves, per tree: the blocks of vectors and of queries

    def hashes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """TREES x n strings, as numbers."""
        if query:
            filed = np.hstack([vectors, np.zeros((len(vectors), 1))])
        else:
            x = vectors - self.mean
            filed = np.hstack([x, np.sqrt(np.maximum(0, self.reach**2 - (x * x).sum(1)))[:, None]])
        weights = 1 << np.arange(LENGTH - 1, -1, -1, dtype=np.int64)
        return np.stack([(filed @ p.T > 0) @ weights for p in self.planes])

    def ranges(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TREES x n first and last strings of each query's ranges, at the level where all trees together hold enough."""
        level = np.zeros(hashes.shape[1], np.int64)
        for shift in range(LENGTH, -1, -1):  # from the whole array down to equal strings
            low = hashes >> shift << shift
            high = low + (1 << shift) - 1
            held = sum(np.searchsorted(s, h, "right") - np.searchsorted(s, lo) for s, lo, h in zip(self.strings, low, high, strict=True))
            level = np.where(held * self.scale >= self.wanted, LENGTH - shift, level)
        shift = LENGTH - level
        low = hashes >> shift << shift
        return low, low + (1 << shift) - 1

    def leaf(self, tree: int, strings: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts[tree], strings, "right") - 1


def _cuts(strings: np.ndarray, most: float) -> np.ndarray:
    """First strings of the leaves: prefixes are lengthened while over ``most`` of the sample share them."""
    found, todo = [], [(0, LENGTH)]
    while todo:
        low, shift = todo.pop()
        held = np.searchsorted(strings, low + (1 << shift)) - np.searchsorted(strings, low)
        if held <= most or not shift:
            found.append(low)
        else:
            todo += [(low, shift - 1), (low + (1 << (shift - 1)), shift - 1)]
    return np.array(sorted(found), np.int64)


def fit(sample: np.ndarray, count: int, longest: float, k: int = K) -> Forest:
    """A forest for ``count`` vectors of lengths up to ``longest``, from ``sample``."""
    rng = np.random.default_rng(SEED)
    mean = sample.mean(axis=0)
    planes = rng.standard_normal((TREES, LENGTH, sample.shape[1] + 1))
    forest = Forest(mean, longest + float(np.linalg.norm(mean)), planes, [], [], count / len(sample), 0.0)
    filed = forest.hashes(sample, query=False)
    forest.strings = list(np.sort(filed, axis=1))
    forest.cuts = [_cuts(s, max(1.0, LEAF / forest.scale)) for s in forest.strings]
    trial = sample[rng.permutation(len(sample))[:TRIALS]]
    scores = trial @ sample.T
    top = np.argsort(-scores, axis=1)[:, : min(k + 1, len(sample))]
    asked = forest.hashes(trial, query=True)
    for share in (*np.arange(0.02, 0.3, 0.02), *np.arange(0.3, 2, 0.1), float(TREES)):
        forest.wanted = max(share * count, 4.0 * k)
        low, high = forest.ranges(asked)
        found = ((filed[:, top] >= low[..., None]) & (filed[:, top] <= high[..., None])).any(axis=0)
        if found.mean() >= TARGET:
            break
    return forest


def _parts(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[tuple]:
    """(query, ids, vectors, their column, low, high) of the vectors and of the queries in each batch, with their strings."""
    for batch in batches:
        flags = np.array(batch.column("query").to_pylist(), bool)
        for query in (False, True):
            part = batch.filter(pa.array(flags == query))
            if not part.num_rows:
                continue
            column = part.column("vector")
            vectors = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
            strings = forest.hashes(vectors, query)
            yield query, part.column("id").to_numpy(), vectors, column, *(forest.ranges(strings) if query else (strings, strings))


COUNTED = "tree int, leaf int, query boolean, n long"


def _count(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """How many vectors and queries of the partition each leaf receives."""
    counts = [np.zeros((2, len(c) + 1), np.int64) for c in forest.cuts]
    for query, _, _, _, low, high in _parts(batches, forest):
        for tree, held in enumerate(counts):
            np.add.at(held[int(query)], forest.leaf(tree, low[tree]), 1)
            np.add.at(held[int(query)], forest.leaf(tree, high[tree]) + 1, -1)
    for tree, held in enumerate(counts):
        query, leaf = np.nonzero(np.cumsum(held, axis=1))
        n = np.cumsum(held, axis=1)[query, leaf]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), tree, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(query == 1), pa.array(n)], ["tree", "leaf", "query", "n"])


def _repeat(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as counted, and its number among its likes."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


FILED = "tree int, leaf int, block int, query boolean, id long, low long, high long, vector array<double>"


def _file(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """Each vector in its leaf of every tree, each query in the leaves of its ranges; of a leaf in blocks, in those it shares with the others' blocks."""
    for query, ids, vectors, column, low, high in _parts(batches, forest):
        # By id and vector: near copies, and an id with many vectors, are dealt evenly.
        odd = np.random.default_rng(SEED).integers(1 << 62, size=vectors.shape[1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        deal = ((np.ascontiguousarray(vectors + 0.0).view(np.uint64) * odd[:-1]).sum(axis=1) + ids.view(np.uint64) * odd[-1]) >> np.uint64(32)
        for tree in range(TREES):
            first, last = forest.leaf(tree, low[tree]), forest.leaf(tree, high[tree])
            rows, leaf = _repeat(last - first + 1)
            leaf = leaf + first[rows]
            own, others = forest.blocks[tree][int(query)][leaf], forest.blocks[tree][1 - int(query)][leaf]
            mine = (deal[rows] % own.astype(np.uint64)).astype(np.int64)
            again, theirs = _repeat(others)
            rows, leaf, mine = rows[again], leaf[again], mine[again]
            block = theirs * own[again] + mine if query else mine * others[again] + theirs
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), tree, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(rows), query)),
                 pa.array(ids[rows]), pa.array(low[tree][rows]), pa.array(high[tree][rows]), column.take(pa.array(rows))],
                ["tree", "leaf", "block", "query", "id", "low", "high", "vector"],
            )


def _search(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best ids in a leaf for each query there, among the strings of its range."""
    points = rows[~rows["query"]].sort_values(["low", "id"])
    queries = rows[rows["query"]]
    out = []
    if len(points) and len(queries):
        strings, ids = points["low"].to_numpy(), points["id"].to_numpy()
        vectors = np.stack(points["vector"])
        repeated = not points["id"].is_unique
        for (low, high), some in queries.groupby(["low", "high"]):
            b, e = np.searchsorted(strings, low), np.searchsorted(strings, high, "right")
            if b == e:
                continue
            if repeated:
                by_id = np.argsort(ids[b:e], kind="stable")
                starts = np.flatnonzero(np.diff(ids[b:e][by_id], prepend=ids[b:e][by_id[0]] - 1))
            for at in range(0, len(some), 256):
                asked = np.stack(some["vector"].iloc[at : at + 256])
                for q, own, near in zip(some["id"].iloc[at : at + 256], asked, asked @ vectors[b:e].T, strict=True):
                    top = np.maximum.reduceat(near[by_id], starts) if repeated else near  # the best of each id
                    least = np.partition(top, -k)[-k] - 1e-9 * max(1.0, np.abs(near).max()) if len(top) > k else -np.inf
                    kept = b + np.flatnonzero(near >= least)
                    scores = (vectors[kept] * own).sum(axis=1)  # the same for equal vectors, wherever they stand
                    best = np.lexsort((ids[kept], -scores))
                    if repeated:
                        best = best[np.sort(np.unique(ids[kept][best], return_index=True)[1])]
                    best = best[:k]
                    out.append(pd.DataFrame({"query": q, "vec_id": ids[kept][best], "score": scores[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, but for the length of vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).dropna()
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its k nearest found among ``vectors`` (both: vec_id, embedding).

    Without ``queries``, those of ``vectors`` whose id is divisible by 20.
    """
    spark = vectors.sparkSession
    asked = usable(vectors.where("vec_id % 20 = 0") if queries is None else queries)
    rows = usable(vectors)
    order = Window.partitionBy("vector").orderBy("vec_id")
    points = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select(F.lit(False).alias("query"), F.col("vec_id").alias("id"), "vector")
    points = materialize(points, "points")
    count = points.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], result)
    sample = [r.vector for r in points.sample(min(1.0, 1.2 * SAMPLE / count), seed=SEED).select("vector").limit(SAMPLE).collect()] or [points.first().vector]
    size = Counter(map(len, sample)).most_common(1)[0][0]
    points, asked = (x.where(F.size("vector") == size) for x in (points, asked))
    longest = points.agg(F.max(F.sqrt(F.reduce("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    forest = fit(np.array([v for v in sample if len(v) == size]), count, longest, k)
    # A class is known by a number of its own: an id may stand in several.
    classes = materialize(asked.select("vector").distinct().withColumn("id", F.monotonically_increasing_id()), "query_classes")
    both = points.unionByName(classes.select(F.lit(True).alias("query"), "id", "vector"))
    uncounted = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE, TREES and LENGTH
    counts = both.mapInArrow(lambda batches: _count(batches, uncounted.value), COUNTED).groupBy("tree", "leaf", "query").agg(F.sum("n").alias("n"))
    blocks = [np.ones((2, len(c)), np.int64) for c in forest.cuts]
    for r in counts.where(F.col("n") > BLOCK).collect():
        blocks[r.tree][int(r.query), r.leaf] = -(-r.n // BLOCK)
    shared = spark.sparkContext.broadcast(replace(forest, blocks=blocks))
    filed = both.mapInArrow(lambda batches: _file(batches, shared.value), FILED)
    found = filed.groupBy("tree", "leaf", "block").applyInPandas(lambda x: _search(x, k + 1), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)

    members = asked.join(classes, "vector").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"))
    own = members.distinct().join(found, "query").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
