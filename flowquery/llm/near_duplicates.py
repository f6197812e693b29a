"""SimHash near-duplicates: pigeonring filtering, then connected components.

``fingerprints`` gives each text its 64-bit SimHash over 3-word shingles. ``links`` finds all pairs of
distinct fingerprints that differ in ``TAU`` = 3 bits at most. Cut into m = 4 boxes of 16 bits set in
a ring, such a pair has a box from which every chain of l consecutive boxes differs in l * TAU / m
bits at most: 0, 1, 2 and 3 bits for l = 1 to 4 (the pigeonring principle). So a pair agrees in
some box, and in all but one bit at most of the next: each fingerprint is filed under its 4 boxes
and the 16 ways to ignore a bit of the next box, 64 keys of 31 bits, and only fingerprints that share a
key are compared, by the longer chains first and in full last. The number of keys is fixed, and
unrelated fingerprints share one with a chance of 64 / 2^31, so candidates stay few with
thousands of millions of fingerprints.

Equal fingerprints are one class throughout: a group of copies, however large, is one row before it is
compared. ``components`` then joins linked classes by large-star and small-star steps, each of them
a shuffle of at most the links, until only stars are left; every step is cut off by a table in the shared folder.

Defined results: a null text counts as empty, and all texts without words have fingerprint zero; rows
with a null ``doc_id`` get their fingerprint and the component of their class, but name none (null if
no row of the component has an id); repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquery.llm.common import materialize

SHINGLE, SEED, TAU = 3, 42, 3
BOXES, BITS = 4, 16


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 ``text``: a bit is set if it is in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: folds A-Z and splits at ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    k = min(shingle, len(words))
    hashes = [xxh64_intdigest(joined[b : e - 1], SEED) for b, e in zip([0, *ends], ends[k - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [simhash(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(values, pa.int64())], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp) of every row; ``digest``: a hash of the whole text, which tells rows of one id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, digest long, fp long")


def ring(fp: Column, box: Column) -> Column:
    """``fp`` turned so that ``box`` comes first (in its lowest bits)."""
    by = box * BITS
    return F.call_function("shiftrightunsigned", fp, by).bitwiseOR(F.call_function("shiftleft", fp, F.lit(64) - by))


def chain_holds(differ: Column, length: int) -> Column:
    """Whether the first ``length`` boxes of ``differ`` have no more bits than their share."""
    mask = (1 << (BITS * length)) - 1 if length < BOXES else -1
    return F.bit_count(differ.bitwiseAND(F.lit(mask).cast("long"))) <= length * TAU // BOXES


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct ``fp`` that differ in TAU bits at most, each once."""
    filed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BOXES * BITS - 1))).alias("way"))
    filed = filed.select("fp", "way", ring(F.col("fp"), F.expr(f"way div {BITS}").cast("int")).alias("turned"))
    ignored = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("way") % BITS + BITS)
    low = F.col("turned").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).bitwiseAND(F.bitwise_not(ignored))
    filed = filed.select("fp", F.shiftleft(F.col("way").cast("long"), 2 * BITS).bitwiseOR(low).alias("key"))
    a, b = filed.select("key", F.col("fp").alias("a")), filed.select("key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    way = F.shiftrightunsigned("key", 2 * BITS).cast("int")
    box = F.expr(f"shiftrightunsigned(key, {2 * BITS}) div {BITS}").cast("int")

    def viable(first: Column) -> Column:
        turned = ring(differ, first)
        return chain_holds(turned, 1) & chain_holds(turned, 2) & chain_holds(turned, 3)

    # A pair is taken at its first viable box only, and where the next box agrees in full, under the first ignored bit only.
    second = F.call_function("shiftrightunsigned", ring(differ, box), F.lit(BITS)).bitwiseAND(F.lit((1 << BITS) - 1))
    once = (second != 0) | (way % BITS == 0)
    for k in range(BOXES - 1):
        once = once & ((box <= k) | ~viable(F.lit(k)))
    # 64 rows a fingerprint, which Spark's estimate of an explode does not count: without the hint it may broadcast them.
    return a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= TAU) & viable(box) & once).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps. Minima are taken map-side before they are shuffled.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "small_star")
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(after.select("v", F.lit(0), F.lit(1)))
        stars = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
        if stars.where("ups > 1 or (ups > 0 and downs > 0)").isEmpty():  # every node points at a root
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select("v", "v").distinct())
        edges = after


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp, component_id, n_links) of every row; ``n_links``: other fingerprints within TAU bits."""
    marked = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    pairs = materialize(links(classes.select("fp")), "links")
    number = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = materialize(components(pairs), "components").select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp").join(number, "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(least, "root").select("fp", "component_id", "n_links")
    single = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # As a table, so that both sides of the join are plain exchanges and Spark can split a large class.
    return marked.join(materialize(single, "rooted"), "fp").select("doc_id", "digest", "fp", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates of a row with a smaller id.

    Of rows with one id and one text, one stays. Rows with a null ``doc_id`` stay.
    """
    found = near_duplicates(docs).where(F.col("doc_id").isNotNull())
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    marked = docs.withColumn("__text", F.xxhash64("text"))
    kept = marked.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__digest")), "left_semi")
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.lit(0)))).where("__n = 1")
    return kept.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
