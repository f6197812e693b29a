"""Bounded samples of labelled rows, and the split that keeps the rest for tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether no label of this document may be learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int) -> DataFrame:
    """(doc_id, text, label, share) of ``each`` rows of either label at most, none of them held out.

    ``share``: labelled rows of this label for each one sampled. The choice follows a hash of the id.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).withColumn("share", F.lit(n / min(n, each))) for k, n in counts.items()]
    if not parts:
        return docs.limit(0).select("doc_id", "text", F.lit(0).alias("label"), F.lit(1.0).alias("share"))
    chosen = reduce(DataFrame.union, parts)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * each rows at most
