"""Labelled folders of flow files, for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquery.sources import jsonl


def read(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """(file, record, label) of the flows of both folders; lines that are no flows go."""
    parts = [jsonl.parse(jsonl.read_lines(spark, path)).withColumn("label", F.lit(label)) for path, label in ((positive, 1.0), (negative, 0.0))]
    return parts[0].unionByName(parts[1])
