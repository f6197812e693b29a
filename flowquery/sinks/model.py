"""Model parameters: the constant and then the weights, a number a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(spark: SparkSession, parameters: list[float], path: str) -> None:
    rows = spark.createDataFrame(list(enumerate(map(repr, parameters))), "n int, value string")
    rows.coalesce(1).sortWithinPartitions("n").select("value").write.text(path)


def read(spark: SparkSession, path: str) -> list[float]:
    """In the order of the lines of the one file."""
    rows = spark.read.text(path, wholetext=True).first()
    return [float(x) for x in (rows[0] if rows else "").split()]


def observed(df: DataFrame, name: str, bytes_column: str) -> DataFrame:
    """``df`` that reports, as it runs, its records and bytes to listeners of ``name``."""
    return df.observe(name, F.count(F.lit(1)).alias("records"), F.sum(bytes_column).alias("bytes"))
