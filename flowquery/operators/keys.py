"""Flow keys: five-tuples, their reverses, and the key that both directions share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIVE = ("sa", "da", "sp", "dp", "pr")


def endpoint(address: str, port: str) -> Column:
    """Address and port; a missing port compares as -1."""
    return F.struct(F.col(address).alias("a"), F.coalesce(F.col(port), F.lit(-1)).alias("p"))


def canonical() -> Column:
    """One value for a five-tuple and its reverse."""
    a, b = endpoint("sa", "sp"), endpoint("da", "dp")
    return F.struct(F.col("pr").alias("pr"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def forward() -> Column:
    """Whether a row's source is the lower endpoint."""
    return endpoint("sa", "sp") <= endpoint("da", "dp")
