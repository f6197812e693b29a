"""Subnet lists: an address or CIDR a line, a label after ``#``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, value: str = "value", label: str | None = None) -> DataFrame:
    """(cidr, label); blank lines and comments go. ``label``: for lines without one of their own."""
    cidr = F.regexp_extract(value, r"^\s*([0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:/[0-9]{1,2})?)", 1)
    own = F.trim(F.regexp_extract(value, r"#(.*)$", 1))
    return lines.select(cidr.alias("cidr"), F.coalesce(F.lit(label), own).alias("label")).where("cidr <> ''")


def read(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    return parse(spark.read.text(path), label=label)
