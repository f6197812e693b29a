"""Names of codes from dimension tables; a code that the table lacks stands for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_names(spark: SparkSession, *paths: str) -> DataFrame:
    """(code, name) from lines of a code, white space and a name; lines without a name, and what follows ``#``, are left out. Of lines with one code the least name counts."""
    lines = spark.read.text(list(paths)).select(F.trim(F.regexp_replace(F.regexp_replace("value", "#.*", ""), r"\s+", " ")).alias("line"))
    parts = F.split("line", " ", 2)
    return lines.where(F.size(parts) == 2).select(parts[0].alias("code"), parts[1].alias("name")).groupBy("code").agg(F.min("name").alias("name"))


def _single(names: DataFrame) -> DataFrame:
    return names.where("code IS NOT NULL").select(F.col("code").cast("string").alias("_code"), F.col("name").alias("_name")).groupBy("_code").agg(F.min("_name").alias("_name"))


def named(rows: DataFrame, code: Column, names: DataFrame, into: str = "name") -> DataFrame:
    """``rows`` with ``into``: the name of a code by ``names`` (code, name), else the code as text; null for a null code. A lookup such as that of protocol numbers."""
    asked = rows.withColumn("_asked", code.cast("string"))
    return asked.join(_single(names), F.col("_asked") == F.col("_code"), "left").withColumn(into, F.coalesce("_name", "_asked")).drop("_asked", "_code", "_name")


def named_lists(rows: DataFrame, codes: str, names: DataFrame, into: str = "names") -> DataFrame:
    """``rows`` with ``into``: the names of an array of codes, in its order; codes without a name and nulls stay, null and empty arrays, too.

    Flows repeat few lists, so each distinct list is named once, and its names are joined to the rows that have it.
    """
    lists = rows.select(F.col(codes).cast("array<string>").alias("_list")).where(F.size("_list") > 0).distinct()
    items = lists.select("_list", F.posexplode("_list").alias("_at", "_asked"))
    found = items.join(_single(names), F.col("_asked") == F.col("_code"), "left").groupBy("_list")
    told = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_name", "_asked").alias("_n")))), lambda x: x["_n"]).alias("_names"))
    own = F.col(codes).cast("array<string>")
    return rows.join(told, own == F.col("_list"), "left").withColumn(into, F.coalesce("_names", own)).drop("_list", "_names")
