"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquery.storage import new_path as new_table_path

__all__ = ["BLANKS", "NON_WORD", "fold_ascii", "materialize", "new_table_path", "partitions", "words_by"]

#: Upper and lower case of the only letters that the text contracts fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    What follows reads whole files again after an executor is lost, and recomputes nothing.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(text, UPPER, LOWER)


def words_by(text: Column, separators: str) -> Column:
    """The non-empty pieces of ``text`` between runs of ``separators`` (a regex class body)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


#: Separators of the contracts' two kinds of words, as regex class bodies.
BLANKS = r"\x20\x09-\x0D"
NON_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
