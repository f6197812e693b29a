"""Flow files: a JSON object a line, after a line with the configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, pretty: bool = False) -> DataFrame:
    """``value``: each row as a JSON object; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"} if pretty else {}).alias("value"))


def write(df: DataFrame, path: str, compression: str = "gzip", most_records: int | None = None, mode: str = "errorifexists", change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One file a task, a new one after ``most_records``. ``change``: of the lines before they are written, as ``anonymous.rewrite``."""
    out = lines(df)
    writer = (change(out) if change else out).write.mode(mode).option("compression", compression)
    (writer.option("maxRecordsPerFile", most_records) if most_records else writer).text(path)


def with_config(df: DataFrame, **config) -> DataFrame:
    """The lines of ``df`` after its configuration line, which readers skip."""
    head = df.sparkSession.range(1).select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in {"version": "1", **config}.items()))).alias("value"))
    return head.union(lines(df))
