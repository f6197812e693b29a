"""Flow files: a JSON object a line, plain or compressed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, value) of every line; .gz and .bz2 are read as such."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value")


def read_lines_by_magic(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, value) of every line, compressed or not whatever the files' names; a file goes to one task."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bz2
        import gzip
        import io

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = io.BytesIO(content)
                stream = gzip.open(raw) if content[:2] == b"\x1f\x8b" else bz2.open(raw) if content[:3] == b"BZh" else raw
                while lines := stream.readlines(1 << 20):
                    yield pd.DataFrame({"file": path, "value": [x.decode("utf-8", "replace").rstrip("\r\n") for x in lines]})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(unpack, "file string, value string")


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """The records of ``lines`` as VARIANT ``record``: configuration lines (with a ``version``) and lines that are no JSON object go."""
    parsed = lines.withColumn("record", F.try_parse_json(value))
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    return parsed.where(is_object & F.try_variant_get("record", "$.version", "variant").isNull()).drop(value)


def read_typed(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of flow files as typed columns, by what all lines hold; configuration lines and lines that are no JSON object go."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(list(paths))
    return rows.where(F.col("version").isNull()).drop("version") if "version" in rows.columns else rows


def bad_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(lines, bad): how many lines there are, and how many are no JSON."""
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.try_parse_json(value).isNull()).alias("bad"))
