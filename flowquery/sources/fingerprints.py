"""Fingerprint databases as files: a JSON object a line, with the fingerprint, its processes and their shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "str_repr string, total_count long, process_info array<struct<process:string,count:long,prevalence:double>>"


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(str_repr, total_count, process_info, line) of the entries; lines that are none go. ``line``: their order, for ``duplicates``."""
    rows = spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(list(paths))
    return rows.where("str_repr IS NOT NULL").withColumn("line", F.monotonically_increasing_id())


def duplicates(database: DataFrame) -> DataFrame:
    """(str_repr, n): fingerprints that stand more than once; of these a match takes the last."""
    return database.groupBy("str_repr").agg(F.count("*").alias("n")).where("n > 1")


def entries(rows: DataFrame, fingerprint: str, process: str) -> DataFrame:
    """The database of observed (fingerprint, process) rows: processes by falling count, then by name, with their shares."""
    counted = rows.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("str_repr"), F.coalesce(process, F.lit("Unknown")).alias("process")).agg(F.count("*").alias("count"))
    total = counted.groupBy("str_repr").agg(F.sum("count").alias("total_count"), F.collect_list(F.struct((-F.col("count")).alias("less"), "process", "count")).alias("p"))
    made = lambda x: F.struct(x["process"].alias("process"), x["count"].alias("count"), F.round(x["count"] / F.col("total_count"), 2).alias("prevalence"))
    return total.select("str_repr", "total_count", F.transform(F.array_sort("p"), made).alias("process_info"))


def write(database: DataFrame, path: str) -> None:
    """The entries in order, as files that ``read`` takes; on the way they are sorted by ranges, not in one task."""
    database.select("str_repr", "total_count", "process_info").orderBy("str_repr").write.json(path, compression="gzip")


def report(flows: DataFrame, fingerprint: str, database: DataFrame) -> DataFrame:
    """(fingerprint, flows, process, prevalence): each fingerprint that was seen, how often, and the process that most often has it."""
    last = database.groupBy("str_repr").agg(F.max_by("process_info", "line").alias("p")) if "line" in database.columns else database.select("str_repr", F.col("process_info").alias("p"))
    seen = flows.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("str_repr")).agg(F.count("*").alias("flows"))
    found = seen.join(last, "str_repr", "left")
    return found.select(F.col("str_repr").alias("fingerprint"), "flows", F.coalesce(F.try_element_at("p", F.lit(1))["process"], F.lit("Unknown")).alias("process"), F.try_element_at("p", F.lit(1))["prevalence"].alias("prevalence"))


def captured(records: DataFrame, feature: str = "fpx") -> DataFrame:
    """A row for each side of a record that ``feature`` (a struct of out, in) has a fingerprint of: source_addr, dest_addr, source_port, dest_port, protocol, timestamp (of the record's start, in UTC), fingerprint.

    The source is the side that sent it. Records with none give no row.
    """

    def side(name: str, *ends: str) -> Column:
        named = zip(("source_addr", "dest_addr", "source_port", "dest_port"), ends, strict=True)
        return F.struct(*(F.col(c).alias(n) for n, c in named), F.col(f"{feature}.{name}").alias("fingerprint"))

    both = records.select(F.explode(F.array(side("out", "sa", "da", "sp", "dp"), side("in", "da", "sa", "dp", "sp"))).alias("_s"), "pr", "time_start").where("_s.fingerprint IS NOT NULL")
    protocol = F.when(F.col("pr") == 6, "TCP").when(F.col("pr") == 17, "UDP").otherwise(F.col("pr").cast("string"))
    at = F.date_format(F.to_utc_timestamp(F.timestamp_micros("time_start"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return both.select("_s.source_addr", "_s.dest_addr", "_s.source_port", "_s.dest_port", protocol.alias("protocol"), at.alias("timestamp"), "_s.fingerprint")


def lookup(fingerprint: str, database: DataFrame) -> DataFrame:
    """The entry of one fingerprint; the filter reaches the files."""
    return database.where(F.col("str_repr") == fingerprint)
