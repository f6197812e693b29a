"""Ordinary tables seen as flows, packets and sessions, for queries on tables without captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def host(net: str, number: Column) -> Column:
    """Host ``number`` of a net of two octets; from 65,536 on the third part goes beyond 255, and the address is none of IPv4."""
    return F.concat(F.lit(f"{net}."), F.floor(number / 256), F.lit("."), number % 256)


def flows(spark: SparkSession, sf_dir: str, both_ways: bool = False) -> DataFrame:
    """An event as a flow record. ``both_ways``: every third runs in the other direction."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    inside = host("10.0", F.col("user_id"))
    outside = F.concat(F.lit("192.168.0."), k)
    kind = F.col("event_type")
    served = F.when(kind == "view", 80).when(kind == "purchase", 443).when(kind == "signup", 53).when(kind == "click", 22)
    own = F.when(kind != "error", 1024 + k)
    turned = (F.col("event_id") % 3 == 0) if both_ways else F.lit(False)
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(turned, outside).otherwise(inside).alias("sa"),
        F.when(turned, inside).otherwise(outside).alias("da"),
        F.when(turned, served).otherwise(own).alias("sp"),
        F.when(turned, own).otherwise(served).alias("dp"),
        F.when(kind == "error", 1).when(kind == "signup", 17).otherwise(6).alias("pr"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes_out"),
        (1 + F.col("event_id") % 7).alias("num_pkts_out"),
        micros("ts").alias("time_start"),
        (micros("ts") + F.floor(F.col("value") * 1_000_000).cast("long")).alias("time_end"),
    )


#: The same view in SQL, for oracles. ``{turned}``: a condition.
FLOWS_SQL = """
SELECT seq, CASE WHEN turned THEN o ELSE i END AS sa, CASE WHEN turned THEN i ELSE o END AS da,
  CASE WHEN turned THEN served ELSE own END AS sp, CASE WHEN turned THEN own ELSE served END AS dp, pr, bytes_out, num_pkts_out, time_start, time_end
FROM (
  SELECT event_id AS seq, {turned} AS turned, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS i, '192.168.0.' || k AS o,
    CASE WHEN event_type <> 'error' THEN 1024 + k END AS own,
    CASE event_type WHEN 'view' THEN 80 WHEN 'purchase' THEN 443 WHEN 'signup' THEN 53 WHEN 'click' THEN 22 END AS served,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS pr,
    CAST(floor(value * 100) AS BIGINT) AS bytes_out, 1 + event_id % 7 AS num_pkts_out,
    epoch_us(ts) AS time_start, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS time_end
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)
"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a flow with a nested packet list: a turn is a packet."""
    c = table(spark, sf_dir, "conversations")
    packet = F.struct("turn", F.char_length("text").alias("b"), F.when(F.col("role") == "user", ">").otherwise("<").alias("dir"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(packet)).alias("packets"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a nested ``tcp`` object, which only TCP flows have."""
    f = flows(spark, sf_dir)
    out = F.struct(F.col("sp").alias("port"), (F.col("seq") % 64).cast("int").alias("flags"))
    tcp = F.when(F.col("pr") == 6, F.struct(F.col("seq").alias("first_seq"), out.alias("out")))
    return f.withColumn("tcp", tcp)
