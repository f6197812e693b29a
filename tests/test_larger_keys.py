"""Queries on tables whose values the given small ones lack, against their SQL."""

import os

import pyarrow.parquet as pq
import pytest
from flowquery.functions import scalar
from flowquery.plans.catalogue import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

from tests.compare import TABLES, compare


def beside(spark, sf_dir, folder, name, rows):
    """``folder`` with the tables of ``sf_dir``, of which ``name`` has other ``rows``."""
    for t in set(TABLES) - {name}:
        os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    pq.write_table(rows.toArrow(), folder / f"{name}.parquet")
    return str(folder)


def test_floats_are_multiplied_as_floats(spark, sf_dir, tmp_path):
    rows = spark.createDataFrame([(0, [0.29] * 64, 1), (1, [-0.57] * 64, 1)], "vec_id long, embedding array<float>, label int")
    folder = beside(spark, sf_dir, tmp_path, "embeddings", rows)
    compare(QUERIES["stitch_byte_dist"](spark, folder), ORACLE_SQL["stitch_byte_dist"], folder)


@pytest.mark.parametrize("name", ["ipv4_to_int", "anon_addr_aes", "deanon_addr_aes", "dns_answers_explode", "ipfix_round_trip"])
def test_hosts_beyond_two_octets(spark, sf_dir, tmp_path, name):
    """Of 90,000 users, whose view has a third part of up to 351."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = beside(spark, sf_dir, tmp_path, "events", events.withColumn("user_id", events.user_id + events.event_id % 60 * 1500))
    compare(QUERIES[name](spark, folder), ORACLE_SQL[name], folder)


def test_codes_of_hosts_lead_back(spark):
    hosts = ["10.0.0.1", "10.0.351.255", "010.0.0.1", "0.0.0.0", "", "fe80::1", "255.255.255.255"]
    key = F.encode(F.lit("0123456789abcdef"), "UTF-8")
    rows = spark.createDataFrame([(x,) for x in hosts], "x string").withColumn("code", scalar.anonymized_host(F.col("x"), key))
    rows = rows.withColumn("back", scalar.deanonymized_host(F.col("code"), key)).collect()
    assert [r.back for r in rows] == hosts and len({r.code for r in rows}) == len(hosts)
