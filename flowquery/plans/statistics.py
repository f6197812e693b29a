"""Counters, byte statistics and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowquery.operators import aggregates
from flowquery.plans.catalogue import query, r6
from flowquery.sources.flow_view import micros, table

BYTES = "b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) - 1 AS pos, ('0x' || pair)::INT AS byte FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS pair FROM documents))"
HIST = f"WITH {BYTES}, h AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL) "
POS = "WITH b AS (SELECT doc_id, lang, CAST(p AS INT) AS pos, ('0x' || x[2 * p + 1 : 2 * p + 2])::INT AS byte, len(x) // 2 AS size FROM (SELECT doc_id, lang, hex(encode(text)) AS x, unnest(range(0, {upto})) AS p FROM documents) WHERE 2 * p < len(x)) "
DOCS = ("doc_id", "text", "lang")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(*DOCS)


@query(
    "SELECT l_orderkey, count(*) AS np, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ob, min(epoch_us(l_shipdate)) AS first, max(epoch_us(l_shipdate)) AS last, "
    "CAST(min(l_linenumber) AS INT) AS min_ttl, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey)[1:50], ',') AS ids, bool_or(l_returnflag = 'R') AS invalid FROM lineitem GROUP BY l_orderkey"
)
def flow_counters(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    ids = F.array_sort(F.collect_list(F.when(F.col("place") <= 50, F.struct("l_linenumber", "l_partkey"))))
    return table(spark, sf_dir, "lineitem").withColumn("place", place).groupBy("l_orderkey").agg(
        F.count("*").alias("np"), F.sum(F.col("l_quantity").cast("long")).alias("ob"), F.min(micros("l_shipdate")).alias("first"), F.max(micros("l_shipdate")).alias("last"),
        F.min("l_linenumber").alias("min_ttl"), F.array_join(F.transform(ids, lambda x: x["l_partkey"].cast("string")), ",").alias("ids"),
        F.bool_or(F.col("l_returnflag") == "R").alias("invalid"),
    )


@query(HIST + "SELECT doc_id, byte, n FROM h")
def byte_histogram(spark, sf_dir):
    return aggregates.byte_histogram(documents(spark, sf_dir), ["doc_id"], "text")


@query(POS.format(upto=4000) + "SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL")
def byte_histogram_4000(spark, sf_dir):
    """Only the first 4000 octets of a flow count."""
    return aggregates.byte_histogram(documents(spark, sf_dir), ["doc_id"], "text", 4000)


@query(HIST + "SELECT doc_id, (byte * 7 + 3) % 16 AS bin, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL")
def compact_histogram(spark, sf_dir):
    bins = spark.range(256).select(F.col("id").cast("int").alias("byte"), ((F.col("id") * 7 + 3) % 16).cast("int").alias("bin"))
    hist = aggregates.byte_histogram(documents(spark, sf_dir), ["doc_id"], "text")
    return aggregates.compact_histogram(hist, ["doc_id"], bins)


@query(f"WITH {BYTES} SELECT doc_id, round(avg(byte), 6) AS mean, round(stddev_samp(byte), 6) AS std FROM b GROUP BY doc_id")
def byte_mean_std(spark, sf_dir):
    return aggregates.byte_statistics(documents(spark, sf_dir), ["doc_id"], "text").select("doc_id", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    HIST + ", t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM h) "
    "SELECT doc_id, round(-sum(n / total * log2(n / total)), 5) AS entropy, round(-sum(n / total * log2(n / total)) * max(total), 2) AS total_entropy FROM t GROUP BY doc_id"
)
def byte_entropy(spark, sf_dir):
    found = aggregates.byte_statistics(documents(spark, sf_dir), ["doc_id"], "text")
    return found.select("doc_id", F.round("entropy", 5).alias("entropy"), F.round("total_entropy", 2).alias("total_entropy"))


@query(
    POS.format(upto="(len(x) // 8) * 4")
    + "SELECT doc_id, round(sum(byte) / count(*), 6) AS s0, round(sum(CASE WHEN pos % 2 = 0 THEN byte ELSE -byte END) / count(*), 6) AS s1, "
    "round(sum(CASE WHEN pos % 4 < 2 THEN byte ELSE -byte END) / count(*), 6) AS s2, round(sum(CASE WHEN pos % 4 IN (0, 3) THEN byte ELSE -byte END) / count(*), 6) AS s3 FROM b GROUP BY doc_id"
)
def wht4(spark, sf_dir):
    found = aggregates.walsh4(documents(spark, sf_dir), ["doc_id"], "text")
    return found.select("doc_id", *(r6(f"s{i}").alias(f"s{i}") for i in range(4)))


@query(
    HIST + ", s AS (SELECT doc_id, greatest(0, len(bin(max(n))) - 8) AS s FROM h GROUP BY doc_id) "
    "SELECT doc_id, array_to_string(list(n >> s ORDER BY byte), ',') AS reduced FROM h JOIN s USING (doc_id) GROUP BY doc_id"
)
def hist_bit_reduce(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("byte", "n")))
    counts = aggregates.byte_histogram(documents(spark, sf_dir), ["doc_id"], "text").groupBy("doc_id").agg(F.transform(pairs, lambda x: x["n"]).alias("counts"))
    reduced = aggregates.bit_reduced(F.col("counts"))
    return counts.select("doc_id", F.array_join(F.transform(reduced, lambda x: x.cast("string")), ",").alias("reduced"))


@query(POS.format(upto=16) + "SELECT lang, pos, xor(255, xor(bit_and(byte), bit_or(byte))) AS mask, bit_and(byte) & xor(255, xor(bit_and(byte), bit_or(byte))) AS value FROM b GROUP BY lang, pos")
def header_const_mask(spark, sf_dir):
    rows = aggregates.bytes_of(documents(spark, sf_dir), ["doc_id", "lang"], "text", 16)
    return aggregates.constant_mask(rows, ["lang"])


PREVALENCE = "SELECT *, round(count / sum(count) OVER (PARTITION BY event_type), 2) AS prevalence FROM (SELECT event_type, user_id, count(*) AS count FROM events GROUP BY ALL)"


@query(PREVALENCE)
def proc_prevalence(spark, sf_dir):
    return aggregates.prevalence(table(spark, sf_dir, "events"), "event_type", "user_id")


@query(
    f"WITH p AS ({PREVALENCE}), seen AS (SELECT DISTINCT user_id % 20 AS client, event_type FROM events), "
    "s AS (SELECT client, CAST(user_id AS VARCHAR) AS process, sum(prevalence) AS p FROM seen JOIN p USING (event_type) GROUP BY ALL) "
    "SELECT client, process, round(p / sum(p) OVER (PARTITION BY client), 6) AS weight FROM s"
)
def client_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    weights = aggregates.prevalence(events, "event_type", "user_id").select("event_type", F.col("user_id").cast("string").alias("process"), "prevalence")
    found = aggregates.client_rollup(events.withColumn("client", F.col("user_id") % 20), "client", "event_type", weights, "process")
    return found.withColumn("weight", r6("weight"))


@query(
    "SELECT count(*) AS flows, count(*) FILTER (WHERE n >= 10) AS splt_ready, count(*) FILTER (WHERE q >= 100) AS bd_ready FROM (SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)"
)
def readiness_counts(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return per.agg(F.count("*").alias("flows"), F.count_if(F.col("n") >= 10).alias("splt_ready"), F.count_if(F.col("q") >= 100).alias("bd_ready"))


@query("SELECT label, arg_min(vec_id, (d, vec_id)) AS vec_id, min(d) AS distance FROM (SELECT label, vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT))) AS BIGINT) AS d FROM embeddings) GROUP BY label")
def argmin_by_distance(spark, sf_dir):
    """Of each label the vector nearest to zero, by the sum of its components' sizes in thousandths."""
    distance = F.reduce("embedding", F.lit(0).cast("long"), lambda a, x: a + F.floor(F.abs(x.cast("double")) * 1000))
    e = table(spark, sf_dir, "embeddings").withColumn("d", distance)
    return e.groupBy("label").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("vec_id"), F.min("d").alias("distance"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax FROM embeddings")
def argmax_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("argmax"))


@query("SELECT conv_id, arg_min(hex(encode(text))[1:64], turn) AS payload FROM conversations WHERE len(text) > 0 GROUP BY conv_id")
def payload_prefix(spark, sf_dir):
    first = F.hex(F.substring(F.encode("text", "UTF-8"), 1, 32))
    return table(spark, sf_dir, "conversations").where(F.length("text") > 0).groupBy("conv_id").agg(F.min_by(first, "turn").alias("payload"))


@query("SELECT conv_id, arg_min(text, turn) AS idp, count(*) AS packets FROM conversations GROUP BY conv_id")
def idp_first_payload(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("idp"), F.count("*").alias("packets"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rank FROM events) WHERE rank <= 25")
def top25_per_key(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("rank")).where("rank <= 25")
