"""Order-dependent queries and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquery.operators import windows
from flowquery.plans.catalogue import query, r6
from flowquery.sources.flow_view import micros, table
from flowquery.streaming import sessions as streams

HOUR = 3_600_000_000


def events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"), micros("ts").alias("t"))


EVENTS = "WITH e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) AS t FROM events) "


@query(EVENTS + "SELECT event_id, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) // 1000, 0) AS ipt FROM e")
def inter_arrival_ms(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", windows.gap_ms(["user_id"], "t", "event_id").alias("ipt"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN '>' ELSE '<' END AS dir, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE role WHEN 'user' THEN '>' ELSE '<' END, turn) AS place FROM conversations")
def interleave_two_dirs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.floor(F.col("turn") / 2) * 1000).alias("at"))
    mine, other = c.where("role = 'user'").drop("role"), c.where("role <> 'user' OR role IS NULL").drop("role")
    return windows.interleave(mine, other, ["conv_id"], "at").select("conv_id", "turn", "dir", "place")


@query(EVENTS + "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e) WHERE n <= 50")
def first_n_packets(spark, sf_dir):
    return windows.first_n(events(spark, sf_dir), ["user_id"], 50, "t", "event_id").select("user_id", "event_id", "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_partkey - coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 0) AS d FROM lineitem")
def delta_code(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", windows.delta(["l_orderkey"], "l_partkey", "l_linenumber", "l_partkey", "l_suppkey").alias("d"))


@query(EVENTS + "SELECT event_id, k - max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rel FROM e")
def running_max_rel_seq(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", (F.col("k") - windows.running_max(["user_id"], "k", "event_id")).alias("rel"))


@query(
    EVENTS + ", c AS (SELECT *, CAST(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS ch FROM e), "
    "i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c) "
    "SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS packets, CAST(sum(k) AS BIGINT) AS length, max(t) AS last FROM i GROUP BY user_id, island"
)
def salt_messages(spark, sf_dir):
    return windows.messages(events(spark, sf_dir), ["user_id"], "event_type", "k", "t", "event_id")


@query(EVENTS + "SELECT event_id, list_contains(list(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), k) IS TRUE AS again FROM e")
def retrans_last10(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", windows.retransmitted(["user_id"], "k", 10, "event_id").alias("again"))


MARKOV = "s AS (SELECT {g} AS g, {state} AS cur, lag({state}) OVER (PARTITION BY {g} ORDER BY {o}) AS prev FROM {t}), n AS (SELECT g AS {g}, prev, cur, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY ALL) SELECT {g}, prev, cur, n, round(n / sum(n) OVER (PARTITION BY {g}, prev), 6) AS p FROM n"


@query("WITH " + MARKOV.format(g="conv_id", state="CAST(least(len(text) // 150, 9) AS INT)", o="turn", t="conversations"))
def markov_lengths(spark, sf_dir):
    state = windows.bucket(F.char_length("text"), 150, 10)
    return windows.markov(table(spark, sf_dir, "conversations"), ["conv_id"], state, "turn").withColumn("p", r6("p"))


@query(EVENTS + ", w AS (SELECT user_id, event_id, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) // 1000, 0) AS ipt FROM e), " + MARKOV.format(g="user_id", state="CAST(least(ipt // 3600000, 9) AS INT)", o="event_id", t="w"))
def markov_times(spark, sf_dir):
    gaps = events(spark, sf_dir).select("user_id", "event_id", windows.gap_ms(["user_id"], "t", "event_id").alias("ipt"))
    return windows.markov(gaps, ["user_id"], windows.bucket(F.col("ipt"), 3_600_000, 10), "event_id").withColumn("p", r6("p"))


@query("SELECT l_orderkey, string_agg(repeat((l_suppkey % 50) || ',', CAST(1 + l_partkey % 3 AS INT)), '' ORDER BY l_linenumber, l_partkey, l_suppkey % 50) AS decoded FROM lineitem GROUP BY l_orderkey")
def rle_decode(spark, sf_dir):
    """Orders are written as runs (a value, then minus the number of its repeats) with an end mark and more behind it."""
    line = F.struct("l_linenumber", "l_partkey", (F.col("l_suppkey") % 50).cast("int").alias("q"))
    run = lambda x: F.when(x["l_partkey"] % 3 == 0, F.array(x["q"])).otherwise(F.array(x["q"], (-(x["l_partkey"] % 3)).cast("int")))
    coded = F.concat(F.flatten(F.transform(F.array_sort("lines"), run)), F.array(F.lit(-32768), F.lit(77)))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    decoded = F.transform(windows.run_length_decoded(coded), lambda x: F.concat(x.cast("string"), F.lit(",")))
    return lines.select("l_orderkey", F.array_join(decoded, "").alias("decoded"))


@query(
    EVENTS + f", g AS (SELECT user_id, t, CAST(coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {12 * HOUR}, true) AS INT) AS o FROM e), "
    'i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t) AS s FROM g) SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS n FROM i GROUP BY user_id, s'
)
def session_idle(spark, sf_dir):
    return windows.sessions(events(spark, sf_dir), "user_id", "t", 12 * HOUR)


CAPPED = (
    "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), "
    "w AS (SELECT user_id, i, t, t AS s FROM e WHERE i = 1 UNION ALL "
    f"SELECT e.user_id, e.i, e.t, CASE WHEN e.t - w.t > {12 * HOUR} OR e.t - w.s > {24 * HOUR} THEN e.t ELSE w.s END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) "
    'SELECT user_id, s AS start, max(t) AS "end", count(*) AS n FROM w GROUP BY user_id, s'
)


@query(CAPPED)
def session_idle_cap(spark, sf_dir):
    return windows.sessions(events(spark, sf_dir), "user_id", "t", 12 * HOUR, 24 * HOUR)


@query(CAPPED)
def stream_session_replay(spark, sf_dir):
    """The same sessions from a stream with state and timers."""
    return streams.replay(spark, sf_dir, 12 * HOUR, 24 * HOUR)
