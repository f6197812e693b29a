"""Scans, projections, predicates, grouping and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquery import compile as c
from flowquery.operators import aggregates, projection
from flowquery.pipeline import FlowQuery
from flowquery.plans.catalogue import query, r6
from flowquery.sources import jsonl
from flowquery.sources.flow_view import FLOWS_SQL, conversations, flows, nested, table

FLOWS = "WITH flows AS (" + FLOWS_SQL.format(turned="false") + ") "
CONVS = "WITH convs AS (SELECT conv_id, list(len(text) ORDER BY turn) AS b, list(CASE role WHEN 'user' THEN '>' ELSE '<' END ORDER BY turn) AS d FROM conversations GROUP BY conv_id) "
NESTED = FLOWS + ", nested AS (SELECT *, CASE WHEN pr = 6 THEN seq END AS first_seq, CASE WHEN pr = 6 THEN sp END AS tport, CASE WHEN pr = 6 THEN CAST(seq % 64 AS INT) END AS flags FROM flows) "


@query(FLOWS + "SELECT da, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(*) AS sum_over FROM flows GROUP BY da ORDER BY bytes_out DESC, da LIMIT 10")
def topn_destinations(spark, sf_dir):
    summed = FlowQuery(flows(spark, sf_dir)).select("da,bytes_out").groupby("da").sum("bytes_out").run()
    return aggregates.top(summed, 10, F.desc("bytes_out"), F.col("da"))


@query("SELECT event_id AS seq, user_id, event_type FROM events")
def scan_skip_metadata(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    config = table(spark, sf_dir, "region").select(F.to_json(F.struct(F.lit("4.5").alias("version"), "r_regionkey")).alias("value"))
    records = jsonl.parse(events.union(config))
    get = lambda p, t: F.variant_get("record", p, t)
    return records.select(get("$.event_id", "long").alias("seq"), get("$.user_id", "long").alias("user_id"), get("$.event_type", "string").alias("event_type"))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE NOT json_valid(v)) AS bad FROM (SELECT props AS v FROM events UNION ALL SELECT html FROM pages)")
def scan_bad_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("props").union(table(spark, sf_dir, "pages").select("html"))
    return jsonl.bad_lines(lines, "props")


@query("SELECT 'orders' AS file, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer")
def scan_per_file(spark, sf_dir):
    """Each input file is a stream of its own; rows know theirs."""
    files = [table(spark, sf_dir, t).select(F.col("_metadata.file_path").alias("file"), F.col(k).alias("key")) for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"))]
    name = F.regexp_extract("file", r"(orders|customer)\.parquet", 1)
    return files[0].union(files[1]).groupBy(name.alias("file")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query(FLOWS + "SELECT seq, sa, dp FROM flows")
def select_flat(spark, sf_dir):
    return projection.select(flows(spark, sf_dir), "seq,sa,dp")


@query(NESTED + "SELECT seq, first_seq, flags FROM nested")
def select_nested(spark, sf_dir):
    found = projection.select(nested(spark, sf_dir), "seq,tcp{first_seq,out{flags}}")
    return found.select("seq", "tcp.first_seq", F.col("tcp.out.flags").alias("flags"))


@query(CONVS + "SELECT conv_id, array_to_string(b, ',') AS b FROM convs")
def select_array_elems(spark, sf_dir):
    found = projection.select(conversations(spark, sf_dir), "conv_id,packets[{b}]")
    return found.select("conv_id", F.array_join(F.transform("packets.b", lambda x: x.cast("string")), ",").alias("b"))


@query(CONVS + "SELECT conv_id, CAST(2 * len(b) AS BIGINT) AS n, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || ',' || d[i]), ',') AS items FROM convs")
def select_multi_template(spark, sf_dir):
    found = projection.select(conversations(spark, sf_dir), "conv_id,packets[{b},{dir}]")
    items = F.transform("packets", lambda x: F.coalesce(x["b"].cast("string"), x["dir"]))
    return found.select("conv_id", F.size("packets").cast("long").alias("n"), F.array_join(items, ",").alias("items"))


@query(FLOWS + "SELECT dp FROM flows WHERE dp IS NOT NULL")
def select_drops_empty(spark, sf_dir):
    return projection.select(flows(spark, sf_dir), "dp")


@query(NESTED + "SELECT seq, first_seq, tport, CAST(NULL AS INT) AS flags, first_seq IS NOT NULL AS kept FROM nested")
def normalize_leaf(spark, sf_dir):
    found = projection.normalize(nested(spark, sf_dir), "tcp{out{flags}}")
    return found.select("seq", "tcp.first_seq", F.col("tcp.out.port").alias("tport"), F.col("tcp.out.flags").alias("flags"), F.col("tcp.out").isNotNull().alias("kept"))


@query(CONVS + "SELECT conv_id, array_to_string(list_transform(b, lambda x: x * 2), ',') AS b, array_to_string(d, '') AS d FROM convs")
def apply_leaf(spark, sf_dir):
    found = projection.apply(conversations(spark, sf_dir), "packets[{b}]", lambda x: x * 2)
    return found.select("conv_id", F.array_join(F.transform("packets.b", lambda x: x.cast("string")), ",").alias("b"), F.array_join("packets.dir", "").alias("d"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN c_name LIKE '%5' THEN c_name END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_col(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    found = projection.enrich(joined, "label", F.when(F.col("c_name").endswith("5"), F.col("c_name")).otherwise(""))
    return found.select("o_orderkey", "o_custkey", "label")


@query(NESTED + "SELECT seq, flags, first_seq, CASE WHEN first_seq IS NOT NULL THEN pr * 10 END AS extra FROM nested")
def enrich_into(spark, sf_dir):
    found = projection.enrich_into(nested(spark, sf_dir), "tcp", extra=F.col("pr") * 10)
    return found.select("seq", F.col("tcp.out.flags").alias("flags"), "tcp.first_seq", F.col("tcp.extra").alias("extra"))


@query(NESTED + "SELECT seq, flags, tport FROM nested")
def tls_tcp_preset(spark, sf_dir):
    """A preset fingerprint: select, then null the leaves that vary."""
    chosen = projection.select(nested(spark, sf_dir), "seq,tcp{first_seq,out{flags,port}}")
    found = projection.normalize(chosen, "tcp{first_seq}")
    return found.where("tcp.first_seq IS NULL").select("seq", F.col("tcp.out.flags").alias("flags"), F.col("tcp.out.port").alias("tport"))


def _where(name: str, predicate: str, condition: str, view=flows, prefix: str = FLOWS, source: str = "flows", key: str = "seq"):
    def run(spark, sf_dir):
        df = view(spark, sf_dir)
        return df.where(c.where(df.schema, predicate)).select(key)

    run.__name__ = name
    query(prefix + f"SELECT {key} FROM {source} WHERE {condition}")(run)


_where("where_eq_int", "dp=443", "dp = 443")
_where("where_glob", "sa=10.0.0.1*", "sa LIKE '10.0.0.1%'")
_where("where_glob_inner", "da=192.*.0.?5", "regexp_matches(da, '^192\\..*\\.0\\..5$')")
_where("where_glob_charset", "da=192.168.0.[12]", "da IN ('192.168.0.1', '192.168.0.2')")
_where("where_gt", "bytes_out>900", "bytes_out > 900")
_where("where_lt", "bytes_out<100.5", "bytes_out < 100.5")
_where("where_present", "dp=*", "dp IS NOT NULL")
_where("where_absent", "dp~*", "dp IS NULL")
_where("where_not_eq_missing", "dp~80", "dp <> 80")
_where("where_not_glob", "da~192.168.0.1*", "da NOT LIKE '192.168.0.1%'")
_where("where_or_binds_tighter", "pr=6,dp=80|dp=22", "pr = 6 AND (dp = 80 OR dp = 22)")
_where("where_parentheses", "(pr=6,dp=80)|dp=53", "(pr = 6 AND dp = 80) OR dp = 53")
_where("where_port_filter", "dp=443,pr=6", "dp = 443 AND pr = 6")
_where("where_nested", "tcp{out{flags}}>60", "flags > 60", nested, NESTED, "nested")
_where("where_nested_absent", "tcp{first_seq}~*", "first_seq IS NULL", nested, NESTED, "nested")
_where("where_array_any", "packets[{b}]>300", "len(list_filter(b, lambda x: x > 300)) > 0", conversations, CONVS, "convs", "conv_id")
_where("where_array_not", "packets[{b}]~100", "len(list_filter(b, lambda x: x <> 100)) > 0", conversations, CONVS, "convs", "conv_id")
_where("where_inline_condition", "packets[{b>300}]", "len(list_filter(b, lambda x: x > 300)) > 0", conversations, CONVS, "convs", "conv_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50 AND event_type LIKE 'c%'")
def where_variant(spark, sf_dir):
    """The same language over a VARIANT, without a schema."""
    events = table(spark, sf_dir, "events")
    packed = events.select("event_id", F.parse_json(F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit("}"))).alias("v"))
    return packed.where(c.where_variant(F.col("v"), "props{k}>50,type=c*")).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 2 = 0")
def where_variant_null_present(spark, sf_dir):
    """A JSON null is there; a missing key is not."""
    body = F.when(F.col("event_id") % 2 == 0, '{"sp":null}').otherwise('{"dp":1}')
    packed = table(spark, sf_dir, "events").select("event_id", F.parse_json(body).alias("v"))
    return packed.where(c.where_variant(F.col("v"), "sp=*")).select("event_id")


@query(FLOWS + "SELECT da, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(*) AS sum_over FROM flows GROUP BY da")
def groupby_sum(spark, sf_dir):
    return FlowQuery(flows(spark, sf_dir)).select("da,bytes_out").groupby("da").sum("bytes_out").run()


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, count(*) AS sum_over FROM lineitem GROUP BY ALL")
def groupby_sum_lineitem(spark, sf_dir):
    chosen = FlowQuery(table(spark, sf_dir, "lineitem")).select("l_returnflag,l_linestatus,l_quantity,l_extendedprice")
    found = chosen.groupby("l_returnflag", "l_linestatus").sum("l_quantity", "l_extendedprice").run()
    return found.withColumns({x: F.round(x, 2) for x in ("l_quantity", "l_extendedprice")})


@query(FLOWS + "SELECT dp, count(*) AS sum_over FROM flows GROUP BY dp")
def groupby_count(spark, sf_dir):
    """Rows that lack the key form one group."""
    return aggregates.sums(flows(spark, sf_dir).select("dp"), ["dp"], [])


@query(FLOWS + "SELECT CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(num_pkts_out) AS BIGINT) AS num_pkts_out, count(*) AS sum_over FROM flows")
def sum_global(spark, sf_dir):
    return FlowQuery(flows(spark, sf_dir)).select("bytes_out,num_pkts_out").sum("bytes_out", "num_pkts_out").run()


@query("SELECT label, CAST(pos - 1 AS INT) AS pos, round(sum(embedding[pos]), 4) AS value FROM (SELECT label, embedding, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY label, pos")
def sum_arrays(spark, sf_dir):
    found = aggregates.sum_by_position(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), ["label"], "embedding")
    return found.select("label", "pos", F.round("value", 4).alias("value"))


@query("SELECT o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, count(*) AS sum_over FROM orders GROUP BY o_orderstatus")
def sum_fixed_fields(spark, sf_dir):
    """Columns that are not summed come as their distinct values."""
    found = FlowQuery(table(spark, sf_dir, "orders")).select("o_orderstatus,o_orderpriority,o_totalprice").groupby("o_orderstatus").sum("o_totalprice").run()
    return found.select("o_orderstatus", F.array_join("o_orderpriority", ",").alias("o_orderpriority"), F.round("o_totalprice", 2).alias("o_totalprice"), "sum_over")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def dist_all(spark, sf_dir):
    return FlowQuery(table(spark, sf_dir, "lineitem")).select("l_returnflag,l_linestatus").dist().run()


@query("SELECT *, CAST(sum(count) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL)")
def dist_grouped(spark, sf_dir):
    return FlowQuery(table(spark, sf_dir, "orders")).select("o_orderstatus,o_orderpriority").groupby("o_orderstatus").dist().run()


@query("SELECT '{\"k\":' || CAST(json_extract_string(props, '$.k') AS INT) || '}' AS key, count(*) AS sum_over FROM events GROUP BY key")
def groupby_nested_key(spark, sf_dir):
    """Nested keys group by their canonical JSON."""
    keyed = table(spark, sf_dir, "events").select(F.to_json(F.parse_json("props")).alias("key"))
    return aggregates.sums(keyed, ["key"], [])


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def groupby_passthrough(spark, sf_dir):
    return FlowQuery(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")).groupby("o_orderpriority").run()


@query("SELECT o_custkey AS id, o_orderkey, NULL AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def union_files(spark, sf_dir):
    """Files of different columns as one stream."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return o.unionByName(c, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query("SELECT o_orderpriority, max(o_orderstatus) AS latest, min(o_orderstatus) AS earliest FROM orders GROUP BY 1")
def impl_dates_minmax(spark, sf_dir):
    """Dates compare as strings."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_orderstatus").alias("latest"), F.min("o_orderstatus").alias("earliest"))


@query("SELECT p_partkey, round(p_retailprice / 7, 6) AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topn_sorted(spark, sf_dir):
    return aggregates.top(table(spark, sf_dir, "part"), 25, F.desc("p_retailprice"), F.col("p_partkey")).select("p_partkey", r6(F.col("p_retailprice") / 7).alias("price"))
