"""Features, scores and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquery.functions import scalar
from flowquery.ml import features
from flowquery.operators import aggregates, windows
from flowquery.plans.catalogue import query, r6
from flowquery.plans.selection import FLOWS
from flowquery.sources.flow_view import flows, table

WEIGHTS = [-1.5, 0.04, -0.00001, 3.0, -2.0]


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(-1.5 + 0.04 * l_quantity - 0.00001 * l_extendedprice + 3.0 * l_discount - 2.0 * l_tax))), 6) AS p FROM lineitem")
def logistic_score(spark, sf_dir):
    p = scalar.logistic(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax"), WEIGHTS)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(p).alias("p"))


VOCABULARY = ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "red", "blue"]


@query("SELECT p_partkey, array_to_string(list_transform(['" + "', '".join(VOCABULARY) + "'], lambda v: CASE WHEN list_contains(list_concat([p_type], string_split(p_name, ' ')), v) THEN 1 ELSE 0 END), '') AS v FROM part")
def tls_indicator_vector(spark, sf_dir):
    values = F.concat(F.array("p_type"), F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(scalar.indicators(values, VOCABULARY), lambda x: x.cast("string")), "").alias("v"))


@query(FLOWS + "SELECT seq, array_to_string([coalesce(dp, 0), coalesce(sp, 0), 0, num_pkts_out, 0, bytes_out, (time_end - time_start) // 1000], ',') AS features, 7 AS width FROM flows")
def metadata_features(spark, sf_dir):
    none, col = F.lit(None), F.col
    duration = F.floor((col("time_end") - col("time_start")) / 1000)
    f = flows(spark, sf_dir).withColumn("m", features.metadata(col("dp"), col("sp"), none, col("num_pkts_out"), none, col("bytes_out"), duration))
    whole = F.array_join(F.transform("features", lambda x: x.cast("long").cast("string")), ",")
    return features.assemble(f, ["m"], 7).select("seq", whole.alias("features"), F.size("features").alias("width"))


@query(
    "WITH s AS (SELECT conv_id, CAST(least(len(text) // 150, 9) AS INT) AS cur, lag(CAST(least(len(text) // 150, 9) AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), "
    "n AS (SELECT conv_id, prev, cur, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY ALL) "
    "SELECT conv_id, prev * 10 + cur AS place, round(n / sum(n) OVER (PARTITION BY conv_id, prev), 6) AS share, 100 AS width FROM n"
)
def markov_vector(spark, sf_dir):
    """The cells of each transition matrix that are not zero."""
    v = features.markov_vectors(table(spark, sf_dir, "conversations"), "conv_id", F.char_length("text"), 150, 10, "turn")
    cells = v.select("conv_id", F.size("vector").alias("width"), F.posexplode("vector").alias("place", "share")).where("share > 0")
    return cells.select("conv_id", "place", r6("share").alias("share"), "width")


FOLD = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 + 1 AS INT)"


@query(f"SELECT doc_id, {FOLD} AS fold FROM labels")
def kfold_assign(spark, sf_dir):
    """The fold of every labelled row."""
    return features.folds(table(spark, sf_dir, "labels"), 10, F.col("doc_id")).select("doc_id", "fold")


@query(f"SELECT 10 AS fold, count(*) AS n, true AS good FROM documents JOIN labels USING (doc_id) WHERE {FOLD} = 10 HAVING count(*) > 0")
def train_l1_logreg(spark, sf_dir):
    """Shares of marks in texts against their quality, learnt on nine folds and scored on the tenth: right more often than not."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = ["!", "#", "$", "%", "&", "*", "|", ".", ",", "\n"]
    share = lambda m: (F.char_length("text") - F.char_length(F.replace("text", F.lit(m)))) / F.greatest(F.char_length("text"), F.lit(1))
    rows = d.join(labels, "doc_id").select("doc_id", F.col("quality").alias("label"), F.array(*map(share, marks)).alias("features"))
    rows = features.folds(rows, 10, F.col("doc_id"))
    model = features.train(rows.where("fold < 10"), c=10.0)
    right = (F.col("p") >= 0.5).cast("int") == F.col("label")
    scored = features.score(model, rows.where("fold = 10")).groupBy("fold").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("share"))
    return scored.select("fold", "n", (F.col("share") > 0.5).alias("good"))


def weight(place: int, step: int) -> float:
    """Weights by a rule, small for the plain figures."""
    return (place * step % 101 - 50) / 100 * (0.00001 if 0 < place < 8 else 1)


TURNS = (
    "WITH t AS (SELECT conv_id, turn, coalesce(role, '') = 'user' AS mine, coalesce(len(text), 0) AS b, coalesce(len(text), 0) * 7 % 600 AS ipt, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(len(text), 0), coalesce(role, '')) AS i FROM conversations), "
    "m AS (SELECT conv_id, count_if(mine) AS po, count_if(NOT mine) AS pi, coalesce(sum(b) FILTER (mine), 0) AS bo, coalesce(sum(b) FILTER (NOT mine), 0) AS bi, sum(ipt) FILTER (i <= 200) AS d, count(*) AS n FROM t GROUP BY 1), "
    "s AS (SELECT conv_id, i, least(b // 150, 9) AS l, least(ipt // 50, 9) AS g, n FROM t JOIN m USING (conv_id) WHERE i <= 200), "
    "p AS (SELECT conv_id, unnest([[0, CASE WHEN n = 1 THEN l ELSE lag(l) OVER w END, l], [1, CASE WHEN n = 1 THEN g ELSE lag(g) OVER w END, g]]) AS c FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY i)), "
    "k AS (SELECT conv_id, c[1] AS kind, c[2] AS prev, c[3] AS cur, count(*) AS n FROM p WHERE c[2] IS NOT NULL GROUP BY ALL), "
    "h AS (SELECT conv_id, byte, count(*) AS n FROM (SELECT conv_id, unnest([ord(x) FOR x IN string_split(text, '')]) AS byte FROM conversations WHERE text IS NOT NULL AND text <> '') WHERE byte < 256 GROUP BY ALL), "
    "v AS (SELECT conv_id, 8 + kind * 100 + prev * 10 + cur AS place, n / sum(n) OVER (PARTITION BY conv_id, kind, prev) AS value FROM k "
    "UNION ALL SELECT conv_id, 208 + byte, h.n / (bo + bi) FROM h JOIN m USING (conv_id) WHERE bo + bi > 100 "
    "UNION ALL SELECT conv_id, unnest(range(1, 8)), unnest([443, conv_id % 65536, pi, po, bi, bo, d]) FROM m) "
)


def conversation_vectors(spark, sf_dir):
    """(conv_id, v, shares): conversations as flows, the turns their packets; characters up to 255 count as bytes."""
    c, col = table(spark, sf_dir, "conversations"), F.col
    length = F.coalesce(F.char_length("text"), F.lit(0))
    turns = c.withColumns({"b": length, "ipt": length * 7 % 600, "mine": F.coalesce(col("role") == "user", F.lit(False)), "_role": F.coalesce("role", F.lit(""))})
    total = turns.groupBy("conv_id").agg(
        F.count_if("mine").alias("po"), F.count_if(~col("mine")).alias("pi"), F.coalesce(F.sum(F.when(col("mine"), col("b"))), F.lit(0)).alias("bo"), F.coalesce(F.sum(F.when(~col("mine"), col("b"))), F.lit(0)).alias("bi"),
    )
    listed = windows.first_n(turns, ["conv_id"], 200, "turn", "b", "_role").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "b", "ipt"))).alias("packets"))
    latin = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x{0}-\\x{FF}]", "")
    cells = aggregates.byte_histogram_of(c.select("conv_id", F.encode(latin, "ISO-8859-1").alias("data")), ["conv_id"], F.col("data"))
    found = F.map_from_entries(F.collect_list(F.struct("byte", "n")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("_c", b), F.lit(0)))
    counts = cells.groupBy("conv_id").agg(found.alias("_c")).select("conv_id", dense.alias("counts"))
    rows = total.join(listed, "conv_id").join(counts, "conv_id", "left")
    counts = F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), 256))
    v = features.flow_vector(col("packets"), F.lit(443), col("conv_id") % 65536, col("pi"), col("po"), col("bi"), col("bo"))
    return rows.select("conv_id", v.alias("v"), features.byte_shares(counts, col("bi"), col("bo")).alias("shares"))


@query(TURNS + "SELECT conv_id, CAST(place AS INT) AS place, round(value, 6) AS value FROM v WHERE value <> 0")
def flow_vectors(spark, sf_dir):
    """The cells that are not zero of the vectors of conversations; the constant has place 0."""
    none = F.array().cast("array<double>")
    cells = conversation_vectors(spark, sf_dir).select("conv_id", F.posexplode(F.concat("v", F.coalesce("shares", none))).alias("at", "value")).where("value <> 0")
    return cells.select("conv_id", (F.col("at") + 1).alias("place"), r6("value").alias("value"))


@query(
    TURNS + "SELECT conv_id, round(1 / (1 + exp(-greatest(least(w0 + z, 500), -500))), 5) AS p FROM (SELECT conv_id, -0.5 AS w0, "
    "sum(value * (place * (CASE WHEN bo + bi > 100 THEN 53 ELSE 37 END) % 101 - 50) / 100 * CASE WHEN place < 8 THEN 0.00001 ELSE 1 END) AS z FROM v JOIN m USING (conv_id) GROUP BY ALL)"
)
def flow_scores(spark, sf_dir):
    """Scores by one of two models: whether enough bytes were seen decides."""
    models = [[weight(i, step) for i in range(n)] for n, step in ((208, 37), (464, 53))]
    return conversation_vectors(spark, sf_dir).select("conv_id", F.round(features.p_malware(F.col("v"), F.col("shares"), *models), 5).alias("p"))
