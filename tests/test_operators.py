"""Operators on small tables, against what their definitions say."""

import math
import random

import pytest
from flowquery.functions import policy, scalar
from flowquery.ml import features
from flowquery.operators import aggregates, flows, joins, projection, stitch, windows
from flowquery.pipeline import FlowQuery
from flowquery.plans.catalogue import QUERIES
from flowquery.sinks import jsonl as sink
from flowquery.sources import exports, jsonl, pcap, subnets
from pyspark.sql import functions as F

FLOW = "seq long, sa string, da string, sp int, dp int, pr int, bytes_out long, num_pkts_out long, time_start long, time_end long"


def test_stitch_directs_by_the_first_record(spark):
    rows = [(2, "b", "a", 80, 1, 6, 7, 1, 5, 9), (1, "a", "b", 1, 80, 6, 10, 2, 0, 4), (3, "a", "b", 1, 80, 6, 5, 1, 9, 30), (4, "c", "a", None, None, 1, 1, 1, 2, 2)]
    found = {r.seq: r for r in stitch.stitch(spark.createDataFrame(rows, FLOW)).collect()}
    assert set(found) == {1, 4}
    r = found[1]
    assert (r.sa, r.da, r.bytes_out, r.bytes_in, r.num_pkts_out, r.num_pkts_in, r.time_end) == ("a", "b", 15, 7, 3, 1, 30)
    assert found[4].bytes_in is None


def test_stitch_sums_histograms_to_the_shortest(spark):
    rows = [(1, "a", "b", 1, 2, 6, [1, 2, 3]), (2, "b", "a", 2, 1, 6, [10, 20])]
    r = stitch.stitch(spark.createDataFrame(rows, "seq long, sa string, da string, sp int, dp int, pr int, byte_dist array<int>")).first()
    assert r.byte_dist == [11, 22]


def test_linked_answers_are_strictly_earlier(spark):
    f = spark.createDataFrame([(1, "x"), (3, "x"), (5, "x"), (5, "y")], "seq long, da string")
    a = spark.createDataFrame([(2, "x"), (4, "x"), (5, "x")], "seq long, address string")
    assert sorted((r.seq, r.da, r.link) for r in joins.linked(f.where("da = 'x'"), a).collect()) == [(1, "x", None), (3, "x", 2), (5, "x", 4)]


def test_subnets(spark):
    lines = spark.createDataFrame([("10.0.0.0/8 # ten",), ("10.1.2.3",), ("# none",), ("10.1.0.0/16# two ",)], "value string")
    nets = joins.subnets(subnets.parse(lines))
    addresses = spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("11.0.0.1",), ("::1",), (None,), ("10.1.2.300",)], "a string")
    assert {r.a: r.labels for r in joins.labels(addresses, "a", nets).collect()} == {"10.1.2.3": ["", "ten", "two"], "10.9.9.9": ["ten"]}


def test_common_subsequence(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(row[j], new[j - 1], row[j - 1] + (x == y)))
            row = new
        return row[-1]

    random.seed(2)
    rows = [([random.choice("abc") for _ in range(random.randint(0, 8))], [random.choice("abc") for _ in range(random.randint(0, 8))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", joins.common_subsequence(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == plain(r.a, r.b) for r in df.collect())


def test_approximate_match(spark):
    side = lambda rows, k: spark.createDataFrame(rows, f"{k} string, items array<string>").withColumn("terms", joins.grams(F.col("items"), 2))
    queries = side([("1", list("abcdefghij")), ("2", list("zyxwv"))], "q")
    database = side([("A", list("abcdefghiX")), ("B", list("abcXXXXXXX")), ("C", list("mnopq"))], "k")
    assert [(r.q, r.k, round(r.distance, 6)) for r in joins.approximate_match(queries, database, 0.2).collect()] == [("1", "A", 0.1)]


def _plain_match(query, database, n, limit):
    """As the reference ranks and aligns (suites, extensions), over all entries."""
    grams = lambda x: {"".join(x[i : i + 4]) for i in range(len(x) - 4)} or set(x)
    scored = []
    for k, (suites, extensions) in database.items():
        s = len(grams(query[0]) & grams(suites)) / len(grams(query[0]) | grams(suites))
        scored.append((s + len(set(query[1]) & set(extensions)) / max(1, len(set(query[1]) | set(extensions))), k))
    found = []
    for _, k in sorted(scored, reverse=True)[:n]:
        a, b = sum(query, []), sum(database[k], [])
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + (x == y))
        found.append((1 - 2 * table[-1][-1] / (len(a) + len(b)), k))
    distance, k = min(found)
    return (k, round(distance, 9)) if distance < limit else None


def test_fingerprints_match_as_in_the_reference(spark):
    random.seed(5)
    code = lambda i: f"{i:04x}"
    base = [([code(random.randrange(40)) for _ in range(random.randint(5, 20))], [code(random.randrange(60, 75)) + "ab" * random.randint(0, 2) for _ in range(random.randint(0, 6))]) for _ in range(12)]
    # One suite too many cuts all 4-grams of seven suites: such an entry has no similarity and is reached by its key alone.
    base.append(([code(i) for i in range(100, 107)], []))
    edit = lambda x, most: [y for i, y in enumerate(x) if i not in random.sample(range(len(x) + 1), random.randint(0, most))]
    database = {f"k{i:02}": (edit(s, 2), edit(e, 1)) for i, (s, e) in enumerate([x for x in base[:12] for _ in range(4)])} | {"k99": base[12]}
    queries = {f"q{i:02}": (edit(s, 1), edit(e, 1)) for i, (s, e) in enumerate(base[:12])}
    queries["q50"] = (base[12][0][:3] + ["ffff"] + base[12][0][3:], [])
    queries["q51"], database["k98"] = ([code(i) for i in range(200, 220)], []), ([code(i) for i in range(200, 217)], [])  # 20 against 17
    text = lambda s, e: f"(0303)({''.join(s)})({''.join(f'({x})' for x in e)})"
    side = lambda rows, key: joins.fingerprint_features(spark.createDataFrame([(i, text(*x)) for i, x in rows.items()], f"{key} string, t string"), key, scalar.fingerprint_parts(F.col("t")))
    for n in (3, 25):
        found = {r.q: (r.k, round(r.distance, 9)) for r in joins.approximate_match(side(queries, "q"), side(database, "k"), 0.1, n).collect()}
        expected = {q: m for q, x in queries.items() if (m := _plain_match(x, database, n, 0.1))}
        assert found == expected
        assert found["q50"] == ("k99", round(1 / 15, 9)) and found["q51"] == ("k98", round(3 / 37, 9))


def test_candidates_are_ranked_by_extensions_too(spark):
    side = lambda rows, k: spark.createDataFrame(rows, f"{k} string, terms array<string>, extensions array<string>")
    queries = side([("1", ["a", "b", "c"], ["x", "y"])], "q")
    database = side([("A", ["a", "b"], []), ("B", ["a"], ["x", "y"]), ("C", [], ["x"]), ("D", ["z"], ["z"])], "k")
    assert [(r.k, round(r.score, 6)) for r in joins.candidates(queries, database).orderBy("rank").collect()] == [("B", 1.333333), ("A", 0.666667), ("C", 0.5)]


def test_capped_sessions_are_like_a_plain_fold(spark):
    random.seed(3)
    rows = [(k, t) for k in range(8) for t in {random.randint(0, 400) for _ in range(50)}]
    expected = []
    for k in range(8):
        start = last = None
        for t in sorted(t for key, t in rows if key == k):
            if start is None or t - last > 12 or t - start > 30:
                if start is not None:
                    expected.append((k, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        expected.append((k, start, last, n))
    df = spark.createDataFrame(rows, "k long, t long")
    assert sorted(tuple(r) for r in windows.sessions(df, "k", "t", 12, 30).collect()) == sorted(expected)
    assert windows.sessions(df.limit(0), "k", "t", 12, 30).count() == 0


@pytest.mark.parametrize(("coded", "plain"), [([5, -2, 7], [5, 5, 5, 7]), ([1, -1, -32768, 9], [1, 1]), ([], []), ([0, 0], [0, 0])])
def test_run_lengths(spark, coded, plain):
    df = spark.createDataFrame([(coded,)], "x array<int>")
    assert df.select(windows.run_length_decoded(F.col("x"))).first()[0] == plain


def test_grams_leave_out_the_last(spark):
    df = spark.createDataFrame([(list("abcdef"),), (list("abcd"),), ([],)], "x array<string>")
    assert [r[0] for r in df.select(joins.grams(F.col("x"))).collect()] == [["abcd", "bcde"], list("abcd"), []]


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("::1",), ("1.2.3",), ("1.2.3.4.",), (None,)], "a string")
    assert [r[0] for r in df.select(joins.ipv4(F.col("a"))).collect()] == [16909060, 2**32 - 1, None, None, None, None]
    key = F.encode(F.lit("0123456789abcdef"), "UTF-8")
    code = df.limit(1).select(scalar.anonymized(F.col("a"), key).alias("c"))
    assert code.select(F.length("c"), scalar.deanonymized(F.col("c"), key)).first()[:] == (32, "1.2.3.4")


def test_fingerprints_are_degreased(spark):
    text = "(0303)(1a1ac02b)((fafa0001)(000b0002))"
    row = spark.range(1).select(scalar.normalized_fingerprint(F.lit(text)), scalar.degrease_all(F.lit("1a1a2a3a4a4a"))).first()
    assert list(row) == ["(0303)(0a0ac02b)((0a0a0001)(000b0002))", "0a0a2a3a0a0a"]


def test_codes_behind_the_first_bytes_are_degreased(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 40 + "zzJJ\n\n"), (2, "xzz"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.codes for r in QUERIES["grease_normalize"](spark, str(tmp_path)).collect()}
    assert found == {1: "61" * 40 + "0a0a" * 3, 2: "787a7a", 3: "", 4: None}


def test_policy(spark):
    rules = policy.Policy({"kex": {"RSA": policy.Rule(3, "<", ((1024, 1), (2048, 2))), "DH": policy.Rule(4)}}, {1: "low", 2: "mid"}, 0)
    df = spark.createDataFrame([("RSA", 512), ("RSA", 1500), ("RSA", 4096), ("DH", None), ("X", 1), (None, 1)], "k string, n int")
    level = rules.level("kex", F.col("k"), F.col("n"))
    assert [tuple(r) for r in df.select(level, rules.classification(level)).collect()] == [(1, "low"), (2, "mid"), (3, "unknown"), (4, "unknown"), (0, "unknown"), (None, "unknown")]


def test_query_builder(spark):
    rows = [(1, "a", "b", 1, 80, 6, 10, 2, 0, 4), (2, "b", "a", 80, 1, 6, 7, 1, 5, 9), (3, "c", "b", 1, 53, 17, 5, 1, 9, 30)]
    q = FlowQuery(spark.createDataFrame(rows, FLOW))
    assert [r.asDict() for r in q.where("pr=6").stitch().select("da,bytes_out,bytes_in").run().collect()] == [{"da": "b", "bytes_out": 10, "bytes_in": 7}]
    assert [tuple(r) for r in q.select("pr").dist().sum("pr").run().collect()] == [(6, 2, 3), (17, 1, 3)]
    assert q.normalize("sa").select("sa,pr").run().where("sa IS NULL").count() == 3
    assert q.groupby("pr").run().count() == 3


def test_enrich_leaves_out_what_is_empty(spark):
    df = spark.createDataFrame([(1, "x"), (0, "")], "n int, s string")
    assert [r.m for r in projection.enrich(df, "m", F.col("s")).collect()] == ["x", None]


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    path = str(tmp_path / "flows")
    sink.write(df, path, "gzip")
    lines = jsonl.read_lines(spark, path)
    (tmp_path / "odd").mkdir()
    import bz2
    import gzip

    (tmp_path / "odd" / "one.dat").write_bytes(gzip.compress(b'{"version":"1"}\n{"n":3}\nbad\n'))
    (tmp_path / "odd" / "two.dat").write_bytes(bz2.compress(b'{"n":4}\n\n'))
    (tmp_path / "odd" / "three.dat").write_bytes(b'{"n":5}')
    odd = jsonl.read_lines_by_magic(spark, str(tmp_path / "odd"))
    numbers = [r[0] for r in jsonl.parse(lines.union(odd)).select(F.variant_get("record", "$.n", "int")).collect()]
    assert sorted(numbers) == [1, 2, 3, 4, 5]
    assert tuple(jsonl.bad_lines(odd).first()) == (6, 2)
    assert jsonl.parse(sink.with_config(df, threads=1)).count() == 2


def test_byte_statistics(spark):
    df = spark.createDataFrame([(1, "aab"), (2, "éa")], "k long, t string")
    found = {r.k: r for r in aggregates.byte_statistics(df, ["k"], "t").collect()}
    assert round(found[1].entropy, 6) == 0.918296 and found[2].n == 3 and round(found[1].std, 6) == 0.57735
    wht = aggregates.walsh4(spark.createDataFrame([(1, "aaaa"), (2, "abab")], "k long, t string"), ["k"], "t")
    assert {r.k: (r.s0, r.s1, r.s2, r.s3) for r in wht.collect()} == {1: (97.0, 0.0, 0.0, 0.0), 2: (97.5, -0.5, 0.0, 0.0)}


def test_markov_vectors(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 10, 0, 20, 0])], "k long, i long, v long")
    v = features.markov_vectors(df, "k", F.col("v"), 10, 3, "i").first().vector
    assert v == [0.0, 0.5, 0.5, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


# Packets


def ethernet(ip: bytes, kind: int = 0x0800, tags: tuple[int, ...] = ()) -> bytes:
    return bytes(12) + b"".join(t.to_bytes(2) + b"\0\1" for t in tags) + kind.to_bytes(2) + ip


def ip4(src: str, dst: str, protocol: int, body: bytes, ident: int = 7, fragment: int = 0) -> bytes:
    head = bytes([0x45, 0]) + (20 + len(body)).to_bytes(2) + ident.to_bytes(2) + fragment.to_bytes(2) + bytes([64, protocol, 0, 0])
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def tcp(sp: int, dp: int, seq: int, flags: int, payload: bytes = b"", opts: bytes = b"") -> bytes:
    return sp.to_bytes(2) + dp.to_bytes(2) + seq.to_bytes(4) + bytes(4) + bytes([(20 + len(opts)) // 4 << 4, flags]) + (8192).to_bytes(2) + bytes(4) + opts + payload


def capture(frames: list[tuple[int, bytes]]) -> bytes:
    return b"\xd4\xc3\xb2\xa1" + bytes(20) + b"".join((t // 1_000_000).to_bytes(4, "little") + (t % 1_000_000).to_bytes(4, "little") + 2 * len(f).to_bytes(4, "little") + f for t, f in frames)


def test_capture_to_flows(spark, tmp_path):
    s, a, b = 1_000_000, "10.0.0.1", "10.0.0.2"
    frames = [
        (0, ethernet(ip4(a, b, 6, tcp(1000, 80, 1, 2)), tags=(0x8100,))), (s, ethernet(ip4(b, a, 6, tcp(80, 1000, 9, 18)))),
        (2 * s, ethernet(ip4(a, b, 6, tcp(1000, 80, 2, 24, b"GET /")))), (2 * s + 5, ethernet(ip4(a, b, 6, tcp(1000, 80, 2, 24, b"GET /")))),
        (3 * s, ethernet(ip4(b, a, 6, tcp(80, 1000, 10, 24, b"HTTP/1.1 200 OK")))), (14 * s, ethernet(ip4(a, b, 6, tcp(1000, 80, 7, 24, b"late")))),
        (15 * s, ethernet(ip4(a, b, 17, b"\0\x35\0\x35\0\x0a\0\0hi"))), (16 * s, ethernet(b"", 0x0806)), (17 * s, ethernet(ip4(a, b, 6, b"short"))),
        (18 * s, ethernet(ip4(a, b, 6, tcp(5, 6, 1, 2), fragment=100))),
    ]
    (tmp_path / "x.pcap").write_bytes(capture(frames) + b"cut")
    packets = pcap.packets(pcap.read(spark, str(tmp_path / "x.pcap"))).cache()
    assert packets.count() == 9 and packets.where(pcap.bpf("tcp and port 80 and not src host 10.0.0.2")).count() == 4
    assert packets.where(pcap.bpf("udp or (net 10.0.0.0/31 and dst port 80)")).count() == 5
    found = {(r.sp, r.dp, r.pr, r.time_start): r for r in flows.build(packets).collect()}
    first = found[1000, 80, 6, 0]
    assert (first.sa, first.bytes_out, first.num_pkts_out, first.bytes_in, first.tcp_retrans, first.first_seq) == (a, 5, 2, 15, 1, 1)
    assert [(p.b, p.dir, p.ipt) for p in first.packets] == [(5, ">", 2000), (15, "<", 1000)]
    assert found[1000, 80, 6, 14 * s].bytes_out == 4 and found[None, None, 6, 17 * s].invalid and (None, None, 0, 18 * s) in found
    data = {(r.sa, r.pr, r.session): bytes(r.data) for r in flows.streams(packets).collect() if r.sp is not None}
    assert data[a, 6, 0] == b"GET /" and data[a, 6, 14 * s] == b"late" and data[a, 17, 15 * s] == b"hi"


def test_streams_over_repeats_and_a_wrap(spark):
    """The longest of a repeated packet counts, sequence numbers may wrap, and a port used again is a record of its own."""
    top = 1 << 32
    rows = [(0, top - 3, b"abc"), (1, 0, b"d"), (2, 0, b"def"), (3, 3, b"ghi"), (60_000_000, 50, b"new")]
    p = spark.createDataFrame([("f", i, t * 1000 if t < 100 else t, q, d) for i, (t, q, d) in enumerate(rows)], "file string, seq long, ts_us long, tcp_seq long, payload binary")
    p = p.selectExpr("*", "'a' AS sa", "'b' AS da", "1 AS sp", "2 AS dp", "6 AS pr")
    assert sorted((r.session, bytes(r.data)) for r in flows.streams(p).collect()) == [(0, b"abcdefghi"), (60_000_000, b"new")]


def test_active_timeout(spark):
    rows = [("f", i, i * 9_000_000) for i in range(8)]
    p = spark.createDataFrame(rows, "file string, seq long, ts_us long").selectExpr("*", "'a' AS sa", "'b' AS da", "1 AS sp", "2 AS dp", "17 AS pr")
    assert [r.session // 1_000_000 for r in flows.numbered(p).orderBy("seq").collect()] == [0, 0, 0, 0, 36, 36, 36, 36]


def test_exports(spark):
    fields = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4)]
    template = (256).to_bytes(2) + len(fields).to_bytes(2) + b"".join(k.to_bytes(2) + n.to_bytes(2) for k, n in fields)
    record = bytes([10, 0, 0, 1, 10, 0, 0, 2]) + (5).to_bytes(2) + (80).to_bytes(2) + b"\6" + (99).to_bytes(4)
    sets = lambda kind, body: kind.to_bytes(2) + (len(body) + 4).to_bytes(2) + body
    nine = lambda body: (9).to_bytes(2) + (1).to_bytes(2) + bytes(12) + (3).to_bytes(4) + body
    ten = lambda body: (10).to_bytes(2) + (16 + len(body)).to_bytes(2) + bytes(8) + (4).to_bytes(4) + body
    rows = [("x", 1, nine(sets(256, record))), ("x", 2, nine(sets(0, template))), ("x", 3, nine(sets(256, record * 2))), ("y", 1, ten(sets(2, template) + sets(256, record)))]
    found = exports.flow_fields(exports.decode(spark.createDataFrame(rows, "exporter string, seq long, payload binary"))).collect()
    assert sorted((r.exporter, r.seq, r.record, r.sa, r.dp, r.bytes_out) for r in found) == [("x", 3, 0, "10.0.0.1", 80, 99), ("x", 3, 1, "10.0.0.1", 80, 99), ("y", 1, 0, "10.0.0.1", 80, 99)]


def test_rollup_of_prevalences_that_round_to_zero(spark):
    seen = spark.createDataFrame([(1, "a"), (2, "b")], "client int, key string")
    weights = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 0.0), ("b", "x", 0.0), ("b", "y", 0.5)], "key string, process string, prevalence double")
    found = {(r.client, r.process): r.weight for r in aggregates.client_rollup(seen, "client", "key", weights, "process").collect()}
    assert math.isnan(found[1, "x"]) and math.isnan(found[1, "y"]) and (found[2, "x"], found[2, "y"]) == (0.0, 1.0)


def test_near_twins_meet_in_one_join(spark):
    rows = [(1, "a", "n", 1, 80), (2, "n", "a", 80, 1), (3, "n", "b", 80, 1), (4, "c", "a", 80, 1), (5, "x", "y", 80, 1), (6, None, "a", 80, 1), (7, "z", None, 1, 80)]
    flow = spark.createDataFrame([(*r, 6, 0, 9) for r in rows], "seq long, sa string, da string, sp int, dp int, pr int, time_start long, time_end long")
    found = joins.twins(flow, near=True)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (1, 3), (1, 4), (1, 6)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
