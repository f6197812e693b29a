"""Captures to records under sets of options, and the command line."""

import json

import pytest
from flowquery import capture, config
from flowquery.__main__ import main
from flowquery.features import registry
from flowquery.sinks import ipfix
from flowquery.sources import exports, fingerprints, jsonl
from pyspark.sql import functions as F

from tests.test_operators import capture as written
from tests.test_operators import ethernet, ip4, tcp

A, B, S = "10.0.0.1", "10.0.0.2", 1_000_000
NAME = b"\x03www\x07example\0"


def udp(sp, dp, body):
    return sp.to_bytes(2) + dp.to_bytes(2) + (8 + len(body)).to_bytes(2) + b"\0\0" + body


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    frames = [
        (0, ethernet(ip4(A, B, 6, tcp(1000, 80, 1, 2)))), (S, ethernet(ip4(B, A, 6, tcp(80, 1000, 9, 18)))),
        (2 * S, ethernet(ip4(A, B, 6, tcp(1000, 80, 2, 24, b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n")))), (3 * S, ethernet(ip4(B, A, 6, tcp(80, 1000, 10, 24, b"HTTP/1.1 200 OK\r\n\r\n")))),
        (4 * S, ethernet(ip4(A, B, 17, udp(5000, 53, b"\0\1\1\0\0\1\0\0\0\0\0\0" + NAME + b"\0\1\0\1")))), (5 * S, ethernet(ip4(A, B, 17, udp(7, 9, b"aab")))),
    ]
    path = tmp_path_factory.mktemp("c") / "x.data"
    path.write_bytes(written(frames))
    return str(path)


#: Options, number of records, and the columns that they add.
SETS = [
    ([], 4, set()), (["bidir=1"], 3, set()), (["bidir=1", "zeros=1"], 3, set()), (["bidir=1", "retrans=1"], 3, {"tcp_retrans"}), (["dist=1"], 4, {"byte_dist", "byte_dist_mean", "byte_dist_std"}),
    (["entropy=1"], 4, {"be", "tbe"}), (["bidir=1", "http=1"], 3, {"http"}), (["bidir=1", "dns=1", "tls=1"], 3, {"dns", "tls"}), (["ssh=1", "dhcp=1", "ike=1"], 4, {"ssh", "dhcp", "ike"}),
    (["payload=1", "fpx=1"], 4, {"payload", "fpx"}), (["idp=40"], 4, {"idp_out"}), (["num_pkts=1"], 4, set()), (["bpf=udp"], 2, set()), (["idle=1", "active=1"], 6, set()),
]


@pytest.mark.parametrize(("words", "n", "added"), SETS)
def test_option_sets(spark, file, words, n, added):
    assert capture.captures_among(spark, [file]) == (["file:" + file], [])
    plain = set(capture.records(spark, [file], config.Options()).columns)
    found = capture.records(spark, [file], config.parse(words))
    assert set(found.columns) - plain == added
    rows = found.collect()
    assert len(rows) == n and all(len(r.packets) <= (1 if words == ["num_pkts=1"] else 50) for r in rows)


def test_features_and_statistics(spark, file):
    rows = {r.dp: r for r in capture.records(spark, [file], config.parse(["bidir=1", "http", "dns", "dist", "entropy"])).collect()}
    assert rows[80].http["out"][0].uri == "/x" and rows[80]["http"]["in"] is not None and rows[53].dns["out"].qn == "www.example" and rows[53].http["out"] is None
    assert rows[9].byte_dist[97] == 2 and sum(rows[9].byte_dist) == 3 and rows[9].be == pytest.approx(0.9182958) and rows[9].byte_dist_mean == pytest.approx((97 * 2 + 98) / 3)


def test_labels_and_anonymous_addresses(spark, file, tmp_path):
    (tmp_path / "nets").write_text("10.0.0.1/32\n")
    rows = capture.records(spark, [file], config.parse([f"label=home:{tmp_path}/nets", "bpf=udp"])).collect()
    assert {(r.sa, tuple(r.sa_labels), tuple(r.da_labels)) for r in rows} == {(A, ("home",), ())}
    options = config.parse([f"anon={tmp_path}/nets", "key=0123456789abcdef", "bpf=udp"])
    assert "key" not in config.echo(options)
    assert all(len(r.sa) == 32 and r.da == B for r in capture.records(spark, [file], options).collect())
    with pytest.raises(ValueError, match="key"):
        capture.records(spark, [file], config.parse([f"anon={tmp_path}/nets"]))


def test_own_feature(spark, file):
    registry.register(registry.Feature("size", lambda: registry.on(17, 9), F.octet_length))
    packets = capture.pcap.packets(capture.pcap.read(spark, file))
    rows = registry.attach(capture.flows.build(packets), packets, ["size"]).collect()
    assert sorted((r.dp, r["size"]["out"]) for r in rows) == [(9, 3), (53, None), (80, None)]
    del registry.REGISTRY["size"]


def test_command_line(spark, file, capsys, tmp_path):
    assert main([file, "--option", "bidir=1", "--where", "pr=17", "--select", "dp,bytes_out"], spark) == 0
    assert sorted(x["dp"] for x in map(json.loads, capsys.readouterr().out.splitlines())) == [9, 53]
    main([file, "--option", "bidir=1", "--output", str(tmp_path / "out")], spark)
    assert jsonl.read_typed(spark, str(tmp_path / "out")).count() == 3
    (tmp_path / "f.json").write_text('{"version": "1"}\n{"da": "x", "b": 2}\n{"da": "x", "b": 3}\n{"da": "y", "b": 1}\nbad\n')
    main([str(tmp_path / "f.json"), "--groupby", "da", "--sum", "b"], spark)
    assert sorted((x["da"], x["b"]) for x in map(json.loads, capsys.readouterr().out.splitlines())) == [("x", 5), ("y", 1)]


def test_exports_of_both_versions(spark):
    big = bytes(range(256)) * 40
    rows = [("10.0.0.1", "10.0.0.2", 1, 2, 6, 1000, 2000, b"x"), ("fe80::1", "fe80::2", 3, 4, 17, 3000, 4000, big), ("10.0.0.3", "10.0.0.4", None, None, 1, 5000, 6000, None)]
    sent = ipfix.encode(spark.createDataFrame(rows, "sa string, da string, sp int, dp int, pr int, time_start long, time_end long, idp binary"), payload=True, export_time=0)
    read = exports.decode(sent.select(F.col("domain").cast("string").alias("exporter"), F.col("sequence").alias("seq"), F.col("message").alias("payload")))
    found = {r.sa: r for r in exports.flow_fields(read).collect()}
    assert {k: (r.da, r.sp, r.pr, r.start_ms) for k, r in found.items()} == {"10.0.0.1": ("10.0.0.2", 1, 6, 1), "fe80::1": ("fe80::2", 3, 17, 3), "10.0.0.3": ("10.0.0.4", 0, 1, 5)}
    assert big.hex() in {r.fields["e9.12000"] for r in read.collect()}


def test_fingerprint_database_files(spark, tmp_path):
    rows = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "b"), ("g", None), (None, "a")], "fp string, process string")
    fingerprints.write(fingerprints.entries(rows, "fp", "process"), str(tmp_path / "db"))
    with open(tmp_path / "more.json", "w") as f:
        f.write('{"str_repr": "g", "total_count": 1, "process_info": [{"process": "new", "count": 1, "prevalence": 1.0}]}\nbad\n')
    db = fingerprints.read(spark, str(tmp_path / "db"), str(tmp_path / "more.json"))
    assert [(r.str_repr, r.n) for r in fingerprints.duplicates(db).collect()] == [("g", 2)]
    [f] = fingerprints.lookup("f", db).collect()
    assert [(p.process, p["count"], p.prevalence) for p in f.process_info] == [("b", 2, 0.67), ("a", 1, 0.33)]
    found = {r.fingerprint: (r.flows, r.process) for r in fingerprints.report(rows.withColumnRenamed("process", "p"), "fp", fingerprints.entries(rows, "fp", "process")).collect()}
    assert found == {"f": (3, "b"), "g": (1, "Unknown")}
