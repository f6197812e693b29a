"""Options, exports, fingerprints, packet features and streams."""

import pytest
from flowquery import config
from flowquery.functions import matching, policy, scalar
from flowquery.features import fingerprints, tls
from flowquery.operators import packets
from flowquery.sinks import ipfix, model
from flowquery.sources import exports, training
from flowquery.streaming import links, sessions
from pyspark.sql import functions as F

from tests.test_decoders import extension, hello
from tests.test_operators import FLOW


def test_options():
    o = config.parse(["bidir = 1", "# all", "num_pkts=20 # few", 'bpf="tcp port 80"', "tls=1", "dns", "label=a:b", "http=0"])
    assert (o.bidir, o.num_pkts, o.bpf, o.features, o.label) == (True, 20, "tcp port 80", ["tls", "dns"], ["a:b"])
    assert config.echo(o)["features"] == "tls,dns"
    for bad in ("nothing=1", "num_pkts=0", "threads=99", "classify=1", "bidir=x"):
        with pytest.raises(ValueError, match=r"."):
            config.parse([bad])


@pytest.mark.parametrize("payload", [False, True])
def test_ipfix_round_trip(spark, payload):
    rows = [(i, "10.0.0.1", "10.0.0.2", i, 80, 6, 1, 1, 5_000, 9_000) for i in range(120)] + [(999, "::1", "::2", 1, 1, 6, 1, 1, 0, 0)]
    flows = spark.createDataFrame(rows, FLOW).withColumn("idp", F.encode(F.lit("ab" * 140), "UTF-8"))
    sent = ipfix.encode(flows, payload, 0)
    assert sent.agg(F.max(F.octet_length("message"))).first()[0] < 2000
    read = exports.decode(sent.select(F.col("domain").cast("string").alias("exporter"), F.col("sequence").alias("seq"), F.col("message").alias("payload")))
    found = exports.flow_fields(read).select("sa", "da", "sp", "dp", "pr", "start_ms", "end_ms").collect()
    assert sorted(map(tuple, found)) == sorted((r[1], r[2], r[3], r[4], r[5], r[8] // 1000, r[9] // 1000) for r in rows)
    if payload:
        assert {f["e9.12000"] for f in (r.fields for r in read.collect())} == {b"ab".hex() * 140}


def test_fingerprints(spark):
    found = extension(0x1A1A, b"") + extension(10, b"\0\2\0\x1d") + extension(16, b"\0\3\2h2") + extension(43, b"\2\3\4") + extension(51, b"\0\5\0\x1d\0\1x") + extension(13, b"\0\2\4\3")
    record = hello(1, b"\3\3" + bytes(32) + b"\0" + b"\0\4\x2a\x2a\xc0\x2b" + b"\1\0" + len(found).to_bytes(2) + found)
    out = fingerprints.described(record)
    assert out["fingerprint"] == tls.stream(record)["fingerprint"]
    assert [(x["name"], x["values"]) for x in out["extensions"]][1:] == [
        ("supported_groups", ["x25519"]), ("application_layer_protocol_negotiation", ["h2"]), ("supported_versions", ["TLS 1.3"]), ("key_share", ["x25519"]),
        ("signature_algorithms", ["ecdsa_secp256r1_sha256"]),
    ]
    digits = "0303" + "0004" + "2a2ac02b" + "000c" + "1a1a" + "000a" + "0004" + "0002001d" + "0017"
    assert fingerprints.structured(digits) == "(0303)(0a0ac02b)((0a0a)(000a00040002001d)(0017))"
    assert fingerprints.of_syn(bytes.fromhex("020405b40103030704020000")) == "(020405b4)(01)(030307)(04)"
    df = spark.createDataFrame([(record,), (b"GET",), (None,)], "p binary")
    assert [r[0] is None for r in df.select(fingerprints.payload(F.col("p"))).collect()] == [False, True, True]


PACKETS = "seq long, ts_us long, sa string, da string, sp int, dp int, pr int, tcp_seq long, ack long, flags int, opts binary, payload binary"


def test_packet_features(spark):
    out, back = ("a", "b", 1, 2, 6), ("b", "a", 2, 1, 6)
    rows = [(1, 0, *out, 100, 0, 2, b"", b""), (2, 1000, *back, 500, 101, 18, b"", b""), (3, 3000, *out, 101, 501, 24, b"", b"\x01\x05"), (4, 4000, *out, 103, 501, 24, b"", b"\x02\x05x"), (5, 9000, *out, 110, 510, 24, b"", b"\x03\x0d")]
    df = spark.createDataFrame(rows, PACKETS)
    found = [(r.dir, r.flags, r.t, r.rseq, r.rack) for r in packets.packet_information(df).orderBy("place").collect()]
    assert found == [(">", "S", 0, 0, 0), ("<", "SA", 1, 0, 1), (">", "PA", 3, 1, 1), (">", "PA", 4, 2, 1), (">", "PA", 9, 7, 10)]
    assert sorted((r.message, r.length, r.last) for r in packets.messages(df).collect()) == [(1, 5, 4000), (2, 2, 9000)]
    masks = {r.pos: (r.constant, r.value, r.sequence) for r in packets.header_masks(df).collect()}
    assert masks[0][2] and masks[1] == (255 ^ 8, 5, False) and set(masks) == {0, 1}
    assert packets.padded_lists(spark.createDataFrame([([1, 2],)], "x array<int>"), "x", 4, -32768).first()[0] == [1, 2, -32768, -32768]


def test_labelled_folders(spark, tmp_path):
    for name, text in (("p", '{"dp":1}\n{"version":1}\n'), ("n", '{"dp":2}\nbad\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(text)
    found = training.read(spark, str(tmp_path / "p"), str(tmp_path / "n")).select(F.variant_get("record", "$.dp", "int"), "label").collect()
    assert sorted(map(tuple, found)) == [(1, 1.0), (2, 0.0)]


def _stream(spark, frame, tmp_path, name):
    """A table as a stream of one file for each part of it."""
    path = str(tmp_path / name)
    for part in frame:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(found, mode, tmp_path, name):
    rows = []
    q = found.writeStream.outputMode(mode).foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows


def test_links_over_triggers(spark, tmp_path):
    parts = [[("x", 1, False), ("x", 2, True), ("x", 3, False)], [("x", 5, False), ("x", 6, True), ("y", 7, False)]]
    stream = _stream(spark, [spark.createDataFrame(p, "address string, seq long, answer boolean") for p in parts], tmp_path, "in")
    found = _run(links.last_answers(stream), "append", tmp_path, "log")
    assert sorted((r.address, r.seq, r.link) for r in found) == [("x", 1, None), ("x", 3, 2), ("x", 5, 2), ("y", 7, None)]


def test_sessions_over_triggers(spark, tmp_path):
    s = 1_000_000
    zero = 1000 * s
    parts = [[(1, 0), (1, 5 * s), (2, 3 * s)], [(1, 14 * s), (1, 33 * s), (2, 60 * s)]]
    frames = [spark.createDataFrame([(k, zero + t) for k, t in p], "k long, t long").withColumn("ts", F.timestamp_micros("t")) for p in parts]
    rows = _stream(spark, frames, tmp_path, "in").withWatermark("ts", "0 seconds")
    found = _run(sessions.sessionize(rows, "k", "t", 10 * s, 30 * s), "update", tmp_path, "log")
    latest = {}
    for r in found:
        latest[r.k, r.start - zero] = max(latest.get((r.k, r.start - zero), (0, 0)), (r.n, r.end))
    assert {k: v[0] for k, v in latest.items()} == {(1, 0): 3, (1, 33 * s): 1, (2, 3 * s): 1, (2, 60 * s): 1}


POLICY = """{"classification": {"avoid": 1, "legacy": 2, "acceptable": 3, "recommended": 4}, "rules": {
  "kex": {"RSA": {"default": 3, "client_key_length": {"operator": "<", "thresholds": {"1024": 1, "2048": 2}}}}, "enc": {"AES": 4, "RC4": 1}, "hash": {"SHA": 2},
  "cert_sig_alg": {"sha256": {"default": 4, "sig_key_size": {"operator": "<=", "thresholds": {"1024": 2}}}}}}"""


def test_tls_security(spark):
    rules = policy.Policy.from_json(POLICY)
    suite = "suite struct<kex:string,sig:string,enc:string,auth:string,hash:string>, n int, certs array<struct<signature_algo:string,signature_key_size:int,issuer:string>>"
    rows = [(("RSA", "RSA", "AES", "RSA", "X"), 4112, [("sha256", 2048, "Org")]), (("RSA", "RSA", "RC4", "RSA", "SHA"), 1040, [("sha256", 1024, "Bad")]), (None, None, None)]
    df = spark.createDataFrame(rows, suite)
    made = lambda how: [tuple(r[0]) for r in df.select(policy.tls_security(rules, F.col("suite"), F.col("n"), F.col("certs"), 2, how, ["Org"])).collect()]
    assert made("ignore")[0] == ("acceptable", ["hash - X"]) and made("report")[0][0] == "unknown"
    assert made("report")[1] == ("avoid", ["cert_sig_alg - sha256 sig_key_size 1024 in cert 0", "CA not trusted: Bad", "kex - RSA client_key_length 1024", "enc - RC4", "hash - SHA"])
    assert made("report")[2] == ("unknown", ["no certs data"])


def test_many_patterns(spark):
    df = spark.createDataFrame([("ushers",), ("",), (None,), ("hehe",)], "t string")
    found = [[(m.start, m.stop, m.pattern) for m in r[0]] for r in df.select(matching.find_all(F.col("t"), ["he", "she", "his", "hers"])).collect()]
    assert found == [[(1, 3, "she"), (2, 5, "hers")], [], [], [(0, 1, "he"), (2, 3, "he")]]


def test_parameters_round_trip(spark, tmp_path):
    model.write(spark, [0.1, -2.0, 3e-9], str(tmp_path / "m"))
    assert model.read(spark, str(tmp_path / "m")) == [0.1, -2.0, 3e-9]


def test_proposals(spark):
    df = spark.createDataFrame([([1, 2, 3], [2]), ([1], [1, 4]), ([1], [])], "i array<int>, r array<int>")
    assert [x[0] for x in df.select(scalar.proposals_agree(F.col("i"), F.col("r"))).collect()] == [True, False, True]
