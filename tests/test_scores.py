"""Flow vectors and scores, cell by cell against plain loops."""

import math
import random

import pytest
from flowquery import capture, config
from flowquery.ml import features
from pyspark.sql import functions as F

RECORD = "dp int, sp int, pi long, po long, bi long, bo long, packets array<struct<b:bigint,dir:string,ipt:bigint>>, counts array<bigint>"


def chain(values, width):
    states = [min(int(v // width), 9) for v in values]
    cells = [[0.0] * 10 for _ in range(10)]
    for a, b in zip(states, states[1:], strict=False) if len(states) > 1 else [(s, s) for s in states]:
        cells[a][b] += 1
    return [x / sum(row) if sum(row) else 0.0 for row in cells for x in row]


def plain_vector(r):
    listed = [(p[0] or 0, p[2] or 0) for p in r[6] or []]
    head = [float(x or 0) for x in (r[0], r[1], r[2], r[3], r[4], r[5])] + [float(sum(g for _, g in listed))]
    return head + chain([b for b, _ in listed], 150) + chain([g for _, g in listed], 50)


def records():
    rng = random.Random(3)
    made = []
    for n in (0, 1, 2, 3, 50, 200):
        packets = [(rng.choice([0, 149, 150, 1349, 1350, 9000, None]), "<>"[i % 2], rng.choice([0, 49, 50, 450, 70_000, None])) for i in range(n)]
        made.append((443, 50_000, n // 2, n, 40 * n, 60 * n, packets, [n % 3] * 256))
    return [*made, (None, None, None, None, None, None, None, None), (80, 1, None, 2, None, 101, [], None), (80, 1, None, 2, None, 100, [], [1] * 256), (80, 1, 0, 2, 0, 101, [], [1] * 256), made[-1]]


def columns():
    return [F.col(c) for c in ("packets", "dp", "sp", "pi", "po", "bi", "bo")]


def test_vectors_and_scores(spark):
    rows = records()
    df = spark.createDataFrame(rows, RECORD).coalesce(1)
    shares = features.byte_shares(F.col("counts"), F.col("bi"), F.col("bo"))
    rng = random.Random(5)
    plain, with_bytes = ([rng.uniform(-1, 1) * (1e-5 if 0 < i < 8 else 1) for i in range(n)] for n in (208, 464))
    found = df.select(features.flow_vector(*columns()).alias("v"), shares.alias("s"), "counts", "bi", "bo").withColumn("p", features.p_malware(F.col("v"), F.col("s"), plain, with_bytes)).collect()
    for r, row in zip(rows, found, strict=True):
        v = plain_vector(r)
        assert len(v) == 207 and row.v == pytest.approx(v)
        total = (r[4] or 0) + (r[5] or 0)
        seen = total > 100 and r[7] is not None
        assert (row.s is not None) == seen
        whole, w = (v + [n / total for n in r[7]], with_bytes) if seen else (v, plain)
        z = w[0] + sum(a * b for a, b in zip(whole, w[1:], strict=True))
        assert row.p == pytest.approx(1 / (1 + math.exp(-z)))
    assert df.limit(0).select(features.flow_vector(*columns())).collect() == []


def test_models_of_another_width_are_refused():
    for bad in (([0.0] * 207, None), ([0.0] * 208, [0.0] * 463)):
        with pytest.raises(ValueError, match="weights"):
            features.p_malware(F.lit(None), F.lit(None), *bad)


def test_captures_are_scored(spark, tmp_path):
    """A request of 60 bytes and an answer of 80: with the counters of both sides over 100 bytes, so the second model speaks; a short flow, or no counters, leave it to the first."""
    (tmp_path / "plain").write_text("\n".join(["-2.0"] + ["0"] * 207))
    byte = 8 + 200 + ord("a")
    (tmp_path / "bytes").write_text("\n".join(repr(1.0 if i == 0 else 14.0 if i == byte else 0.0) for i in range(464)))
    schema = "sa string, da string, sp int, dp int, pr int, ts_us long, seq long, payload binary, packet binary, flags int, ttl int, win int, tcp_seq long, invalid boolean"
    one = ("10.0.0.1", "10.0.0.2", 5000, 80, 17)
    other = ("10.0.0.2", "10.0.0.1", 80, 5000, 17)
    rest = (None, 64, None, None, False)
    packets = [(*one, 0, 0, b"a" * 30 + b"b" * 30, b"", *rest), (*other, 1000, 1, b"a" * 40 + b"c" * 40, b"", *rest), ("1.1.1.1", "2.2.2.2", 1, 2, 17, 0, 2, b"a", b"", *rest)]
    df = spark.createDataFrame(packets, schema)

    def scores(*words):
        return {r.sa: r.p_malware for r in capture.from_packets(df, config.parse([f"model={tmp_path}/plain", f"model_bytes={tmp_path}/bytes", *words])).select("sa", "p_malware").collect()}

    low, high = 1 / (1 + math.exp(2)), 1 / (1 + math.exp(-(1 + 14 * 70 / 140)))
    assert scores("bidir=1", "dist=1") == pytest.approx({"10.0.0.1": high, "1.1.1.1": low})
    assert scores("bidir=1") == pytest.approx({"10.0.0.1": low, "1.1.1.1": low})
    assert scores("dist=1") == pytest.approx({"10.0.0.1": low, "10.0.0.2": low, "1.1.1.1": low})
    (tmp_path / "numbers").write_text("17\tUDP\n")
    assert {r.protocol for r in capture.from_packets(df, config.parse([f"protocols={tmp_path}/numbers"])).collect()} == {"UDP"}
