"""Templates that come late, change, expire and are withdrawn, in batches and on streams, and the elements of collectors."""

import random
import tempfile

import pytest
from flowquery.sources import exports
from flowquery.streaming import templates
from pyspark.sql import functions as F

LAYOUTS = [[(7, 2), (11, 2)], [(11, 2), (7, 2)], [(7, 2), (4, 1), (1, 1)], []]
COLUMNS = "exporter string, seq long, payload binary"


def part(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(2) + (len(body) + 4).to_bytes(2) + body


def layout(number: int, fields: list[tuple[int, int]]) -> bytes:
    return number.to_bytes(2) + len(fields).to_bytes(2) + b"".join(k.to_bytes(2) + n.to_bytes(2) for k, n in fields)


def ten(at: int, body: bytes, domain: int = 4) -> bytes:
    return (10).to_bytes(2) + (16 + len(body)).to_bytes(2) + at.to_bytes(4) + bytes(4) + domain.to_bytes(4) + body


def nine(at: int, body: bytes, domain: int = 4) -> bytes:
    return (9).to_bytes(2) + (1).to_bytes(2) + bytes(4) + at.to_bytes(4) + bytes(4) + domain.to_bytes(4) + body


def traffic(seed: int, n: int = 300):
    """Messages of two exporters, and the rows they hold if read one after the other."""
    random.seed(seed)
    messages, expected, known = [], [], {}
    for seq in range(n):
        exporter, at = random.choice("xxxy"), 1000 + seq * 7
        sets = b""
        for place in range(random.randint(1, 3)):
            number = random.choice([256, 257])
            if random.random() < 0.12:
                fields = random.choice(LAYOUTS)
                sets += part(2, layout(number, fields))
                known[exporter, number] = (at, fields)
                continue
            body = random.randbytes(8)
            sets += part(number, body)
            seen, fields = known.get((exporter, number), (0, []))
            if fields and at - seen <= 300:
                for record in range(2):
                    at_byte, values = 4 * record, {}
                    for element, size in fields:
                        values[exports.ELEMENTS[element][0]] = str(int.from_bytes(body[at_byte : at_byte + size]))
                        at_byte += size
                    expected.append((exporter, 4, seq, place, record, False, tuple(sorted(values.items()))))
        messages.append((exporter, seq, ten(at, sets)))
    return messages, sorted(expected)


def plain(rows):
    return sorted((r.exporter, r.domain, r.seq, r.set, r.record, r.options, tuple(sorted(r.fields.items()))) for r in rows)


@pytest.mark.parametrize("block", [1, 16, 1000])
def test_batches_as_of(spark, block):
    messages, expected = traffic(block)
    parts = exports.sets(spark.createDataFrame(random.sample(messages, len(messages)), COLUMNS))
    found = exports.with_templates(parts, 300, block)
    named = found.select("exporter", "domain", "seq", "part", "body", F.col("_template.body").alias("definition"), F.col("_template.version").alias("defined_by"), F.col("_template.scopes").alias("scopes"))
    assert len(expected) > 100 and plain(exports.read_sets(named).collect()) == expected


def test_exporters_are_not_read_as_groups(spark):
    parts = exports.sets(spark.createDataFrame([], COLUMNS))
    plan = exports.with_templates(parts)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and exports.decode(spark.createDataFrame([], COLUMNS)).collect() == []


def streamed(spark, triggers, **settings):
    """The records of messages that come in ``triggers``."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp()
    try:
        for n, some in enumerate(triggers):
            spark.createDataFrame(some, COLUMNS).coalesce(1).write.parquet(f"{folder}/in/{n:03}")
        rows = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = templates.collect(rows, **settings).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return plain(spark.read.parquet(f"{folder}/out").collect())
    finally:
        spark.conf.set(provider, before)


def test_stream_in_order_equals_batch(spark):
    messages, expected = traffic(5, 120)
    assert streamed(spark, [messages[:40], messages[40:41], messages[41:]], expire=300) == expected


def test_late_replaced_and_expired_templates(spark):
    one, two = part(2, layout(256, LAYOUTS[0])), part(2, layout(256, LAYOUTS[1]))
    data = part(256, bytes([0, 1, 0, 2]))
    triggers = [
        [("x", 2, ten(1000, data)), ("x", 9, ten(1001, data))],  # both wait
        [("x", 1, ten(1002, one))],  # comes late, before both
        [("x", 10, ten(1003, two)), ("x", 11, ten(1004, data))],  # replaced
        [("x", 12, ten(1400, data))],  # expired: 397 s without it
        [("x", 13, ten(1401, one + data)), ("y", 1, ten(1402, data))],  # sent again; y waits
        [("x", 14, ten(1600, data))],  # the watermark passes y's wait
        [("y", 0, ten(1601, one)), ("y", 2, ten(1602, data))],  # too late for the one that waited
    ]
    found = [(e, seq, dict(f)["sp"]) for e, _, seq, _, _, _, f in streamed(spark, triggers, expire=300, wait=60)]
    assert found == [("x", 2, "1"), ("x", 9, "1"), ("x", 11, "2"), ("x", 13, "1"), ("x", 14, "1"), ("y", 2, "1")]


def test_withdrawn_options_and_cut_messages(spark):
    scoped = part(3, (300).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + (7).to_bytes(2) + (2).to_bytes(2) + (11).to_bytes(2) + (2).to_bytes(2))
    old_scoped = part(1, (301).to_bytes(2) + (4).to_bytes(2) + (4).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (11).to_bytes(2) + (2).to_bytes(2) + b"\0\0")
    data = bytes([0, 1, 0, 2])
    rows = [
        ("x", 1, ten(1, scoped + part(300, data) + part(2, layout(256, LAYOUTS[0])) + part(256, data))), ("x", 2, ten(2, part(2, layout(256, [])) + part(256, data))),
        ("z", 1, nine(1, old_scoped + part(301, data))), ("z", 2, nine(1, part(301, data))[:-1]), ("z", 3, b""), ("z", 4, None), ("z", 5, b"\0\5abc"),
    ]
    found = exports.decode(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.exporter, r.seq, r.options) for r in sorted(found, key=lambda r: (r.exporter, r.seq, r.options))] == [("x", 1, False), ("x", 1, True), ("z", 1, True)]
    assert exports.flow_fields(exports.decode(spark.createDataFrame(rows, COLUMNS))).count() == 1


def test_packet_lists_are_expanded():
    assert exports.packet_lengths([100, -2, 40, 0, -32768, 7]) == [100, 100, 100, 40, 0]
    assert exports.packet_times([100, -2, 40, -32768], [5, 10, 20, 0]) == [5, 5, 15, 35]
    assert exports.packet_times([1, 2, 3, 4], [5, -3]) == [5, 5, 5, 5]


def test_telemetry_of_both_versions(spark):
    two = lambda values: b"".join(v.to_bytes(2, signed=v < 0) for v in values)
    splt = two([100, -1, 40, -32768]) + two([5, 10, 20, 0])
    records = two([200, 90] + [0] * 18) + two([0, 12] + [0] * 18) + bytes([22, 22] + [0] * 18) + bytes([1, 2] + [0] * 18)
    found = two([4, 9] + [0] * 33) + two([0, 10] + [0] * 33)
    fields = [(44940, 3), (44941, 16), (44944, 512), (44945, len(records)), (44946, 8), (44947, len(found)), (44948, 1), (44949, 2), (44950, 6), (44951, 32)]
    body = b"abc" + splt + two(range(256)) + records + two([0x1301, 0xC02B]) + b"\xff\xff\0\0" + found + b"\3" + two([2048]) + two([2]) + b"ok.." + bytes(range(32))
    old = nine(1, part(0, layout(256, fields)) + part(256, body))

    def listed(element: int, values: bytes) -> bytes:
        inner = b"\3" + (element & 0x7FFF | 0x8000).to_bytes(2) + (2).to_bytes(2) + (9).to_bytes(4) + values
        return bytes([len(inner)]) + inner

    spec = b"".join(k.to_bytes(2) + (0xFFFF).to_bytes(2) for k in (291, 291, 291)) + (44950).to_bytes(2) + (0xFFFF).to_bytes(2) + (9).to_bytes(4)
    new = ten(1, part(2, (256).to_bytes(2) + (4).to_bytes(2) + spec) + part(256, listed(44952, two([70, -1])) + listed(44946, two([0x1302])) + listed(44961, two([0, 43])) + b"\2ok"))
    decoded = exports.decode(spark.createDataFrame([("v9", 1, old), ("v10", 1, new)], COLUMNS))
    rows = {r.exporter: r for r in exports.telemetry(decoded).collect()}
    a, b = rows["v9"], rows["v10"]
    assert bytes(a.idp) == b"abc" and [(p.b, p.ipt) for p in a.packets] == [(100, 5), (100, 10), (40, 20)] and a.byte_dist == list(range(256))
    assert [(r.b, r.ipt, r.tp, r.hs) for r in a.tls.srlt] == [(200, 0, 22, 1), (90, 12, 22, 2)] and a.tls.cs == ["1301", "c02b"]
    assert [(x.kind, x.length) for x in a.tls.c_extensions] == [(0, 4), (10, 9)] and (a.tls.version, a.tls.c_key_length, a.tls.sid, a.tls.c_random) == (3, 2048, b"ok".hex(), bytes(range(32)).hex())
    assert b.tls.cs == ["1302"] and b.tls.sid == b"ok".hex() and b.idp is None
    assert {r.fields.get("splt_lengths") for r in decoded.collect()} == {"100,100,40", "70,70"}
