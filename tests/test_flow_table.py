"""The streamed flow table against ``flows.build`` over the same packets."""

import random
import tempfile

import pytest
from flowquery.operators import flows
from flowquery.streaming import flow_table

S = 1_000_000
COLUMNS = "file string, " + flow_table.PACKET


def packets(seed: int, n: int = 400):
    """Conversations with gaps at and about both timers, repeats, several SYNs, ports that are missing, both directions."""
    random.seed(seed)
    rows, now = [], 5 * S
    last: dict = {}
    for i in range(n):
        now += random.choice([0, 1, 1000, 200_000, S, S])
        sp = random.choice([1, 2, 3])
        a, b = ("10.0.0.1", sp), ("10.0.0.2", 80)
        if random.random() < 0.4:
            a, b = b, a
        pr = 17 if sp == 3 else 6
        if random.random() < 0.03:
            now += random.choice([10 * S, 10 * S + 1, 3 * S])
        tcp_seq = None if pr == 17 else random.choice([last.get((a, b), 0), random.randrange(1 << 32)])
        last[a, b] = tcp_seq
        body = random.randbytes(random.choice([0, 0, 5, 60]))
        flags = None if pr == 17 else random.choice([24, 24, 16, 2, 18])
        rows.append(("f", now, i, a[0], b[0], a[1], b[1], pr, random.choice([64, 63, None]), flags, random.randrange(9000), tcp_seq, random.choice([None, b"\2\4"]), body, b"head" + body, random.random() < 0.02))
    rows.append(("f", now, n, "10.0.0.9", "10.0.0.8", None, None, 1, 64, None, None, None, None, b"ping", b"ping", False))
    return rows


def in_order(rows):
    return sorted((tuple(sorted(r.asDict(True).items())) for r in rows), key=repr)


@pytest.mark.parametrize(("seed", "zeros", "count"), [(1, False, 50), (2, True, 3)])
def test_streamed_equals_batch(spark, seed, zeros, count):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    rows = packets(seed)
    table = spark.createDataFrame(rows, COLUMNS)
    expected = in_order(flows.build(table, count=count, zeros=zeros).collect())
    assert {dict(r)["expire_type"] for r in expected} == {"a", "i"} and len(expected) > 10
    shuffled = sorted(range(len(rows)), key=lambda i: rows[i][1] + random.randint(0, 4 * S))  # up to four seconds late
    folder = tempfile.mkdtemp()
    late = [("f", rows[-1][1] + 200 * S + k * S, 10_000 + k, "0.0.0.0", "0.0.0.1", 7, 7, 17, 1, None, None, None, None, b"", b"", False) for k in (0, 400)]
    triggers = [[rows[i] for i in shuffled[at : at + 90]] for at in range(0, len(rows), 90)] + [[x] for x in late]
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, some in enumerate(triggers):
            spark.createDataFrame(some, COLUMNS).coalesce(1).write.parquet(f"{folder}/in/{n:03}")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = flow_table.build(stream, "5 seconds", count=count, zeros=zeros)
        assert sorted(out.columns) == sorted(flows.build(table).columns)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    found = [r for r in spark.read.parquet(f"{folder}/out").collect() if r.sa != "0.0.0.0"]
    assert in_order(found) == expected
