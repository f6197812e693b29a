"""Captures read in ranges, and as they grow, give the rows of one pass."""

import io
import random
import struct
import tempfile

import pyarrow as pa
import pytest
from flowquery.sources import pcap

from tests.test_operators import capture as written


def one_pass(data: bytes) -> list[tuple]:
    """Record after record, from the file's format."""
    order, units = pcap.MAGIC[data[:4]]
    file, out = io.BytesIO(data), []
    file.seek(24)
    while True:
        at = file.tell()
        head = file.read(16)
        if len(head) < 16:
            return out
        seconds, part, size, whole = struct.unpack(order + "IIII", head)
        frame = file.read(size)
        if len(frame) < size:
            return out
        out.append((at, seconds * 1_000_000 + part // units, size, whole, frame))


def made(seed: int, n: int = 400, magic: bytes = b"\xd4\xc3\xb2\xa1") -> bytes:
    """Frames of all sizes; some hold a capture themselves, whose last record may end where the frame ends."""
    random.seed(seed)
    order, units = pcap.MAGIC[magic]
    head = lambda t, body: struct.pack(order + "IIII", 1_600_000_000 + t, random.randrange(1_000_000 * units), len(body), len(body) + random.choice([0, 40])) + body
    out = magic + bytes(20)
    for i in range(n):
        body = random.randbytes(random.choice([1, 60, 1500, 9000]))
        if random.random() < 0.3:
            body = random.randbytes(20) + b"".join(head(i, random.randbytes(random.randint(1, 90))) for _ in range(12))
        out += head(i, body)
    return out + head(n, bytes(500))[: random.choice([3, 16, 300])]


@pytest.mark.parametrize("magic", list(pcap.MAGIC))
def test_any_ranges_give_one_pass(magic, monkeypatch):
    monkeypatch.setattr(pcap, "MOST_BYTES", 10_000)
    data = made(len(magic) + magic[0], magic=magic)
    file, whole = pa.BufferReader(data), one_pass(data)
    for size in (700, 50_000, 1 << 20):
        for back in (25_000, pcap.BACK):
            monkeypatch.setattr(pcap, "border", lambda f, begin, o, u, back=back, found=pcap.border: found(f, begin, o, u, back))
            found = [r[1:] for at in range(0, len(data), size) for r in pcap.ranged(file, "x", at, min(at + size, len(data)))]
            assert found == whole
            monkeypatch.undo()
            monkeypatch.setattr(pcap, "MOST_BYTES", 10_000)


def test_implausible_headers_are_walked(monkeypatch):
    """A time far from the first one breaks the chain; then the file is walked from its start."""
    data = written([(i * 1_000_000, b"x" * 100) for i in range(200)] + [(4_000_000_000 * 1_000_000, b"y" * 100)] + [(i, b"z") for i in range(50)])
    file = pa.BufferReader(data)
    monkeypatch.setattr(pcap, "MOST_BYTES", 900)
    assert pcap.border(file, len(data) - 200, "<", 1, 3000) == pcap.HEAD
    assert [r[1:] for at in range(0, len(data), 999) for r in pcap.ranged(file, "x", at, min(at + 999, len(data)))] == one_pass(data)


def test_read_in_tasks(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.cap").write_bytes(made(n, 3000))
    frame = pcap.read(spark, str(tmp_path), range_bytes=1 << 20)
    assert frame.rdd.getNumPartitions() > 4 and "binaryFile" not in frame._jdf.queryExecution().toString()
    expected = [(f"file:{tmp_path}/{n}.cap", *r) for n in range(2) for r in one_pass((tmp_path / f"{n}.cap").read_bytes())]
    assert sorted((r.file, r.seq, r.ts_us, r.caplen, r.len, bytes(r.frame)) for r in frame.collect()) == expected


def test_what_is_no_capture_is_refused(spark, tmp_path):
    (tmp_path / "x.pcapng").write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(100))
    with pytest.raises(Exception, match="pcapng"):
        pcap.read(spark, str(tmp_path / "x.pcapng")).collect()
    with pytest.raises(FileNotFoundError):
        pcap.read(spark, str(tmp_path / "none*"))


def test_growing_captures(spark, tmp_path):
    """Each start of the stream reads on; records that were cut come when they are whole."""
    data, folder = made(7, 300), tmp_path / "in"
    folder.mkdir()
    log, out = tempfile.mkdtemp(), str(tmp_path / "out")
    for upto in (10, 5000, 5001, len(data) // 2, len(data)):
        (folder / "a.cap").write_bytes(data[:upto])
        query = pcap.stream(spark, str(folder), 100_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.seq, r.ts_us, r.caplen, r.len, bytes(r.frame)) for r in spark.read.parquet(out).collect()) == one_pass(data)
