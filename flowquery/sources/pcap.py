"""Packet captures as a table, or as a stream of growing files.

A capture has no marks between its records, so a task that reads a range of bytes first looks for a border: from ``BACK`` bytes before its
range it follows every place whose header is plausible, header by header, up to the range. A wrong start inside a record either ends in an
implausible header at that record's end or meets the true border there; where most of the chains that arrive agree is the border. If none
arrives, the file is walked from its start. A range owns the records that end in it, so ranges of any size give the rows of one
pass, and a stream's next range begins with the record that was not complete.

Files are found through Spark's file systems and read by pyarrow's; where pyarrow does not know a store, Spark reads each file as one row (2 GB at most).
"""

from __future__ import annotations

import json
import struct
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from flowquery.features import frames

# The magic numbers of capture files, with byte order and units of a fraction of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
HEAD, RECORD_HEAD = 24, 16
SCHEMA = "file string, seq long, ts_us long, caplen long, len long, frame binary"
ARROW = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("ts_us", pa.int64()), ("caplen", pa.int64()), ("len", pa.int64()), ("frame", pa.binary())])
BATCH = 2000
RANGE, BACK, CHUNK = 64 << 20, 1 << 20, 1 << 22
#: Bytes of a captured frame, bytes on the wire, and seconds from the file's first packet that a plausible header has at most.
MOST_BYTES, MOST_WIRE, MOST_SECONDS = 1 << 18, 1 << 24, 400 * 86_400
STORES = {"", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss"}


def opened(path: str):
    """The file as a random-access stream."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(parts.path)
    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


def kind_of(head: bytes, path: str) -> tuple[str, int]:
    """Byte order and units; what is no capture is refused."""
    if head[:4] not in MAGIC:
        raise ValueError(f"{path} is no packet capture that can be read: it begins with {head[:4].hex() or 'nothing'}" + " (pcapng)" * (head[:4] == b"\x0a\x0d\x0d\x0a"))
    return MAGIC[head[:4]]


def walked(file, at: int, end: int, order: str, units: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(place, time in microseconds, captured and whole length, bytes) of the records from ``at`` on that are whole by ``end``."""
    head, held, begin = struct.Struct(order + "IIII"), b"", at
    while True:
        while at + RECORD_HEAD > begin + len(held) or at + RECORD_HEAD + head.unpack_from(held, at - begin)[2] > begin + len(held):
            need = CHUNK if at + RECORD_HEAD > begin + len(held) else max(CHUNK, RECORD_HEAD + head.unpack_from(held, at - begin)[2])
            held, begin = held[at - begin :], at
            more = file.read_at(min(need, end - begin - len(held)), begin + len(held)) if end > begin + len(held) else b""
            if not more:
                return
            held += more
        seconds, part, size, whole = head.unpack_from(held, at - begin)
        yield at, seconds * 1_000_000 + part // units, size, whole, held[at - begin + RECORD_HEAD : at - begin + RECORD_HEAD + size]
        at += RECORD_HEAD + size


def border(file, begin: int, order: str, units: int, back: int = BACK) -> int:
    """Where the record that reaches ``begin`` starts, as most chains of plausible headers have it; the first record if no chain arrives. ``back``: some times MOST_BYTES."""
    low = max(HEAD, begin - back)
    first = file.read_at(4, HEAD)
    if low == HEAD or len(first) < 4:
        return HEAD
    data = np.frombuffer(file.read_at(begin - low + RECORD_HEAD, low), np.uint8).astype(np.int64)
    n = len(data) - RECORD_HEAD + 1
    if n < 1:
        return HEAD
    places = range(4) if order == "<" else range(3, -1, -1)
    number = lambda at: sum(data[at + k : at + k + n] << (8 * shift) for shift, k in zip(range(4), places, strict=True))
    seconds, part, size, whole = map(number, (0, 4, 8, 12))
    start = int.from_bytes(first, "little" if order == "<" else "big")
    good = (np.abs(seconds - start) <= MOST_SECONDS) & (part < 1_000_000 * units) & (size > 0) & (size <= np.minimum(whole, MOST_BYTES)) & (whole <= MOST_WIRE)
    follow = np.arange(n) + RECORD_HEAD + size
    ends: dict[int, int] = {}  # by place: the last place of its chain before ``begin``, or -1
    votes: Counter = Counter()
    for at in np.flatnonzero(good[: min(n, MOST_BYTES + RECORD_HEAD)]).tolist():
        chain, here = [], at
        while here < n and good[here] and here not in ends and follow[here] < begin - low:
            chain.append(here)
            here = int(follow[here])
        last = ends.get(here, here if here < n and good[here] else -1)
        ends |= dict.fromkeys([*chain, here], last)
        votes[last] += last >= 0
    best = max(votes, key=lambda x: (votes[x], -x), default=-1)
    return low + best if votes[best] else HEAD


def ranged(file, path: str, begin: int, end: int) -> Iterator[tuple]:
    """Rows (file, seq, ts_us, caplen, len, frame) of the records that end in (begin, end]; ``seq`` is where a record starts."""
    head = file.read_at(HEAD, 0)
    if len(head) < HEAD and head[:4] in (*MAGIC, b""):
        return
    order, units = kind_of(head, path)
    for at, ts, size, whole, frame in walked(file, border(file, begin, order, units), end, order, units):
        if at + RECORD_HEAD + size > begin:
            yield path, at, ts, size, whole, frame


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


class Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def parts_of(path: str, begin: int, end: int, size: int) -> list[Part]:
    return [Part(path, at, min(at + size, end)) for at in range(begin, end, size)]


class _Reads:
    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as file:
            yield from batches_of(ranged(file, partition.path, partition.begin, partition.end))


class CaptureReader(_Reads, DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], size: int):
        self.files, self.size = files, size

    def partitions(self) -> list[Part]:
        return [p for path, length in self.files for p in parts_of(path, 0, length, self.size)]


class CaptureStreamReader(_Reads, DataSourceStreamReader):
    """Offsets: how many bytes of each file were read."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        from pyarrow import fs

        local = urlsplit(self.folder)
        store, inner = (fs.LocalFileSystem(), local.path) if local.scheme in ("", "file") else fs.FileSystem.from_uri(self.folder.replace("s3a://", "s3://", 1))
        found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return {f"{self.folder.rstrip('/')}/{x.base_name}": x.size for x in found if x.is_file and not x.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [p for path, length in sorted(end.items()) for p in parts_of(path, start.get(path, 0), length, self.size)]

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """``files``: (path, bytes) of what to read, as JSON; or, for a stream, ``folder``. ``range``: bytes a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "flow_capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader([tuple(x) for x in json.loads(self.options["files"])], int(self.options.get("range", RANGE)))

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(self.options["folder"], int(self.options.get("range", RANGE)))


def found_files(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that ``paths`` (files, folders, patterns) name, in any store that Spark reaches."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(conf)
        matches = store.globStatus(where)
        if not matches:
            raise FileNotFoundError(path)
        for match in matches:
            for f in store.listStatus(match.getPath()):
                if not f.isDirectory() and not f.getPath().getName().startswith((".", "_")):
                    out.append((f.getPath().toString(), f.getLen()))
    return out


def first_bytes(spark: SparkSession, path: str, n: int = 4) -> bytes:
    """The first bytes of a file; nothing more of it is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def records(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Place, time in microseconds, captured and whole length, and bytes of each packet; a cut last packet ends the file."""
    yield from walked(pa.BufferReader(data), HEAD, len(data), *kind_of(data, "this"))


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from batches_of(ranged(pa.BufferReader(content.as_buffer()), path, 0, content.as_buffer().size))

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(split, SCHEMA)


def read(spark: SparkSession, *paths: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, seq, ts_us, caplen, len, frame) of the packets of capture files, a task a range of ``range_bytes``."""
    files = found_files(spark, *paths)
    known = [(path, size) for path, size in files if urlsplit(path).scheme in STORES]
    spark.dataSource.register(CaptureSource)
    out = spark.read.format("flow_capture").option("files", json.dumps(known)).option("range", range_bytes).load()
    others = [path for path, _ in files if urlsplit(path).scheme not in STORES]
    if others:
        out = _whole(spark, others) if not known else out.union(_whole(spark, others))
    return out


def stream(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """The same of a folder's captures as they grow; what was read is kept in the query's checkpoint."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("flow_capture").option("folder", folder).option("range", range_bytes).load()


def packets(captured: DataFrame) -> DataFrame:
    """The decoded packets: addresses, ports, protocol, TCP fields and payload. What is no IP packet goes."""
    decoded = captured.withColumn("p", frames.decode(F.col("frame"))).where("p IS NOT NULL")
    return decoded.select("file", "seq", F.col("ts_us"), "caplen", "len", *(F.col(f"p.{n}").alias({"seq": "tcp_seq"}.get(n, n)) for n in decoded.schema["p"].dataType.names))


def bpf(expression: str) -> Column:
    """A small part of the packet filter language: tcp, udp, icmp, port N, src/dst port N, host A, net C, and, or, not, parentheses."""
    words = expression.lower().replace("(", " ( ").replace(")", " ) ").split()
    column, at = _or(words, 0)
    if at != len(words):
        raise ValueError(f"unexpected {words[at]!r} in {expression!r}")
    return column


def _or(words: list[str], at: int) -> tuple[Column, int]:
    out, at = _and(words, at)
    while at < len(words) and words[at] in ("or", "||"):
        more, at = _and(words, at + 1)
        out = out | more
    return out, at


def _and(words: list[str], at: int) -> tuple[Column, int]:
    out, at = _term(words, at)
    while at < len(words) and words[at] in ("and", "&&"):
        more, at = _term(words, at + 1)
        out = out & more
    return out, at


def _term(words: list[str], at: int) -> tuple[Column, int]:
    from flowquery.functions.scalar import in_subnet

    protocols = {"tcp": (6,), "udp": (17,), "icmp": (1, 58), "ip": None}
    side = None
    word = words[at] if at < len(words) else ""
    if word in ("not", "!"):
        out, at = _term(words, at + 1)
        return ~out, at
    if word == "(":
        out, at = _or(words, at + 1)
        if at >= len(words) or words[at] != ")":
            raise ValueError("a parenthesis is not closed")
        return out, at + 1
    if word in protocols:
        kinds = protocols[word]
        return (F.lit(True) if kinds is None else F.col("pr").isin(*kinds)), at + 1
    if word in ("src", "dst"):
        side, at = word, at + 1
        word = words[at] if at < len(words) else ""
    if word not in ("port", "host", "net") or at + 1 >= len(words):
        raise ValueError(f"not a filter: {' '.join(words[at:])!r}")
    value = words[at + 1]
    if word == "port":
        ends = [F.coalesce(F.col(c) == int(value), F.lit(False)) for c in ("sp", "dp")]
    elif word == "host":
        ends = [F.col(c) == value for c in ("sa", "da")]
    else:
        network, _, bits = value.partition("/")
        ends = [in_subnet(F.col(c), network, int(bits or 32)) for c in ("sa", "da")]
    return (ends[0] | ends[1] if side is None else ends[side == "dst"]), at + 2
