"""NetFlow version 9 and IPFIX messages as rows of fields.

A data set makes sense by the template that its exporter sent last before it. Messages are cut into sets where they lie;
each data set then gets its template by an as-of join over (exporter, domain, template), and is decoded by itself. The join
carries templates from block to block of ``BLOCK`` messages, so a busy exporter's blocks are settled apart, and nothing is read
one message after the other.

``seq`` is the number of a message in its exporter's order. A template that was not sent again for ``EXPIRE`` seconds of the messages' own time is forgotten;
one without fields withdraws what had its number.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquery.features import Reader

# Information elements by number, with how they are written. From 0x8000 on those of enterprise 9, which version 9 writes with their whole numbers.
ELEMENTS = {
    1: ("bytes_out", "number"), 2: ("num_pkts_out", "number"), 4: ("pr", "number"), 6: ("tcp_flags", "number"), 7: ("sp", "number"), 8: ("sa", "address"),
    11: ("dp", "number"), 12: ("da", "address"), 21: ("last_switched", "number"), 22: ("first_switched", "number"), 27: ("sa", "address"), 28: ("da", "address"),
    152: ("start_ms", "number"), 153: ("end_ms", "number"), 291: ("list", "basic_list"),
    44940: ("idp", "hex"), 44941: ("splt", "splt"), 44944: ("byte_dist", "cells"), 44945: ("tls_records", "tls_records"), 44946: ("tls_cs", "codes"), 44947: ("tls_ext", "tls_extensions"),
    44948: ("tls_version", "number"), 44949: ("tls_key_length", "number"), 44950: ("tls_sid", "counted"), 44951: ("tls_random", "hex"), 44952: ("splt_lengths", "lengths"), 44953: ("splt_times", "numbers"),
    44956: ("tls_lengths", "numbers"), 44957: ("tls_times", "numbers"), 44958: ("tls_types", "numbers"), 44959: ("tls_handshakes", "numbers"), 44960: ("tls_ext_lengths", "numbers"), 44961: ("tls_ext_types", "numbers"),
}
ENTERPRISE, ENTERPRISE_BIT, VARIABLE = 9, 0x8000, 0xFFFF
#: The end of a list of packet lengths, of suites, and how many TLS records and extensions version 9 has room for.
NO_LENGTH, NO_SUITE, TLS_RECORDS, TLS_EXTENSIONS = -32768, 0xFFFF, 20, 35
EXPIRE = 1800
BLOCK = 50_000
SETS = "exporter string, domain long, seq long, part int, at long, version int, template int, scopes int, defines boolean, body binary"
SCHEMA = "exporter string, domain long, seq long, set int, record int, options boolean, fields map<string,string>"


def sets_of(data: bytes) -> Iterator[tuple[int, int, int, int, int, bool, bytes]]:
    """(domain, time, version, template, scopes, defines, body) of a message's data sets and template definitions, in order; a cut message ends where it is cut.

    ``scopes``: of an options template, the number of fields that say what its records are about, else -1.
    """
    r = Reader(data)
    version = r.number(2)
    if version == 9:
        r.take(6)
        at, _, domain = r.number(4), r.take(4), r.number(4)
        templates, options = 0, 1
    elif version == 10:
        r = Reader(data, 2, int.from_bytes(data[2:4]))
        r.take(2)
        at, _, domain = r.number(4), r.take(4), r.number(4)
        templates, options = 2, 3
    else:
        return
    while r:
        kind = r.number(2)
        body = Reader(r.take(r.number(2) - 4))
        if kind >= 256:
            yield domain, at, version, kind, -1, False, body.data
        elif kind in (templates, options):
            for number, scopes, fields in definitions(body, version, kind == options):
                yield domain, at, version, number, scopes, True, fields


def definitions(r: Reader, version: int, options: bool) -> Iterator[tuple[int, int, bytes]]:
    """(template, scopes, fields) of a template set; what is left at its end, shorter than a head, is padding."""
    while r.at + (6 if options and version == 9 else 4) <= r.end:
        number, count, scopes = r.number(2), r.number(2), -1
        if options and version == 9:  # two lengths in bytes
            scopes, count = count // 4, count // 4 + r.number(2) // 4
        elif options and count:
            scopes = r.number(2)
        if number < 256:
            return
        begin = r.at
        for _ in range(count):
            element, _ = r.number(2), r.take(2)
            if version == 10 and element & ENTERPRISE_BIT:
                r.take(4)
        yield number, scopes, r.data[begin : r.at]


def fields_of(definition: bytes, version: int) -> list[tuple[int, int, int]]:
    """(element, length, enterprise) of each field."""
    r, out = Reader(definition), []
    while r:
        element, size, enterprise = r.number(2), r.number(2), 0
        if version == 10 and element & ENTERPRISE_BIT:
            element, enterprise = element & ~ENTERPRISE_BIT, r.number(4)
        out.append((element, size, enterprise))
    return out


def numbers(raw: bytes, size: int, signed: bool = False) -> list[int]:
    return [int.from_bytes(raw[i : i + size], signed=signed) for i in range(0, len(raw) - size + 1, size)] if size else []


def packet_lengths(codes: list[int]) -> list[int]:
    """A negative code repeats the length before it so many times."""
    out: list[int] = []
    for x in codes[: codes.index(NO_LENGTH)] if NO_LENGTH in codes else codes:
        out += [x] if x >= 0 else out[-1:] * -x
    return out


def packet_times(lengths: list[int], gaps: list[int]) -> list[int]:
    """Milliseconds since the flow's start, a packet each: repeated lengths but the last come at the time before, a negative gap repeats a time."""
    out, now = [], 0
    for length, gap in zip(lengths, gaps, strict=False):
        if length == NO_LENGTH:
            break
        out += [now] * max(0, -length - 1)
        now += max(0, gap)
        out += [now] * (1 if gap >= 0 else -gap)
    return out[: len(packet_lengths(lengths))]


def read_value(name: str, form: str, raw: bytes) -> dict[str, str]:
    """A field as text by name; numbers of a list are joined by commas, and some fields hold several lists."""
    join = lambda values: ",".join(map(str, values))
    if form == "number":
        return {name: str(int.from_bytes(raw))}
    if form == "address" and len(raw) in (4, 16):
        return {name: str(ipaddress.ip_address(raw))}
    if form == "counted":  # the length may stand before
        return {name: (raw[2 : 2 + int.from_bytes(raw[:2])] if len(raw) > 2 and int.from_bytes(raw[:2]) <= len(raw) - 2 else raw).hex()}
    if form == "cells":
        return {name: join(numbers(raw, len(raw) // 256)[:256])}
    if form == "codes":
        codes = numbers(raw, 2)
        return {name: join(codes[: codes.index(NO_SUITE)] if NO_SUITE in codes else codes)}
    if form == "splt":
        half = len(raw) // 4 * 2
        lengths, gaps = numbers(raw[:half], 2, True), numbers(raw[half : 2 * half], 2, True)
        return {"splt_lengths": join(packet_lengths(lengths)), "splt_times": join(packet_times(lengths, gaps))}
    if form == "tls_records":
        n, lengths = TLS_RECORDS, numbers(raw[: 2 * TLS_RECORDS], 2)
        used = lengths.index(0) if 0 in lengths else len(lengths)
        lists = {"tls_lengths": lengths, "tls_times": numbers(raw[2 * n : 4 * n], 2), "tls_types": list(raw[4 * n : 5 * n]), "tls_handshakes": list(raw[5 * n : 6 * n])}
        return {k: join(v[:used]) for k, v in lists.items()}
    if form == "tls_extensions":
        lengths = numbers(raw[: 2 * TLS_EXTENSIONS], 2)
        used = lengths.index(0) if 0 in lengths else len(lengths)
        return {"tls_ext_lengths": join(lengths[:used]), "tls_ext_types": join(numbers(raw[2 * TLS_EXTENSIONS :], 2)[:used])}
    if form == "basic_list":
        return basic_list(raw)
    return {name: raw.hex()}


def basic_list(raw: bytes) -> dict[str, str]:
    """Values of one element: its number, the length of each (or one a value), and the values."""
    r = Reader(raw, 1)
    element, size, enterprise = r.number(2), r.number(2), 0
    if element & ENTERPRISE_BIT:
        element, enterprise = element & ~ENTERPRISE_BIT, r.number(4)
    name, form = element_name(element, enterprise)
    values = []
    while r:
        values.append(r.take(variable_length(r) if size == VARIABLE else size))
    if form == "hex" or name is None:
        return {name: ",".join(v.hex() for v in values)}
    if form == "lengths":
        return {name: ",".join(map(str, packet_lengths([int.from_bytes(v, signed=True) for v in values])))}
    return {name: ",".join(str(int.from_bytes(v)) for v in values)}


def variable_length(r: Reader) -> int:
    size = r.number(1)
    return r.number(2) if size == 255 else size


def element_name(element: int, enterprise: int) -> tuple[str, str]:
    if not enterprise:
        return ELEMENTS.get(element, (f"e{element}", "hex"))
    own = ELEMENTS.get(element | ENTERPRISE_BIT) if enterprise == ENTERPRISE else None
    return own or (f"e{enterprise}.{element}", "hex")


def records_of(body: bytes, definition: bytes, version: int) -> Iterator[dict[str, str]]:
    """The records of a data set; a cut one ends it, and so does padding."""
    fields = fields_of(definition, version)
    least = sum(1 if size == VARIABLE else size for _, size, _ in fields)
    r = Reader(body)
    while least and r.at + least <= r.end:
        out: dict[str, str] = {}
        try:
            for element, size, enterprise in fields:
                raw = r.take(variable_length(r) if size == VARIABLE else size)
                out |= read_value(*element_name(element, enterprise), raw)
        except IndexError:
            return
        yield out


def sets(messages: DataFrame) -> DataFrame:
    """SETS from (exporter, seq, payload), also on a stream; each message by itself."""
    names = [c.split()[0] for c in SETS.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for exporter, seq, data in zip(batch["exporter"], batch["seq"], batch["payload"], strict=True):
                try:
                    for part, (domain, at, version, template, scopes, defines, body) in enumerate(sets_of(data or b"")):
                        out.append((exporter, domain, seq, part, at, version, template, scopes, defines, body))
                except IndexError:
                    pass  # a message that is cut off ends here
            yield pd.DataFrame(out, columns=names)

    return messages.select(F.col("exporter").cast("string").alias("exporter"), F.col("seq").cast("long").alias("seq"), "payload").mapInPandas(cut, SETS)


TEMPLATE = ("at", "version", "scopes", "body")


def with_templates(parts: DataFrame, expire: int = EXPIRE, block: int = BLOCK) -> DataFrame:
    """The data sets of ``parts`` (SETS) with ``_template``, the last definition of their number before them; those without one, or with an expired one, go.

    Within a block of messages a window finds it; for what is before the block, each block's last definitions are carried forward.
    """
    key = ["exporter", "domain", "template"]
    rows = parts.withColumn("_block", F.floor(F.col("seq") / block)).withColumn("_defined", F.when(F.col("defines"), F.struct(*TEMPLATE)))
    order = F.struct("seq", "part")
    last = rows.groupBy(*key, "_block").agg(F.max_by("_defined", F.when(F.col("defines"), order)).alias("_last"))  # a row a key and block
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*key, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    near = Window.partitionBy(*key, "_block").orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_near", F.last("_defined", ignorenulls=True).over(near)).where(~F.col("defines")).join(carried, [*key, "_block"])
    found = found.withColumn("_template", F.coalesce("_near", "_carried"))
    return found.where((F.octet_length("_template.body") > 0) & (F.col("at") - F.col("_template.at") <= expire)).drop("_near", "_carried", "_defined", "_block")


def read_sets(rows: DataFrame) -> DataFrame:
    """SCHEMA from data sets with (definition, defined_by, scopes)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                out += [(r.exporter, r.domain, r.seq, r.part, n, r.scopes >= 0, fields) for n, fields in enumerate(records_of(r.body, r.definition, r.defined_by))]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(read, SCHEMA)


def decode(messages: DataFrame, expire: int = EXPIRE) -> DataFrame:
    """(exporter, domain, seq, set, record, options, fields) from (exporter, seq, payload): the records of all data sets.

    ``set`` and ``record`` number the message's sets (with template definitions) and a set's records; ``options``: the record is by an options template.
    """
    found = with_templates(sets(messages), expire)
    return read_sets(found.select("exporter", "domain", "seq", "part", "body", F.col("_template.body").alias("definition"), F.col("_template.version").alias("defined_by"), F.col("_template.scopes").alias("scopes")))


def flow_fields(decoded: DataFrame) -> DataFrame:
    """The known elements of data records as typed flow columns."""
    number = lambda n: F.col("fields")[n].cast("long").alias(n)
    rows = decoded.where(~F.col("options"))
    return rows.select("exporter", "seq", "record", F.col("fields")["sa"].alias("sa"), F.col("fields")["da"].alias("da"), *map(number, ("sp", "dp", "pr", "bytes_out", "num_pkts_out", "start_ms", "end_ms")))


def telemetry(decoded: DataFrame) -> DataFrame:
    """Packets, byte distribution, first data packet and TLS of data records, as flow records have them; what an exporter did not send is null."""
    text = lambda n: F.col("fields")[n]
    listed = lambda n: F.when(text(n) == "", F.array().cast("array<int>")).otherwise(F.split(text(n), ",").cast("array<int>"))
    code = lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")
    gaps = lambda times: F.transform(times, lambda t, i: t - F.when(i > 0, F.get(times, i - 1)).otherwise(0))
    packets = F.arrays_zip(listed("splt_lengths").alias("b"), gaps(listed("splt_times")).alias("ipt"))
    records = F.arrays_zip(listed("tls_lengths").alias("b"), listed("tls_times").alias("ipt"), listed("tls_types").alias("tp"), listed("tls_handshakes").alias("hs"))
    found = F.arrays_zip(listed("tls_ext_types").alias("kind"), listed("tls_ext_lengths").alias("length"))
    rows = decoded.where(~F.col("options"))
    tls = F.struct(
        text("tls_version").cast("int").alias("version"), text("tls_key_length").cast("int").alias("c_key_length"), text("tls_sid").alias("sid"), text("tls_random").alias("c_random"),
        F.transform(listed("tls_cs"), code).alias("cs"), found.alias("c_extensions"), records.alias("srlt"),
    )
    return rows.select("exporter", "seq", "set", "record", F.unhex(text("idp")).alias("idp"), packets.alias("packets"), listed("byte_dist").alias("byte_dist"), tls.alias("tls"))


def run_lengths(values: Column) -> Column:
    """Packet lengths or times as exporters write them: see ``run_length_decoded``."""
    from flowquery.operators.windows import run_length_decoded

    return run_length_decoded(values)
