"""Flow records as IPFIX messages.

A task writes its rows as messages of bounded size, each with the template it needs, so that messages can be read in
any order; sequence numbers count a task's records, whose domain is the task.
"""

from __future__ import annotations

import ipaddress
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Information elements with their lengths, in the order of the record.
SIMPLE = {4: ((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (152, 8), (153, 8)), 6: ((27, 16), (28, 16), (7, 2), (11, 2), (4, 1), (152, 8), (153, 8))}
TEMPLATE, ENTERPRISE, PAYLOAD, VARIABLE = 256, 9, 12_000, 0xFFFF
#: Bytes of records in a message, a longer one being alone in its own; and of a payload, as a message has 65,535 at most.
MOST, LONGEST = 1400, 65_300
SCHEMA = "domain int, sequence long, message binary"


def number_of(version: int, payload: bool) -> int:
    """The template's number."""
    return TEMPLATE + 2 * (version == 6) + payload


def template(version: int, payload: bool) -> bytes:
    fields = b"".join(e.to_bytes(2) + n.to_bytes(2) for e, n in SIMPLE[version])
    if payload:
        fields += (PAYLOAD | 0x8000).to_bytes(2) + VARIABLE.to_bytes(2) + ENTERPRISE.to_bytes(4)
    body = number_of(version, payload).to_bytes(2) + (len(SIMPLE[version]) + payload).to_bytes(2) + fields
    return (2).to_bytes(2) + (4 + len(body)).to_bytes(2) + body


def record(r, payload: bool) -> bytes:
    number = lambda x, n: (0 if pd.isna(x) else int(x)).to_bytes(n)
    out = ipaddress.ip_address(r.sa).packed + ipaddress.ip_address(r.da).packed + number(r.sp, 2) + number(r.dp, 2) + number(r.pr, 1)
    out += number(r.time_start / 1000, 8) + number(r.time_end / 1000, 8)
    if payload:
        body = r.idp if isinstance(r.idp, bytes) else b""
        if len(body) > LONGEST:
            raise ValueError(f"a payload of {len(body)} bytes does not fit a message")
        out += (bytes([len(body)]) if len(body) < 255 else b"\xff" + len(body).to_bytes(2)) + body
    return out


def message(records: list[bytes], domain: int, sequence: int, version: int, payload: bool, at: int) -> bytes:
    data = b"".join(records)
    body = template(version, payload) + number_of(version, payload).to_bytes(2) + (4 + len(data)).to_bytes(2) + data
    return (10).to_bytes(2) + (16 + len(body)).to_bytes(2) + at.to_bytes(4) + sequence.to_bytes(4) + domain.to_bytes(4) + body


def encode(flows: DataFrame, payload: bool = False, export_time: int | None = None) -> DataFrame:
    """(domain, sequence, message) from flows of both IP versions (five-tuple, time_start and time_end in microseconds, with ``payload`` also idp)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        domain, sequence, held, size, version = TaskContext.get().partitionId(), 0, [], 0, 4
        at = int(time.time()) if export_time is None else export_time
        for batch in batches:
            out = []
            for r in batch.itertuples():
                one = record(r, payload)
                own = 6 if ":" in r.sa else 4
                if held and (size + len(one) > MOST or own != version):
                    out.append((domain, sequence, message(held, domain, sequence, version, payload, at)))
                    sequence, held, size = sequence + len(held), [], 0
                held.append(one)
                size, version = size + len(one), own
            yield pd.DataFrame(out, columns=["domain", "sequence", "message"])
        if held:
            yield pd.DataFrame([(domain, sequence, message(held, domain, sequence, version, payload, at))], columns=["domain", "sequence", "message"])

    names = ["sa", "da", "sp", "dp", "pr", "time_start", "time_end", *(["idp"] if payload else [])]
    return flows.where(F.col("sa").isNotNull() & F.col("da").isNotNull()).select(*names).mapInPandas(write, SCHEMA)
