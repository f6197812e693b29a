"""DNS messages."""

from __future__ import annotations

import ipaddress

from flowquery.features import Reader, decoder

SCHEMA = "struct<qn:string,rn:string,rc:int,rr:array<struct<name:string,a:string,aaaa:string,target:string,type:int,class:int,ttl:bigint>>>"
JUMPS = 20
# Record types whose data is a name, with the number of bytes before it.
NAMED = {2: 0, 5: 0, 6: 0, 12: 0, 15: 2}


def name(data: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed name and where what follows it begins."""
    labels, after, jumps = [], None, 0
    while True:
        size = data[at]
        if size >= 0xC0:
            after = after or at + 2
            at = (size & 0x3F) << 8 | data[at + 1]
            jumps += 1
            if jumps > JUMPS:
                raise ValueError("names point in a circle")
        elif not size:
            return ".".join(labels), after or at + 1
        else:
            if at + 1 + size > len(data):
                raise IndexError("past the end")
            labels.append(data[at + 1 : at + 1 + size].decode("latin-1"))
            at += 1 + size


def message(data: bytes) -> dict:
    r = Reader(data, 2)
    flags, questions, answers = r.number(2), r.number(2), r.number(2)
    at, asked = 12, None
    for _ in range(questions):
        asked, at = name(data, at)
        at += 4
    records = []
    try:
        for _ in range(answers):
            owner, at = name(data, at)
            r = Reader(data, at)
            kind, group, ttl, size = r.number(2), r.number(2), r.number(4), r.number(2)
            body = r.take(size)
            records.append({
                "name": owner, "a": str(ipaddress.IPv4Address(body)) if kind == 1 and size == 4 else None,
                "aaaa": str(ipaddress.IPv6Address(body)) if kind == 28 and size == 16 else None,
                "target": name(data, r.at - size + NAMED[kind])[0] if kind in NAMED else None, "type": kind, "class": group, "ttl": ttl,
            })
            at = r.at
    except (IndexError, ValueError):
        pass  # what was whole stays
    answer = bool(flags & 0x8000)
    return {"qn": asked, "rn": asked if answer else None, "rc": flags & 15, "rr": records}


parse = decoder(message, SCHEMA)
