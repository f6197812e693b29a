"""Ethernet frames to packets: addresses, ports, TCP fields and payload."""

from __future__ import annotations

import ipaddress

from flowquery.features import Reader, decoder

SCHEMA = (
    "struct<sa:string,da:string,sp:int,dp:int,pr:int,ttl:int,ip_id:int,seq:bigint,ack:bigint,flags:int,win:int,"
    "opts:binary,payload:binary,packet:binary,invalid:boolean>"
)
# Fixed values of the protocols.
VLAN = (0x8100, 0x88A8)
EXTENSIONS = (0, 43, 60)
FRAGMENT = 44


def frame(data: bytes) -> dict | None:
    """An Ethernet frame with two VLAN tags at most, or null for what is no IP packet."""
    r = Reader(data, 12)
    kind = r.number(2)
    for _ in range(2):
        if kind in VLAN:
            r.take(2)
            kind = r.number(2)
    if kind == 0x0800:
        return _ipv4(data[r.at :])
    return _ipv6(data[r.at :]) if kind == 0x86DD else None


def _ipv4(data: bytes) -> dict | None:
    if len(data) < 20 or data[0] >> 4 != 4 or (data[0] & 15) < 5:
        return None
    size = (data[0] & 15) * 4
    total = int.from_bytes(data[2:4])
    packet = data[: total if size <= total else len(data)]  # what was cut off is left out
    later = int.from_bytes(data[6:8]) & 0x1FFF  # a later fragment has no transport header
    protocol = 0 if later else data[9]
    out = {"sa": str(ipaddress.IPv4Address(data[12:16])), "da": str(ipaddress.IPv4Address(data[16:20])), "ttl": data[8], "ip_id": int.from_bytes(data[4:6])}
    return out | _transport(protocol, packet, size)


def _ipv6(data: bytes) -> dict | None:
    if len(data) < 40 or data[0] >> 4 != 6:
        return None
    packet = data[: 40 + int.from_bytes(data[4:6])]
    following, at = data[6], 40
    while following in EXTENSIONS and at + 8 <= len(packet):
        following, at = packet[at], at + 8 + 8 * packet[at + 1]
    if following == FRAGMENT and at + 8 <= len(packet):
        later = int.from_bytes(packet[at + 2 : at + 4]) >> 3
        following, at = (0 if later else packet[at]), at + 8
    out = {"sa": str(ipaddress.IPv6Address(data[8:24])), "da": str(ipaddress.IPv6Address(data[24:40])), "ttl": data[7], "ip_id": None}
    return out | _transport(following, packet, at)


def _transport(protocol: int, packet: bytes, at: int) -> dict:
    """The transport fields; a malformed header leaves the packet an IP packet, marked invalid."""
    body = packet[at:]
    out = {"sp": None, "dp": None, "pr": protocol, "seq": None, "ack": None, "flags": None, "win": None, "opts": None, "payload": body, "packet": packet, "invalid": False}
    if protocol == 6:
        size = (body[12] >> 4) * 4 if len(body) >= 20 else 0
        if size < 20 or size > len(body):
            return out | {"invalid": True, "payload": b""}
        number = lambda a, b: int.from_bytes(body[a:b])
        return out | {
            "sp": number(0, 2), "dp": number(2, 4), "seq": number(4, 8), "ack": number(8, 12), "flags": body[13], "win": number(14, 16),
            "opts": body[20:size], "payload": body[size:],
        }
    if protocol == 17:
        if len(body) < 8:
            return out | {"invalid": True, "payload": b""}
        return out | {"sp": int.from_bytes(body[:2]), "dp": int.from_bytes(body[2:4]), "payload": body[8:]}
    return out


decode = decoder(frame, SCHEMA)

OPTIONS = "array<struct<name:string,value:bigint,echo:bigint,kind:int,data:string>>"


def tcp_options(data: bytes) -> list[dict]:
    """The options in order: end, noop, mss, ws, sackp, ts, and others by kind and data."""
    out: list[dict] = []
    r = Reader(data)
    item = lambda name, value=None, echo=None, kind=None, data=None: {"name": name, "value": value, "echo": echo, "kind": kind, "data": data}
    while r:
        kind = r.number(1)
        if kind == 0:
            break
        if kind == 1:
            out.append(item("noop"))
            continue
        try:
            body = Reader(r.take(r.number(1) - 2))
        except IndexError:
            out.append(item("malformed"))
            break
        size = body.end
        if kind == 2 and size == 2:
            out.append(item("mss", body.number(2)))
        elif kind == 3 and size == 1:
            out.append(item("ws", body.number(1)))
        elif kind == 4 and size == 0:
            out.append(item("sackp"))
        elif kind == 8 and size == 8:
            out.append(item("ts", body.number(4), body.number(4)))
        else:
            out.append(item("other", kind=kind, data=body.data.hex()))
    return out


options = decoder(tcp_options, OPTIONS)
