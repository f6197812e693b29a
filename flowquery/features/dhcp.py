"""DHCP and DHCPv6 messages."""

from __future__ import annotations

import ipaddress

from flowquery.features import Reader, decoder

OPTIONS = 16
# Option and message names.
NAMES = {
    1: "subnet_mask", 3: "router", 6: "domain_name_server", 12: "host_name", 15: "domain_name", 50: "requested_ip", 51: "lease_time", 53: "message_type",
    54: "server_id", 55: "parameter_request", 60: "vendor_class", 61: "client_id",
}
TYPES = {1: "DISCOVER", 2: "OFFER", 3: "REQUEST", 4: "DECLINE", 5: "ACK", 6: "NAK", 7: "RELEASE", 8: "INFORM"}
V6_TYPES = {
    1: "SOLICIT", 2: "ADVERTISE", 3: "REQUEST", 4: "CONFIRM", 5: "RENEW", 6: "REBIND", 7: "REPLY", 8: "RELEASE", 9: "DECLINE", 10: "RECONFIGURE", 11: "INFORMATION-REQUEST",
}
COOKIE = bytes.fromhex("63825363")
SCHEMA = "struct<op:int,htype:int,xid:string,ciaddr:string,yiaddr:string,siaddr:string,giaddr:string,chaddr:string,sname:string,options:array<struct<kind:int,name:string,value:string>>>"
SCHEMA_V6 = "struct<type:string,transid:string,option:int,mac:string>"
ADDRESSES, TEXTS = (1, 3, 6, 50, 54), (12, 15, 60)


def message(data: bytes) -> dict:
    r = Reader(data)
    op, htype, size, _ = (r.number(1) for _ in range(4))
    xid = r.take(4).hex()
    r.take(4)
    ci, yi, si, gi = (str(ipaddress.IPv4Address(r.take(4))) for _ in range(4))
    hardware, server = r.take(16)[: min(size, 16)], r.take(64).rstrip(b"\0").decode("latin-1")
    r.take(128)
    found = []
    if r and r.take(4) == COOKIE:
        while r and len(found) < OPTIONS:
            kind = r.number(1)
            if kind == 255:
                break
            if kind:
                found.append({"kind": kind, "name": NAMES.get(kind), "value": _value(kind, r.part(1))})
    return {"op": op, "htype": htype, "xid": xid, "ciaddr": ci, "yiaddr": yi, "siaddr": si, "giaddr": gi, "chaddr": hardware.hex(":"), "sname": server, "options": found}


def _value(kind: int, body: bytes) -> str:
    if kind == 53 and len(body) == 1:
        return TYPES.get(body[0], str(body[0]))
    if kind in ADDRESSES and body and not len(body) % 4:
        return ",".join(str(ipaddress.IPv4Address(body[i : i + 4])) for i in range(0, len(body), 4))
    return body.decode("latin-1") if kind in TEXTS else body.hex()


def message_v6(data: bytes) -> dict:
    """Type, transaction, first option, and the hardware address of a client or server id."""
    r = Reader(data)
    kind, transaction = r.number(1), r.take(3).hex()
    out = {"type": V6_TYPES.get(kind, str(kind)), "transid": transaction, "option": None, "mac": None}
    if r:
        out["option"] = r.number(2)
        body = r.part(2)
        form = int.from_bytes(body[:2])
        if out["option"] in (1, 2) and form in (1, 3):
            out["mac"] = body[8 if form == 1 else 4 :].hex(":")
    return out


parse = decoder(message, SCHEMA)
parse_v6 = decoder(message_v6, SCHEMA_V6)
