"""HTTP messages at the start of a payload."""

from __future__ import annotations

from flowquery.features import decoder

MESSAGES, HEADERS, BODY = 15, 32, 16
SCHEMA = "array<struct<method:string,uri:string,version:string,code:string,reason:string,headers:map<string,string>,body:string>>"


def messages(payload: bytes) -> list[dict]:
    """Start line, headers and the first body bytes (hex) of each message; the body's length is its Content-Length."""
    out: list[dict] = []
    while payload and len(out) < MESSAGES:
        head, _, rest = payload.partition(b"\r\n\r\n")
        first, *lines = head.decode("latin-1").split("\r\n")
        parts = first.split(" ", 2)
        if len(parts) < 2 or not (parts[0].startswith("HTTP/") or first.rpartition(" ")[2].startswith("HTTP/")):
            break
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[:HEADERS]) if k}
        sizes = [v for k, v in headers.items() if k.lower() == "content-length"]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else 0
        answer = parts[0].startswith("HTTP/")
        out.append({
            "method": None if answer else parts[0], "uri": None if answer else parts[1], "version": parts[0] if answer else parts[-1],
            "code": parts[1] if answer else None, "reason": (parts[2] if len(parts) > 2 else "") if answer else None,
            "headers": headers, "body": rest[: min(BODY, size or BODY)].hex(),
        })
        payload = rest[size:] if size else b""
    return out


parse = decoder(messages, SCHEMA)
