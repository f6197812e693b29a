"""Protocol decoders on messages written here."""

import pytest
from flowquery.features import dhcp, dns, frames, http, ike, ssh, tls
from pyspark.sql import functions as F


def test_dns_names_and_records():
    name = b"\x03www\x07example\x03com\0"
    data = bytes.fromhex("000181800001000300000000") + name + b"\0\1\0\1"
    data += b"\xc0\x0c\0\5\0\1\0\0\0\x3c\0\2\xc0\x10" + b"\xc0\x10\0\1\0\1\0\0\0\x3c\0\4\1\2\3\4" + b"\xc0\x10\0\x1c\0\1\0\0\0\x3c\0\x10" + bytes(15) + b"\1"
    m = dns.message(data)
    assert (m["qn"], m["rc"]) == ("www.example.com", 0)
    assert [(r["target"], r["a"], r["aaaa"]) for r in m["rr"]] == [("example.com", None, None), (None, "1.2.3.4", None), (None, None, "::1")]
    assert len(dns.message(data[:-3])["rr"]) == 2
    with pytest.raises(ValueError, match="circle"):
        dns.name(b"\xc0\x00", 0)


def test_http_messages():
    data = b"POST /x HTTP/1.1\r\nHost: a\r\nContent-Length: 3\r\n\r\nabcGET / HTTP/1.0\r\nA: b:c\r\n\r\n"
    one, two = http.messages(data)
    assert (one["method"], one["uri"], one["headers"]["Host"], one["body"]) == ("POST", "/x", "a", "616263")
    assert (two["version"], two["headers"]) == ("HTTP/1.0", {"A": "b:c"})
    assert http.messages(b"HTTP/1.1 404 Not Found\r\n\r\n")[0]["reason"] == "Not Found"
    assert http.messages(b"\x16\x03\x01") == [] == http.messages(b"")


def hello(kind: int, body: bytes) -> bytes:
    message = bytes([kind]) + len(body).to_bytes(3) + body
    return b"\x16\x03\x01" + len(message).to_bytes(2) + message


def extension(kind: int, data: bytes) -> bytes:
    return kind.to_bytes(2) + len(data).to_bytes(2) + data


def test_tls_hellos():
    sni = b"\0\7\0\0\4host"
    found = extension(0x1A1A, b"") + extension(0, sni) + extension(10, b"\0\2\0\x1d")
    body = b"\3\3" + bytes(32) + b"\0" + b"\0\4\x2a\x2a\xc0\x2b" + b"\1\0" + len(found).to_bytes(2) + found
    out = tls.stream(hello(1, body))
    assert (out["c_version"], out["cs"], out["sni"]) == (771, ["2a2a", "c02b"], ["host"])
    assert out["fingerprint"] == "(0303)(0a0ac02b)((0a0a)(0000)(000a00040002001d))"
    out = tls.stream(hello(2, b"\3\3" + bytes(32) + b"\0\xc0\x2b\0"))
    assert (out["scs"], out["s_version"], out["records"][0]["type"]) == ("c02b", 771, 22)
    assert tls.stream(b"GET /") is None and tls.stream(hello(1, body)[:30])["cs"] is None


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2)
    return bytes([tag]) + size + body


def test_certificates():
    sha256 = der(0x30, der(6, bytes.fromhex("2a864886f70d01010b")))
    name = der(0x30, der(0x31, der(0x30, der(6, bytes.fromhex("55040a")), der(12, b"Org"))))
    dates = der(0x30, der(0x17, b"200101000000Z"), der(0x17, b"300101000000Z"))
    key = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d010101"))), der(3, b"\0" + der(0x30, der(2, b"\0" + b"\xff" * 256), der(2, b"\1\0\1"))))
    body = der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\x05"), sha256, name, dates, name, key)
    cert = der(0x30, body, sha256, der(3, b"\0\1"))
    out = tls.stream(hello(11, (len(cert) + 3).to_bytes(3) + len(cert).to_bytes(3) + cert))["certs"][0]
    assert (out["signature_algo"], out["issuer"], out["signature_key_size"]) == ("sha256WithRSAEncryption", [{"name": "organizationName", "value": "Org"}], 2048)


def test_tcp_options():
    names = [o["name"] for o in frames.tcp_options(bytes.fromhex("020405b40101030307080a00000001000000020402fd041234"))]
    assert names == ["mss", "noop", "noop", "ws", "ts", "sackp", "other"]
    assert [o["name"] for o in frames.tcp_options(b"\x02\x09\x01")] == ["malformed"]


def test_ipv6_extension_headers():
    body = b"\0\x35\0\x36\0\x09\0\0x"
    packet = bytes([0x60, 0, 0, 0]) + (len(body) + 8).to_bytes(2) + bytes([0, 64]) + bytes(15) + b"\1" + bytes(15) + b"\2" + bytes([17, 0]) + bytes(6) + body
    out = frames.frame(bytes(12) + b"\x86\xdd" + packet)
    assert (out["sa"], out["da"], out["sp"], out["dp"], out["payload"]) == ("::1", "::2", 53, 54, b"x")
    assert frames.frame(bytes(12) + b"\x08\x06") is None


def test_ssh():
    lists = b"".join(len(x).to_bytes(4) + x for x in (b"a,b", b"", *[b"c"] * 8))
    body = bytes([20]) + bytes(16) + lists
    packet = (len(body) + 1 + 4).to_bytes(4) + b"\4" + body + bytes(4)
    out = ssh.stream(b"SSH-2.0-x\r\n" + packet + (2 + 4).to_bytes(4) + b"\4\x15" + bytes(4))
    assert (out["version"], out["kex_algos"], out["s_languages"], out["newkeys"]) == ("SSH-2.0-x", ["a", "b"], ["c"], "true")


def test_dhcp():
    head = bytes([1, 1, 6, 0]) + b"\1\2\3\4" + bytes(4) + bytes(16) + bytes.fromhex("aabbccddeeff") + bytes(10) + bytes(192)
    out = dhcp.message(head + dhcp.COOKIE + b"\x35\1\1\x32\4\x0a\0\0\1\xff")
    assert out["chaddr"] == "aa:bb:cc:dd:ee:ff" and [o["value"] for o in out["options"]] == ["DISCOVER", "10.0.0.1"]
    six = dhcp.message_v6(b"\1\0\0\7\0\1\0\x0a\0\3\0\1" + bytes.fromhex("aabbccddeeff"))
    assert (six["type"], six["transid"], six["mac"]) == ("SOLICIT", "000007", "aa:bb:cc:dd:ee:ff")


def test_ike():
    transform = b"\0\0\0\x0c\1\0\0\x0c\x80\x0e\1\0"
    proposal = b"\0\0" + (8 + len(transform)).to_bytes(2) + b"\1\1\0\1" + transform
    sa = b"\x28\0" + (4 + len(proposal)).to_bytes(2) + proposal
    nonce = b"\0\0\0\6\xab\xcd"
    out = ike.message(b"\1" * 8 + bytes(8) + bytes([33, 0x20, 34, 0x08]) + bytes(4) + (28 + len(sa + nonce)).to_bytes(4) + sa + nonce)
    assert out["version"] == "2.0" and [p["name"] for p in out["payloads"]] == ["sa", "nonce"]
    assert out["transforms"] == [{"proposal": 1, "protocol": 1, "type": 1, "id": 12, "key_length": 256}]


def test_decoders_give_null_for_what_is_malformed(spark):
    df = spark.createDataFrame([(b"",), (b"\x00\x01",), (None,)], "p binary")
    for parse in (dns.parse, dhcp.parse, ike.parse, tls.parse, ssh.parse, frames.decode):
        assert [r[0] for r in df.select(parse(F.col("p"))).collect()] == [None] * 3
