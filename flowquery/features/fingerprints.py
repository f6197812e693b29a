"""Client fingerprints: from packets and messages, from hex, and their decoded extensions."""

from __future__ import annotations

from flowquery.features import Reader, decoder
from flowquery.features.tls import KEPT_EXTENSIONS, client_hello, grease, server_names

# TCP options whose data a fingerprint keeps (maximum segment size, window scale).
KEPT_OPTIONS = (2, 3)
# Names of extension types, and of what some of them hold.
EXTENSIONS = {
    0: "server_name", 5: "status_request", 10: "supported_groups", 11: "ec_point_formats", 13: "signature_algorithms", 16: "application_layer_protocol_negotiation",
    18: "signed_certificate_timestamp", 21: "padding", 22: "encrypt_then_mac", 23: "extended_master_secret", 35: "session_ticket", 41: "pre_shared_key", 43: "supported_versions",
    45: "psk_key_exchange_modes", 51: "key_share", 65281: "renegotiation_info",
}
GROUPS = {23: "secp256r1", 24: "secp384r1", 25: "secp521r1", 29: "x25519", 30: "x448", 256: "ffdhe2048", 257: "ffdhe3072"}
SIGNATURES = {
    0x0201: "rsa_pkcs1_sha1", 0x0203: "ecdsa_sha1", 0x0401: "rsa_pkcs1_sha256", 0x0403: "ecdsa_secp256r1_sha256", 0x0501: "rsa_pkcs1_sha384", 0x0503: "ecdsa_secp384r1_sha384",
    0x0601: "rsa_pkcs1_sha512", 0x0603: "ecdsa_secp521r1_sha512", 0x0804: "rsa_pss_rsae_sha256", 0x0805: "rsa_pss_rsae_sha384", 0x0806: "rsa_pss_rsae_sha512", 0x0807: "ed25519",
}
VERSIONS = {0x0300: "SSLv3", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def of_syn(options: bytes) -> str:
    """The option kinds of a SYN in order, with the data of those that are kept."""
    r, out = Reader(options), []
    while r:
        kind = r.number(1)
        if kind == 0:
            break
        if kind == 1:
            out.append("(01)")
            continue
        try:
            body = r.take(r.number(1) - 2)
        except IndexError:
            break
        out.append(f"({kind:02x}{len(body) + 2:02x}{body.hex()})" if kind in KEPT_OPTIONS else f"({kind:02x})")
    return "".join(out)


def of_payload(payload: bytes, kept: frozenset[int] = KEPT_EXTENSIONS) -> str | None:
    """The fingerprint of a TLS client hello at the start of a payload, else null."""
    if len(payload) < 11 or payload[0] != 22 or payload[1] != 3 or payload[5] != 1 or payload[9] != 3:
        return None
    return client_hello(payload[9 : 9 + int.from_bytes(payload[6:9])])["fingerprint"]


def structured(digits: str, kept: frozenset[int] = KEPT_EXTENSIONS) -> str:
    """A fingerprint written in hex without parentheses (version, length and suites, length and extensions) with them, and degreased."""
    r = Reader(bytes.fromhex(digits))
    version, suites = r.take(2).hex(), r.part(2).hex()
    out, body = [], Reader(r.part(2)) if r else Reader(b"")
    while body:
        kind = body.number(2)
        code = grease(f"{kind:04x}")
        if kind in kept:
            data = body.part(2)
            out.append(f"({code}{len(data):04x}{data.hex()})")
        else:
            out.append(f"({code})")
    return f"({version})({''.join(grease(suites[i : i + 4]) for i in range(0, len(suites), 4))})({''.join(out)})"


def _codes(data: bytes, prefix: int, size: int, names: dict[int, str]) -> list[str]:
    r = Reader(data)
    body = Reader(r.part(prefix))
    return [names.get(n, f"{n:0{2 * size}x}") for n in iter(lambda: body.number(size) if body else None, None)]


def extension(kind: int, data: bytes) -> dict:
    """The name of an extension, and what it holds as a list of names."""
    if kind == 0 and data:
        values = server_names(data)
    elif kind == 10:
        values = _codes(data, 2, 2, GROUPS)
    elif kind == 11:
        values = _codes(data, 1, 1, {0: "uncompressed", 1: "compressed_prime", 2: "compressed_char2"})
    elif kind == 13:
        values = _codes(data, 2, 2, SIGNATURES)
    elif kind == 16:
        body, values = Reader(Reader(data).part(2)), []
        while body:
            values.append(body.part(1).decode("latin-1"))
    elif kind == 43:
        values = _codes(data, 1, 2, VERSIONS)
    elif kind == 45:
        values = _codes(data, 1, 1, {0: "psk_ke", 1: "psk_dhe_ke"})
    elif kind == 51:
        body, values = Reader(Reader(data).part(2)), []
        while body:
            group = body.number(2)
            values.append(GROUPS.get(group, f"{group:04x}"))
            body.part(2)
    else:
        values = [data.hex()] if data else []
    return {"name": EXTENSIONS.get(kind, f"{kind:04x}"), "values": values}


def described(payload: bytes) -> dict | None:
    """A client hello's fingerprint and decoded extensions."""
    text = of_payload(payload)
    if text is None:
        return None
    hello = client_hello(payload[9 : 9 + int.from_bytes(payload[6:9])])
    return {"fingerprint": text, "suites": hello["cs"], "extensions": [extension(x["kind"], bytes.fromhex(x["data"])) for x in hello["c_extensions"]]}


syn = decoder(of_syn, "string")
payload = decoder(of_payload, "string")
describe = decoder(described, "struct<fingerprint:string,suites:array<string>,extensions:array<struct<name:string,values:array<string>>>>")
