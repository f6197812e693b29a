"""Options as ``key=value`` words or lines, and their echo as the first line of a flow file."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields

#: Features that have a switch of their own.
FEATURES = ("dns", "http", "tls", "ssh", "dhcp", "ike", "payload", "fpx")


@dataclass
class Options:
    """What ``capture.records`` is told. Unknown names and values out of range are errors; what belongs to hosts and threads, as
    the number of workers, is Spark's to know. ``stream_bytes``: of a direction's bytes, how many the features see (0: all). ``model``: a file of 208 weights, a number a line, that scores records; ``model_bytes``: one of 464, used with ``dist`` where over 100 bytes were seen. ``protocols``: a file of numbers and names, that names the protocol. ``key`` is for the addresses of ``anon``, and is not echoed."""

    bidir: bool = False
    dist: bool = False
    entropy: bool = False
    retrans: bool = False
    zeros: bool = False
    num_pkts: int = 50
    idp: int = 0
    stream_bytes: int = 16_384
    idle: int = 10
    active: int = 30
    bpf: str = ""
    model: str = ""
    model_bytes: str = ""
    protocols: str = ""
    anon: str = ""
    key: str = ""
    label: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not 0 < self.num_pkts <= 200:
            raise ValueError("num_pkts is from 1 to 200")
        if self.idle <= 0 or self.active < self.idle:
            raise ValueError("idle is over 0 and not over active")
        if self.stream_bytes < 0:
            raise ValueError("stream_bytes is 0 or more")
        if self.idp < 0 or self.idp > 1300:
            raise ValueError("idp is from 0 to 1300")


def parse(words: Iterable[str]) -> Options:
    """From ``key=value`` words or lines; ``#`` starts a comment, and later words win. A bare feature name or ``name=1`` switches it on."""
    kinds = {f.name: f.type for f in fields(Options)}
    found: dict = {"label": [], "features": []}
    for word in words:
        key, _, value = (x.strip() for x in word.partition("#")[0].partition("="))
        value = value.strip("\"'")
        if not key:
            continue
        if key in FEATURES:
            if value in ("", "1"):
                found["features"].append(key)
        elif key == "label":
            found["label"].append(value)
        elif key not in kinds or key == "features":
            raise ValueError(f"no such option: {key}")
        elif kinds[key] == "bool":
            if value not in ("", "0", "1"):
                raise ValueError(f"{key} is 0 or 1")
            found[key] = value != "0"
        elif kinds[key] == "int":
            found[key] = int(value)
        else:
            found[key] = value
    return Options(**found)


def echo(options: Options) -> dict:
    """The settings that differ from nothing, for ``sinks.jsonl.with_config``."""
    return {k: (",".join(v) if isinstance(v, list) else int(v) if isinstance(v, bool) else v) for k, v in asdict(options).items() if v and k != "key"}
