"""The flow table as a stream: decoded packets in, the records of ``flows.build`` out.

A conversation's state is what it waits with (packets that the watermark has not passed, as earlier ones may still come), its open record
(counters of both sides, what their first packets held), and the packets that the record lists. Packets are taken in the order of their times once the
watermark has passed them, so packets that come late, but within its delay, count as in a batch. A timer takes what has become due, and ends a record that was idle.
The session's state store must be one that ``transformWithState`` supports (the RocksDB one).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from flowquery.operators import flows
from flowquery.operators.keys import canonical

PACKET = "ts_us long, seq long, sa string, da string, sp int, dp int, pr int, ttl int, flags int, win int, tcp_seq long, opts binary, payload binary, packet binary, invalid boolean"
PACKET_NAMES = [c.split()[0] for c in PACKET.split(", ")]
SIDE = "bytes long, fresh long, ttl int, win int, first_seq long, opts binary, idp binary, payload binary, told boolean, back array<long>"
RECORD = "time_start long, time_end long, sa string, da string, sp int, dp int, pr int, client int, retrans long, invalid boolean, " + ", ".join(f"{c.split()[0]}_{k} {c.split()[1]}" for k in (0, 1) for c in SIDE.split(", "))
RECORD_NAMES = [c.split()[0] for c in RECORD.split(", ")]
ITEM = "ts_us long, b long, side int"
FLOW = (
    "sa string, da string, sp int, dp int, pr int, time_start long, time_end long, bytes_out long, num_pkts_out long, bytes_in long, num_pkts_in long, ttl_out int, ttl_in int, tcp_retrans long, invalid boolean, "
    "first_window_out int, first_seq long, syn_opts_out binary, syn_opts_in binary, idp_out binary, payload_out binary, payload_in binary, packets array<struct<b: long, dir: string, ipt: long>>, expire_type string"
)
FLOW_NAMES = [c.split()[0] for c in FLOW.split(", ") if not c.startswith(("dir:", "ipt:"))]
SYN, SYN_ACK, BACK = 2, 18, 10


def opened(p: dict) -> dict:
    """A record that begins with packet ``p``; side 0 is the one that sent it."""
    sides = {f"{name}_{k}": value for k in (0, 1) for name, value in {**dict.fromkeys(("ttl", "win", "first_seq", "opts", "idp", "payload")), "bytes": 0, "fresh": 0, "told": False, "back": []}.items()}
    return {**{n: p[n] for n in ("sa", "da", "sp", "dp", "pr")}, "time_start": p["ts_us"], "time_end": p["ts_us"], "client": -1, "retrans": 0, "invalid": False, **sides}


def add(record: dict, listed: list[tuple], p: dict, count: int, zeros: bool) -> None:
    """Count packet ``p``, which is not before those already counted."""
    k = 0 if (p["sa"], p["sp"]) == (record["sa"], record["sp"]) else 1
    size = len(p["payload"] or b"")
    back = record[f"back_{k}"]
    again = size > 0 and p["tcp_seq"] is not None and p["tcp_seq"] in [x for x in back if x is not None]
    record[f"back_{k}"] = [*back, p["tcp_seq"]][-BACK:]
    record["time_end"] = max(record["time_end"], p["ts_us"])
    record["retrans"] += again
    record["invalid"] = record["invalid"] or bool(p["invalid"])
    if p["ttl"] is not None:
        record[f"ttl_{k}"] = p["ttl"] if record[f"ttl_{k}"] is None else min(record[f"ttl_{k}"], p["ttl"])
    if p["flags"] in (SYN, SYN_ACK) and not record[f"told_{k}"]:
        record |= {f"told_{k}": True, f"win_{k}": p["win"], f"first_seq_{k}": p["tcp_seq"], f"opts_{k}": p["opts"]}
    if p["flags"] == SYN and record["client"] < 0:
        record["client"] = k
    if size and record[f"payload_{k}"] is None:
        record |= {f"payload_{k}": p["payload"][:32], f"idp_{k}": None if p["packet"] is None else p["packet"][:1300]}
    if not again:
        record[f"bytes_{k}"] += size
        record[f"fresh_{k}"] += 1
        if len(listed) < count and (size or zeros):
            listed.append((p["ts_us"], size, k))


def closed(record: dict, listed: list[tuple], ended: str) -> tuple:
    """The row of a record."""
    own = max(record["client"], 0)
    other = 1 - own
    ends = ("sa", "da", "sp", "dp") if own == 0 else ("da", "sa", "dp", "sp")
    packets, before = [], record["time_start"]
    for ts, size, k in listed:
        packets.append({"b": size, "dir": ">" if k == own else "<", "ipt": (ts - before) // 1000})
        before = ts
    of = lambda name, k: record[f"{name}_{k}"]
    return (
        *(record[n] for n in ends), record["pr"], record["time_start"], record["time_end"], of("bytes", own), of("fresh", own), of("bytes", other) if of("fresh", other) else None, of("fresh", other),
        of("ttl", own), of("ttl", other), record["retrans"], record["invalid"], of("win", own), of("first_seq", own), of("opts", own), of("opts", other), of("idp", own), of("payload", own), of("payload", other), packets, ended,
    )


class FlowTable(StatefulProcessor):
    def __init__(self, count: int, zeros: bool, idle: int, active: int):
        self.count, self.zeros, self.idle, self.active = count, zeros, idle, active

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKET)
        self.record = handle.getValueState("record", RECORD)
        self.listed = handle.getListState("listed", ITEM)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for batch in rows for r in batch[PACKET_NAMES].astype(object).itertuples(index=False)]
        plain = lambda x, n: int(x) if n in ("ts_us", "seq", "sp", "dp", "pr", "ttl", "flags", "win", "tcp_seq") and x is not None else bool(x) if n == "invalid" and x is not None else x
        fresh = [tuple(plain(x, n) for x, n in zip(r, PACKET_NAMES, strict=True)) for r in fresh]
        self.waiting.appendList(fresh)
        self.handle.registerTimer(max(min(r[0] for r in fresh) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=FLOW_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [dict(zip(PACKET_NAMES, r, strict=True)) for r in self.waiting.get()]
        due = sorted((p for p in held if p["ts_us"] <= now), key=lambda p: (p["ts_us"], p["seq"]))
        left = [p for p in held if p["ts_us"] > now]
        record = dict(zip(RECORD_NAMES, self.record.get(), strict=True)) if self.record.exists() else None
        if record:
            record |= {f"back_{k}": list(record[f"back_{k}"] or []) for k in (0, 1)}
        listed = [tuple(x) for x in self.listed.get()] if record else []
        out = []
        for p in due:
            if record and (p["ts_us"] - record["time_end"] > self.idle or p["ts_us"] - record["time_start"] > self.active):
                out.append(closed(record, listed, "i" if p["ts_us"] - record["time_end"] > self.idle else "a"))
                record = None
            if record is None:
                record, listed = opened(p), []
            add(record, listed, p, self.count, self.zeros)
        if record and now > record["time_end"] + self.idle:
            out.append(closed(record, listed, "i"))
            record, listed = None, []
        self._keep(record, listed, left)
        ends = [p["ts_us"] // 1000 + 1 for p in left] + ([(record["time_end"] + self.idle) // 1000 + 1] if record else [])
        if ends:
            self.handle.registerTimer(max(min(ends), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=FLOW_NAMES, dtype=object)

    def close(self) -> None:
        pass

    def _keep(self, record: dict | None, listed: list[tuple], left: list[dict]) -> None:
        if record:
            self.record.update(tuple(record[n] for n in RECORD_NAMES))
        else:
            self.record.clear()
        for state, some in ((self.listed, listed), (self.waiting, [tuple(p[n] for n in PACKET_NAMES) for p in left])):
            if some:
                state.put(some)
            else:
                state.clear()


def build(packets: DataFrame, delay: str = "10 seconds", count: int = flows.PACKETS, zeros: bool = False, idle: int = flows.IDLE, active: int = flows.ACTIVE) -> DataFrame:
    """The records of a stream of decoded packets, both directions together, as ``flows.build`` has them; to be written in append mode.

    ``delay``: how much later than the latest a packet may come. A record comes out once the watermark has passed its end by ``idle`` microseconds, or a later record has begun.
    """
    key = canonical()
    rows = packets.select(F.to_json(key).alias("conversation"), F.timestamp_micros("ts_us").alias("_time"), *(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in PACKET.split(", ")))
    return rows.withWatermark("_time", delay).groupBy("conversation").transformWithStateInPandas(FlowTable(count, zeros, idle, active), FLOW, "Append", "EventTime")
