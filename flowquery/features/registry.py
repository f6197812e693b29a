"""Which features a flow gets: what each applies to, and what it makes of the bytes of a direction."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquery.features import dhcp, dns, fingerprints, http, ike, ssh, tls
from flowquery.operators import flows
from flowquery.operators.keys import FIVE, canonical


def on(protocol: int, *ports: int) -> Column:
    """Flows of a protocol with one of ``ports`` on either side."""
    return F.coalesce((F.col("pr") == protocol) & (F.col("sp").isin(*ports) | F.col("dp").isin(*ports)), F.lit(False))


@dataclass(frozen=True)
class Feature:
    """``applies``: a condition on the five-tuple; ``decode``: a column function of the bytes that one direction sent.

    ``merge``: a function of both directions' pieces (arrays of at, ts_us, seq, data) and the record's start, to a struct whose fields stand beside ``out`` and ``in``.
    ``relate``: the same of what was decoded from both directions. ``pair``: the same of the bytes that both sent.
    """

    name: str
    applies: Callable[[], Column]
    decode: Callable[[Column], Column]
    merge: Callable[[Column, Column, Column], Column] | None = None
    relate: Callable[[Column, Column], Column] | None = None
    pair: Callable[[Column, Column], Column] | None = None


REGISTRY: dict[str, Feature] = {}


def register(feature: Feature) -> None:
    """Add a feature, or replace that of its name."""
    REGISTRY[feature.name] = feature


for _feature in (
    Feature("http", lambda: on(6, 80, 8080), http.parse),
    Feature("tls", lambda: on(6, 443), tls.parse, tls.timeline),
    Feature("fpx", lambda: on(6, 443), fingerprints.payload),
    Feature("dns", lambda: on(17, 53), dns.parse),
    Feature("ssh", lambda: on(6, 22), ssh.parse, pair=lambda a, b: F.struct(ssh.parse_exchange(a, b).alias("exchange"))),
    Feature("dhcp", lambda: on(17, 67, 68), dhcp.parse),
    Feature("ike", lambda: on(17, 500, 4500), ike.parse_all, relate=lambda a, b: F.struct(ike.agreed(a, b).alias("agreed"))),
    Feature("payload", lambda: F.lit(True), lambda data: F.lower(F.hex(F.substring(data, 1, 32)))),
):
    register(_feature)


def attach(records: DataFrame, packets: DataFrame, names: Iterable[str], most: int = flows.STREAM_BYTES, idle: int = flows.IDLE, active: int = flows.ACTIVE, both: bool = True) -> DataFrame:
    """``records`` of ``flows.build`` with, for each named feature, a struct of what either direction's bytes gave: (out, in).

    The timers and ``both`` are those of ``records``; one-way records have nothing in ``in``. Bytes (``most`` of a direction, 0: all) are put together once for all features; a decoder
    runs only where its feature applies.
    """
    wanted = [REGISTRY[n] for n in names]
    if not wanted:
        return records
    sent = flows.streams(packets, most, idle, active, both, True)
    sides = sent.groupBy(F.col("_key").alias("_of"), F.col("session").alias("_session")).agg(F.collect_list(F.struct("sa", "sp", "pieces")).alias("_sides"))  # two at most
    key = canonical() if both else F.struct(*FIVE)
    records = records.withColumn("_key", key)
    records = records.join(sides, (F.col("_key") == F.col("_of")) & (F.col("time_start") == F.col("_session")), "left").drop("_key", "_of", "_session")
    for side, (address, port) in (("out", ("sa", "sp")), ("in", ("da", "dp"))):
        own = F.lit(both or side == "out")
        sent_it = lambda x: own & x["sa"].eqNullSafe(F.col(address)) & x["sp"].eqNullSafe(F.col(port))  # noqa: B023, E731  used at once
        records = records.withColumn(f"_{side}_pieces", F.get(F.filter("_sides", sent_it), F.lit(0))["pieces"])
        records = records.withColumn(f"_{side}", flows.joined(F.col(f"_{side}_pieces"), most))
    records = records.drop("_sides")
    for f in wanted:
        part = lambda data, f=f: F.when(f.applies(), F.col(data))
        sides = [f.decode(part("_out")).alias("out"), f.decode(part("_in")).alias("in")]
        records = records.withColumn(f.name, F.struct(*sides))
        decoded = [F.col(f"{f.name}.{side}") for side in ("out", "in")]
        beside = {"_merged": f.merge and f.merge(part("_out_pieces"), part("_in_pieces"), F.col("time_start")), "_related": f.relate and f.relate(*decoded), "_paired": f.pair and f.pair(part("_out"), part("_in"))}
        beside = {name: found for name, found in beside.items() if found is not None}
        if beside:
            records = records.withColumns(beside)
            more = [F.col(f"{name}.{n}").alias(n) for name in beside for n in records.schema[name].dataType.names]
            records = records.withColumn(f.name, F.struct(decoded[0].alias("out"), decoded[1].alias("in"), *more)).drop(*beside)
    return records.drop("_out", "_in", "_out_pieces", "_in_pieces")
