"""From capture files to flow records, as ``config.Options`` say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquery.config import Options
from flowquery.features import registry
from flowquery.functions import scalar
from flowquery.ml import features as vectors
from flowquery.operators import flows, joins, lookups
from flowquery.operators.keys import FIVE
from flowquery.sinks import model
from flowquery.sources import pcap, subnets
from flowquery.storage import written

#: How captures of the next generation begin: they are told from flow files, and refused.
PCAPNG = b"\x0a\x0d\x0d\x0a"


def captures_among(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """The files that ``paths`` name, by their first bytes: captures, and others."""
    files = [path for path, _ in pcap.found_files(spark, *paths)]
    told = {path: pcap.first_bytes(spark, path) in (*pcap.MAGIC, PCAPNG) for path in files}
    return [p for p in files if told[p]], [p for p in files if not told[p]]


def records(spark: SparkSession, paths: Sequence[str], options: Options) -> DataFrame:
    return from_packets(pcap.packets(pcap.read(spark, *paths)), options)


def from_packets(packets: DataFrame, options: Options) -> DataFrame:
    """The flow records of decoded packets: filter, sessions, counters, byte statistics, features, labels, score, anonymised addresses."""
    if options.bpf:
        packets = packets.where(pcap.bpf(options.bpf))
    spark, timers = packets.sparkSession, {"idle": options.idle * 1_000_000, "active": options.active * 1_000_000}
    features = [f for f in options.features if f in registry.REGISTRY]
    if features or options.dist or options.entropy:  # packets are put into records once for all that needs them
        packets = written(flows.numbered(packets, both=options.bidir, **timers), "packets")
    out = flows.build(packets, both=options.bidir, count=options.num_pkts, zeros=options.zeros, **timers)
    if not options.retrans:
        out = out.drop("tcp_retrans")
    out = out.withColumns({c: F.substring(c, 1, options.idp) for c in ("idp_out",)}) if options.idp else out.drop("idp_out")
    if options.dist or options.entropy:
        found = flows.byte_statistics(packets, options.bidir, **timers)
        counted = out if not (options.model and options.dist) else _with_counts(out, found)
        out = _with_bytes(counted, found, options)
    if options.model:
        out = _scored(out, model.read(spark, options.model), model.read(spark, options.model_bytes) if options.model_bytes else None)
    out = registry.attach(out, packets, features, most=options.stream_bytes, both=options.bidir, **timers)
    if options.protocols:
        out = lookups.named(out, F.col("pr"), lookups.read_names(spark, options.protocols), "protocol")
    for entry in options.label:
        name, _, path = entry.partition(":")
        out = _labelled(out, subnets.read(spark, path, name))
    if options.anon:
        out = _anonymized(out, subnets.read(spark, options.anon, "inside"), options.key)
    return out


def _with_bytes(out: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """Byte statistics of the side that is the source."""
    kept = [*(["byte_dist", "byte_dist_mean", "byte_dist_std"] if options.dist else []), *(["be", "tbe"] if options.entropy else [])]
    named = found.select(*(F.col(c).alias(f"_{c}") for c in FIVE), F.col("session").alias("_session"), *kept)
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FIVE] + [F.col("time_start") == F.col("_session")]
    return out.join(named, keys, "left").drop("_session", *(f"_{c}" for c in FIVE))


def _with_counts(out: DataFrame, found: DataFrame) -> DataFrame:
    """``_counts``: the 256 counters of both directions' bytes."""
    none = F.array_repeat(F.lit(0).cast("long"), 256)
    back = dict(zip(FIVE, ("da", "sa", "dp", "sp", "pr"), strict=True))
    for side, names in (("_own", {c: c for c in FIVE}), ("_other", back)):
        named = found.select(*(F.col(c).alias(f"_{names[c]}") for c in FIVE), F.col("session").alias("_session"), F.col("byte_dist").alias(side))
        keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FIVE] + [F.col("time_start") == F.col("_session")]
        keys += [F.col("bytes_in").isNotNull()] if side == "_other" else []  # a one-way record has no other side
        out = out.join(named, keys, "left").drop("_session", *(f"_{c}" for c in FIVE))
    return out.withColumn("_counts", F.zip_with(F.coalesce("_own", none), F.coalesce("_other", none), lambda a, b: a + b)).drop("_own", "_other")


def _scored(out: DataFrame, plain: list[float], with_bytes: list[float] | None) -> DataFrame:
    """``p_malware``, by the weights for byte shares where there are counters and enough bytes."""
    v = vectors.flow_vector(*(F.col(c) for c in ("packets", "dp", "sp", "num_pkts_in", "num_pkts_out", "bytes_in", "bytes_out")))
    if "_counts" not in out.columns:
        return out.withColumn("p_malware", vectors.p_malware(v, F.lit(None), plain))
    shares = vectors.byte_shares(F.col("_counts"), F.col("bytes_in"), F.col("bytes_out"))
    return out.withColumn("p_malware", vectors.p_malware(v, shares, plain, with_bytes)).drop("_counts")


def _labelled(out: DataFrame, nets: DataFrame) -> DataFrame:
    """``sa_labels`` and ``da_labels``: the labels of the networks that hold an address."""
    nets = joins.subnets(nets)
    for side in ("sa", "da"):
        found = joins.labels(out, side, nets).withColumnsRenamed({side: f"_{side}", "labels": "_labels"})
        own = f"{side}_labels"
        before = F.coalesce(own, F.array().cast("array<string>")) if own in out.columns else F.array().cast("array<string>")
        out = out.join(found, F.col(side) == F.col(f"_{side}"), "left")
        out = out.withColumn(own, F.array_sort(F.array_union(before, F.coalesce("_labels", F.array().cast("array<string>"))))).drop(f"_{side}", "_labels")
    return out


def _anonymized(out: DataFrame, nets: DataFrame, key: str) -> DataFrame:
    """Addresses inside ``nets`` as codes."""
    if len(key) not in (16, 24, 32):
        raise ValueError("anon needs a key of 16, 24 or 32 characters")
    marked = _labelled(out.drop("sa_labels", "da_labels"), nets)
    code = lambda c: F.when(F.size(f"{c}_labels") > 0, scalar.anonymized(F.col(c), F.encode(F.lit(key), "UTF-8"))).otherwise(F.col(c))
    return marked.withColumns({c: code(c) for c in ("sa", "da")}).drop("sa_labels", "da_labels")
