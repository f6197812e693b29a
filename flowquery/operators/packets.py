"""Per-packet features: packet information, messages, header masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquery.functions.scalar import tcp_flags
from flowquery.operators.keys import FIVE, canonical
from flowquery.operators.windows import islands


def packet_information(packets: DataFrame, count: int = 50) -> DataFrame:
    """(five-tuple of the packet, place, dir, b, olen, flags, t, seq, ack, rseq, rack): a conversation's first packets.

    ``dir`` is ">" for the side that sent the first packet. Relative numbers are over the greatest so far of the
    direction; the first of a direction is 0, and an acknowledgement is relative to what the other side has sent.
    """
    rows = packets.where("pr = 6").withColumn("_key", canonical())
    flow = Window.partitionBy("_key").orderBy("ts_us", "seq")
    ends = F.struct("sa", "sp")
    rows = rows.withColumn("_out", ends.eqNullSafe(F.first(ends).over(flow))).withColumn("place", F.row_number().over(flow))
    own = Window.partitionBy("_key", "_out").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = flow.rowsBetween(Window.unboundedPreceding, -1)
    sent = [F.max(F.when(F.col("_out") == side, F.col("tcp_seq"))).over(before) for side in (True, False)]
    other = F.when(F.col("_out"), sent[1]).otherwise(sent[0])
    start = F.min("ts_us").over(Window.partitionBy("_key"))
    return rows.select(
        *FIVE, "place", F.when(F.col("_out"), ">").otherwise("<").alias("dir"), F.octet_length("payload").alias("b"), F.octet_length("opts").alias("olen"),
        tcp_flags(F.col("flags")).alias("flags"), F.floor((F.col("ts_us") - start) / 1000).cast("long").alias("t"), F.col("tcp_seq").alias("seq"), "ack",
        (F.col("tcp_seq") - F.coalesce(F.max("tcp_seq").over(own), F.col("tcp_seq"))).alias("rseq"), (F.col("ack") - F.coalesce(other, F.col("ack"))).alias("rack"),
    ).where(F.col("place") <= count)


def messages(packets: DataFrame) -> DataFrame:
    """(five-tuple, message, length, last): successive packets of a direction with one acknowledgement number are one message."""
    rows = islands(packets.where("pr = 6").where(F.octet_length("payload") > 0), FIVE, "ack", "ts_us", "seq")
    return rows.groupBy(*FIVE, F.col("island").alias("message")).agg(F.sum(F.octet_length("payload")).cast("long").alias("length"), F.max("ts_us").alias("last"))


def header_masks(packets: DataFrame, size: int = 32, most: int = 10) -> DataFrame:
    """(five-tuple, pos, constant, value, sequence, n): of the first payloads, by byte, the bits that stay, their values, and whether the byte rises by 1 each time."""
    first = Window.partitionBy(*FIVE).orderBy("ts_us", "seq")
    rows = packets.where(F.octet_length("payload") > 0).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    pairs = F.regexp_extract_all(F.hex(F.substring("payload", 1, size)), F.lit("(..)"), F.lit(1))
    cells = rows.select(*FIVE, "_n", F.posexplode(pairs).alias("pos", "_p")).withColumn("_b", F.conv("_p", 16, 10).cast("int"))
    step = F.pmod(F.col("_b") - F.lag("_b").over(Window.partitionBy(*FIVE, "pos").orderBy("_n")), F.lit(256)) == 1
    every, some = F.bit_and("_b"), F.bit_or("_b")
    mask = F.lit(255).bitwiseXOR(every.bitwiseXOR(some))
    grouped = cells.withColumn("_s", step).groupBy(*FIVE, "pos")
    return grouped.agg(mask.alias("constant"), every.bitwiseAND(mask).alias("value"), F.coalesce(F.bool_and("_s"), F.lit(False)).alias("sequence"), F.count("*").alias("n")).where("n > 1")


def padded_lists(lists: DataFrame, name: str, size: int, pad: int) -> DataFrame:
    """``lists`` with the array ``name`` cut or padded to ``size`` entries, as fixed-width exports need."""
    return lists.withColumn(name, F.slice(F.concat(name, F.array_repeat(F.lit(pad), size)), 1, size))
