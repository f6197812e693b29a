"""Stitching: the records of one conversation, in either direction, become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowquery.operators.aggregates import sum_arrays
from flowquery.operators.keys import FIVE, canonical, forward

#: Counters and their likes of the other direction.
COUNTERS = {"bytes_out": "bytes_in", "bytes_in": "bytes_out", "num_pkts_out": "num_pkts_in", "num_pkts_in": "num_pkts_out"}


def stitch(flows: DataFrame, order: str = "seq", within: tuple[str, ...] = (), both: bool = True) -> DataFrame:
    """One row for each key (a five-tuple, or with ``both`` also its reverse), directed as its first record.

    Counters are summed, those of reversed records crosswise; ``time_end`` is the greatest, ``byte_dist`` is summed by
    element, and any other column keeps its first value. All are aggregates that combine before
    the one shuffle by key.
    """
    pairs = {k: v for k, v in COUNTERS.items() if k in flows.columns or v in flows.columns}
    rows = flows.withColumn("_key", canonical() if both else F.struct(*FIVE)).withColumn("_dir", forward())
    keys = (*within, "_key")

    def counter(name: str, direction: bool) -> Column:
        """The sum of ``name`` seen from records of ``direction``."""
        own = F.col(name) if name in flows.columns else F.lit(None).cast("long")
        other = F.col(pairs[name]) if pairs[name] in flows.columns else F.lit(None).cast("long")
        return F.sum(F.when(F.col("_dir") == direction, own).otherwise(other)) if both else F.sum(own)

    first = F.min_by("_dir", order).alias("_first")
    sums = [counter(n, d).alias(f"_{n}_{d}") for n in pairs for d in (True, False)]
    special = {*pairs, "time_end", "byte_dist", *within}
    kept = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in flows.columns if c not in special and c not in FIVE]
    tuples = [F.min_by(c, order).alias(c) for c in FIVE]
    ends = [F.max("time_end").alias("time_end")] if "time_end" in flows.columns else []
    out = rows.groupBy(*keys).agg(first, *tuples, *kept, *ends, *sums)
    out = out.withColumns({n: F.when(F.col("_first"), F.col(f"_{n}_True")).otherwise(F.col(f"_{n}_False")) for n in pairs})
    if "byte_dist" in flows.columns and isinstance(flows.schema["byte_dist"].dataType, ArrayType):
        out = out.join(sum_arrays(rows, keys, "byte_dist"), list(keys), "left")
    drop = [f"_{n}_{d}" for n in pairs for d in (True, False)]
    return out.drop("_key", "_first", *drop)
