"""Grouping: distributions, sums, element-wise sums, histograms, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from flowquery.functions import bytewise


def clustered(df: DataFrame, groups: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows as they are, those of a group together."""
    return df.repartition(*groups).sortWithinPartitions(*groups, *order)


def distribution(df: DataFrame, groups: Sequence[str] = (), by: Sequence[str] | None = None) -> DataFrame:
    """Each distinct row with its ``count`` and the ``total`` of its group, the most frequent first."""
    columns = list(by or df.columns)
    counted = df.groupBy(*dict.fromkeys([*groups, *columns])).agg(F.count("*").alias("count"))
    # Totals come from the counts, a row a distinct value, so no window holds a group's rows.
    if groups:
        totals = counted.groupBy(*groups).agg(F.sum("count").alias("total"))
        keys = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
        counted = counted.alias("a").join(totals.alias("b"), keys).select("a.*", "b.total")
    else:
        counted = counted.crossJoin(F.broadcast(counted.agg(F.sum("count").alias("total"))))  # one row
    return counted.orderBy(F.desc("count"), *columns)


def sums(df: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per group: sums of numbers and of arrays by element, the distinct values of other columns, and ``sum_over``, the number of rows."""
    out = []
    for f in df.schema:
        if f.name in groups:
            continue
        if f.name in names and isinstance(f.dataType, NumericType):
            out.append(F.sum(f.name).alias(f.name))
        elif f.name not in names or not isinstance(f.dataType, ArrayType):
            out.append(F.array_sort(F.collect_set(f.name)).alias(f.name))
    flat = df.groupBy(*groups).agg(F.count("*").alias("sum_over"), *out)
    for f in df.schema:
        if f.name in names and isinstance(f.dataType, ArrayType):
            part = sum_arrays(df, groups, f.name)
            flat = flat.join(part, list(groups), "left") if groups else flat.crossJoin(F.broadcast(part))
    return flat


def sum_by_position(df: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """(groups, pos, value): element-wise sums, as far as the group's shortest array reaches."""
    elements = df.select(*groups, F.posexplode(name).alias("pos", "x")).groupBy(*groups, "pos").agg(F.sum("x").alias("value"), F.count("*").alias("n"))
    rows = df.where(F.col(name).isNotNull()).groupBy(*groups).agg(F.min(F.size(name)).alias("shortest"))
    joined = elements.join(rows, list(groups)) if groups else elements.crossJoin(F.broadcast(rows))
    return joined.where(F.col("pos") < F.col("shortest")).drop("n", "shortest")


def sum_arrays(df: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """The same as one array a group. Partial sums are shuffled, not arrays."""
    rows = sum_by_position(df, groups, name)
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return rows.groupBy(*groups).agg(F.transform(pairs, lambda x: x["value"]).alias(name))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hex_pairs(text: Column) -> Column:
    """The bytes of a string as two hex digits each."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))


def bytes_of(df: DataFrame, groups: Sequence[str], text: str, most: int | None = None) -> DataFrame:
    """(groups, pos, byte) of each byte of ``text``, the first ``most`` only if given."""
    source = F.col(text) if most is None else F.substring(F.encode(text, "UTF-8"), 1, most)
    pairs = hex_pairs(F.col(text)) if most is None else F.regexp_extract_all(F.hex(source), F.lit("(..)"), F.lit(1))
    rows = df.select(*groups, F.posexplode(pairs).alias("pos", "pair"))
    return rows.select(*groups, "pos", F.conv("pair", 16, 10).cast("int").alias("byte"))


def byte_histogram(df: DataFrame, groups: Sequence[str], text: str, most: int | None = None) -> DataFrame:
    """(groups, byte, n): how often each byte of ``text``, or of its first ``most``, occurs.

    Bytes are counted value by value, so at most 256 rows a value are summed, map-side first.
    """
    return byte_histogram_of(df, groups, F.encode(text, "UTF-8") if most is None else F.substring(F.encode(text, "UTF-8"), 1, most))


def byte_histogram_of(df: DataFrame, groups: Sequence[str], data: Column) -> DataFrame:
    """(groups, byte, n) of binary ``data``."""
    cells = df.select(*groups, F.explode(bytewise.counts(data)).alias("c"))
    return cells.groupBy(*groups, F.col("c.byte").alias("byte")).agg(F.sum("c.n").alias("n"))


def compact_histogram(histogram: DataFrame, groups: Sequence[str], bins: DataFrame) -> DataFrame:
    """(groups, bin, n): a histogram over the classes of ``bins`` (byte, bin), which has 256 rows."""
    return histogram.join(F.broadcast(bins), "byte").groupBy(*groups, "bin").agg(F.sum("n").alias("n"))


def byte_statistics(df: DataFrame, groups: Sequence[str], text: str) -> DataFrame:
    """Mean and sample deviation of the bytes, entropy in bits, and entropy times their number."""
    hist = byte_histogram(df, groups, text)
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("byte")) / total
    square = F.sum(F.col("n") * F.col("byte") * F.col("byte"))
    spread = F.when(total > 1, F.sqrt(F.greatest((square - total * mean * mean) / (total - 1), F.lit(0.0))))
    bits = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return hist.groupBy(*groups).agg(total.alias("n"), mean.alias("mean"), spread.alias("std"), bits.alias("entropy"), (bits * total).alias("total_entropy"))


def walsh4(df: DataFrame, groups: Sequence[str], text: str) -> DataFrame:
    """The four-point Walsh-Hadamard spectrum over whole quads of bytes, by the number of bytes in them."""
    sums = df.select(*groups, bytewise.quad_sums(F.encode(text, "UTF-8")).alias("q"))
    at = [F.sum(F.col("q")[i]) for i in range(4)]
    n = F.sum(F.col("q")[4])
    signs = {"s0": (1, 1, 1, 1), "s1": (1, -1, 1, -1), "s2": (1, 1, -1, -1), "s3": (1, -1, -1, 1)}
    return sums.groupBy(*groups).agg(*((sum(x * k for x, k in zip(at, s, strict=True)) / n).alias(name) for name, s in signs.items()), n.alias("n")).where("n > 0").drop("n")


def bit_reduced(counts: Column) -> Column:
    """All counters shifted right alike until the largest fits eight bits."""
    largest = F.array_max(counts)
    return F.transform(counts, lambda x: F.call_function("shiftright", x, F.greatest(F.lit(0), F.length(F.bin(largest)) - 8)))


def constant_mask(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, pos, mask, value) from (pos, byte): the bits that all rows share at each position, and their values."""
    every, some = F.bit_and("byte"), F.bit_or("byte")
    mask = F.lit(255).bitwiseXOR(every.bitwiseXOR(some))
    return rows.groupBy(*groups, "pos").agg(mask.alias("mask"), every.bitwiseAND(mask).alias("value"))


def prevalence(df: DataFrame, key: str, process: str) -> DataFrame:
    """(key, process, count, prevalence): each process's share of its key's rows, of two decimals."""
    counted = df.groupBy(key, process).agg(F.count("*").alias("count"))
    share = F.round(F.col("count") / F.sum("count").over(Window.partitionBy(key)), 2)
    return counted.withColumn("prevalence", share)


def client_rollup(df: DataFrame, client: str, key: str, weights: DataFrame, process: str, unknown: float = 0.1) -> DataFrame:
    """(client, process, weight): shares of processes over a client's distinct keys, the processes of a key by prevalence.

    ``weights``: (key, process, prevalence). A key without any counts ``unknown`` for "Unknown". Where all of a client's prevalences
    are zero (of very many processes each rounds to it), their shares are 0 / 0, NaN.
    """
    seen = df.select(client, key).distinct().join(weights, key, "left")
    named = seen.select(client, F.coalesce(process, F.lit("Unknown")).alias(process), F.coalesce("prevalence", F.lit(unknown)).alias("p"))
    summed = named.groupBy(client, process).agg(F.sum("p").alias("p"))
    total = F.sum("p").over(Window.partitionBy(client))
    return summed.select(client, process, F.when(total == 0, F.lit(float("nan"))).otherwise(F.col("p") / total).alias("weight"))
