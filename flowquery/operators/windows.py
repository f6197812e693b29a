"""Order-dependent operators: gaps, interleaving, deltas, sessions, retransmissions, Markov chains."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_ms(groups: Sequence[str], micros: str, *ties: str) -> Column:
    """Whole milliseconds since the row before; 0 for the first."""
    before = F.lag(micros).over(Window.partitionBy(*groups).orderBy(micros, *ties))
    return F.coalesce(F.floor((F.col(micros) - before) / 1000), F.lit(0)).cast("long")


def first_n(df: DataFrame, groups: Sequence[str], n: int, *order: str) -> DataFrame:
    """The first n rows of each group. Groups are cut before they are shuffled, too."""
    at = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("n", at).where(F.col("n") <= n)


def interleave(a: DataFrame, b: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """Two ordered lists as one, with ``place`` from 1; of equals those of ``b`` come first."""
    both = a.withColumn("dir", F.lit(">")).unionByName(b.withColumn("dir", F.lit("<")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(order, "dir")))


def delta(groups: Sequence[str], value: str, *order: str) -> Column:
    """The first value as it is, then differences."""
    before = F.lag(value).over(Window.partitionBy(*groups).orderBy(*order))
    return F.col(value) - F.coalesce(before, F.lit(0))


def running_max(groups: Sequence[str], value: str, *order: str) -> Column:
    """The greatest value of the rows before."""
    return F.max(value).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def islands(df: DataFrame, groups: Sequence[str], value: str, *order: str) -> DataFrame:
    """``df`` with ``island``, which counts the changes of ``value`` so far."""
    w = Window.partitionBy(*groups).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w)).drop("_changed")


def messages(df: DataFrame, groups: Sequence[str], ack: str, length: str, micros: str, *order: str) -> DataFrame:
    """Runs of rows with one acknowledgement as messages: their rows, length and last time."""
    made = islands(df, groups, ack, *order).groupBy(*groups, "island")
    return made.agg(F.count("*").alias("packets"), F.sum(length).alias("length"), F.max(micros).alias("last"))


def retransmitted(groups: Sequence[str], sequence: str, back: int = 10, *order: str) -> Column:
    """Whether one of the ``back`` rows before has the same sequence number."""
    before = F.collect_list(sequence).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(-back, -1))
    return F.array_contains(before, F.col(sequence))


def markov(df: DataFrame, groups: Sequence[str], state: Column, *order: str) -> DataFrame:
    """(groups, prev, cur, n, p): transitions between successive states, and their share of those from ``prev``."""
    w = Window.partitionBy(*groups).orderBy(*order)
    steps = df.withColumn("cur", state).withColumn("prev", F.lag("cur").over(w)).where("prev IS NOT NULL")
    counted = steps.groupBy(*groups, "prev", "cur").agg(F.count("*").alias("n"))
    return counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*groups, "prev")))


def bucket(value: Column, width: int, states: int) -> Column:
    return F.least(F.floor(value / width), F.lit(states - 1)).cast("int")


def sessions(df: DataFrame, key: str, micros: str, idle: int, cap: int | None = None) -> DataFrame:
    """(key, start, end, n): a row starts a session when more than ``idle`` after the one before or, with ``cap``, after its start.

    Idle gaps are found by a window and sessions no longer than the cap are done with; only longer ones, whose
    cuts hang on one another, are walked in order.
    """
    w = Window.partitionBy(key).orderBy(micros)
    opens = F.coalesce((F.col(micros) - F.lag(micros).over(w) > idle).cast("int"), F.lit(1))
    marked = df.select(key, micros).withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w))
    runs = marked.groupBy(key, "_island").agg(F.min(micros).alias("start"), F.max(micros).alias("end"), F.count("*").alias("n"))
    if cap is None:
        return runs.drop("_island")
    short = runs.where(F.col("end") - F.col("start") <= cap).drop("_island")
    long = runs.where(F.col("end") - F.col("start") > cap).select(key, "_island")
    return short.unionByName(walked(marked.join(long, [key, "_island"]), [key, "_island"], micros, cap).drop("_island"))


def walked(rows: DataFrame, groups: Sequence[str], micros: str, cap: int) -> DataFrame:
    """(groups, start, end, n): each group cut where a row comes more than ``cap`` after the start of its session.

    Sorted rows stream through their task, which holds one batch and the open session, however long a group is.
    """
    schema = rows.select(*groups, F.col(micros).cast("long").alias("start"), F.col(micros).cast("long").alias("end"), F.lit(1).cast("long").alias("n")).schema
    names = schema.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        out: list[list] = []
        kinds: list = []
        for batch in batches:
            kinds = batch.schema.types[:-1] + [pa.int64()] * 3
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            for group, t in zip(keys, batch.columns[-1].to_pylist(), strict=True):
                if now is not None and now[0] == group and t - now[1] <= cap:
                    now[2], now[3] = t, now[3] + 1
                else:
                    if now is not None:
                        out.append(now)
                    now = [group, t, t, 1]
            if out:
                yield _sessions(out, kinds, names)
                out = []
        if now is not None:
            yield _sessions([now], kinds, names)

    ordered = rows.select(*groups, F.col(micros).cast("long").alias(micros)).repartition(*groups).sortWithinPartitions(*groups, micros)
    return ordered.mapInArrow(walk, schema)


def _sessions(found: list[list], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = [*zip(*(x[0] for x in found), strict=True), *zip(*(x[1:] for x in found), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def run_length_decoded(values: Column) -> Column:
    """A negative number repeats the value before it that many times; -32768 ends the list."""
    at = F.array_position(values, F.lit(-32768).cast("int")).cast("int")
    used = F.when(at > 0, F.slice(values, 1, at - 1)).otherwise(values)
    one = lambda x, i: F.when(x >= 0, F.array(x)).when(i > 0, F.array_repeat(F.element_at(used, i), -x))
    return F.flatten(F.filter(F.transform(used, one), lambda x: x.isNotNull()))
