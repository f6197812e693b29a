"""Anonymised copies of JSON records: named leaves at any depth are coded, every other byte stays.

A line is cut at the values of the named leaves by a scanner of JSON tokens, so keys and quotes inside strings do not mislead it; the values are
coded by built-in functions, and the pieces are joined again. What is no JSON, and lines that are cut off, keep what could not be told apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquery.functions import scalar

TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]')
CUT = "struct<gaps:array<string>,names:array<string>,leaves:array<string>>"
MOST_NETWORKS = 10_000


def cut(line: str | None, names: frozenset[str]) -> tuple[list[str], list[str], list[str]] | None:
    """What is between the leaves, the key of each leaf, and the leaves: strings that are the value of a named key, or in an array of such values."""
    if line is None:
        return None
    gaps, keys, leaves = [], [], []
    outer: list[str | None] = []
    key, begin = None, 0
    for token in TOKEN.finditer(line):
        mark = token.group()
        if mark in "{[":
            outer.append(key)
            key = key if mark == "[" else None
        elif mark in "}]":
            key = outer.pop() if outer else None
        elif token.group(2) is not None:
            key = token.group(1)
        elif key in names:
            gaps.append(line[begin : token.start(1)])
            keys.append(key)
            leaves.append(token.group(1))
            begin = token.end(1)
    return [*gaps, line[begin:]], keys, leaves


def cut_column(line: Column, names: Sequence[str]) -> Column:
    """``cut`` as CUT."""
    wanted = frozenset(names)

    @F.pandas_udf("gaps array<string>, names array<string>, leaves array<string>")
    def batch(lines: pd.Series) -> pd.DataFrame:
        found = [cut(x, wanted) or (None, None, None) for x in lines]
        return pd.DataFrame(found, columns=["gaps", "names", "leaves"], dtype=object)

    return batch(line)


def rewrite(lines: DataFrame, names: Sequence[str], code: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """``lines`` with ``code`` of each named leaf in the place of its value; where it is null, the value stays."""
    found = lines.withColumn("_cut", cut_column(F.col(value), names))
    coded = F.concat(F.transform("_cut.leaves", lambda x: F.coalesce(code(x), x)), F.array(F.lit("")))
    whole = F.array_join(F.flatten(F.zip_with("_cut.gaps", coded, lambda gap, leaf: F.array(gap, leaf))), "")
    return found.withColumn(value, whole).drop("_cut")


def inside(nets: DataFrame) -> Callable[[Column], Column]:
    """Whether an address is in one of ``nets`` (cidr); there may be MOST_NETWORKS of them."""
    rows = nets.select("cidr").limit(MOST_NETWORKS + 1).collect()
    if len(rows) > MOST_NETWORKS:
        raise ValueError(f"more than {MOST_NETWORKS} networks")
    by_length: dict[int, list[str]] = {}
    for r in rows:
        network, _, bits = r.cidr.partition("/")
        by_length.setdefault(int(bits or 32), []).append(network)

    def told(address: Column) -> Column:
        parts = [scalar.masked(scalar.ipv4(address), F.lit(bits)).isin(*(_number(n) & (-1 << 32 - bits) for n in some)) for bits, some in by_length.items()]
        return F.coalesce(reduce(lambda a, b: a | b, parts, F.lit(False)), F.lit(False))

    return told


def _number(address: str) -> int:
    return int.from_bytes(bytes(map(int, address.split("."))))


def address_code(nets: DataFrame, key: str) -> Callable[[Column], Column]:
    """The code of an IPv4 address inside ``nets``; null for anything else. ``key``: 16, 24 or 32 characters."""
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 characters")
    within = inside(nets)
    return lambda x: F.when(within(x), scalar.anonymized(x, F.encode(F.lit(key), "UTF-8")))


def uncoded(lines: DataFrame, names: Sequence[str], nets: DataFrame, value: str = "value") -> DataFrame:
    """(name, leaf) of each named leaf that is still a plain address inside ``nets``, once an occurrence; columns of ``lines`` but ``value`` stay."""
    within = inside(nets)
    rest = [c for c in lines.columns if c != value]
    found = lines.select(*rest, cut_column(F.col(value), names).alias("_cut")).select(*rest, F.explode(F.arrays_zip(F.col("_cut.names").alias("name"), F.col("_cut.leaves").alias("leaf"))).alias("_x"))
    return found.select(*rest, "_x.name", "_x.leaf").where(within(F.col("leaf")))
