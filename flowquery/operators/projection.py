"""Select, normalize, apply and enrich."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquery import compile as c
from flowquery.path import Item, parse_template


def _template(template: str | tuple[Item, ...]) -> tuple[Item, ...]:
    return parse_template(template) if isinstance(template, str) else template


def select(df: DataFrame, template: str | tuple[Item, ...]) -> DataFrame:
    """Only the template's paths, nested as they were. Rows that have none of them go."""
    out = df.select(c.select(df.schema, _template(template)))
    if not out.columns:
        return out.limit(0)
    return out.where(reduce(lambda a, b: a | b, (F.col(f"`{x}`").isNotNull() for x in out.columns)))


def apply(df: DataFrame, template: str | tuple[Item, ...], function: Callable[[Column], Column]) -> DataFrame:
    """``function`` of every addressed leaf, which keeps its type; all else as it was."""
    return df.withColumns(dict(c.change(c._Row(df.schema), _template(template), function)))


def normalize(df: DataFrame, template: str | tuple[Item, ...]) -> DataFrame:
    """Every addressed leaf null; the structure stays."""
    return apply(df, template, lambda _: F.lit(None))


def enrich(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column ``name``, null where ``value`` is empty (zero, an empty string or an empty array)."""
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    empty = F.size(value) == 0 if kind in ("array", "map") else value == F.lit("" if kind == "string" else 0)
    return df.withColumn(name, F.when(~F.coalesce(empty, F.lit(True)), value))


def enrich_into(df: DataFrame, name: str, **fields: Column) -> DataFrame:
    """``fields`` put into the struct ``name``; they win over fields of that name."""
    made = reduce(lambda s, kv: s.withField(*kv), fields.items(), F.col(name))
    return df.withColumn(name, F.when(F.col(name).isNotNull(), made))
