"""What a user adds: named predicates, and processors that make rows of rows.

A predicate gives a condition over a record's columns, a processor a DataFrame from a DataFrame; both become part of the query's plan, so
Spark prunes and pushes down through them as through the rest. What they are given and give is checked when the query is put together.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

PREDICATES: dict[str, Callable[..., Column]] = {}


@dataclass(frozen=True)
class Processor:
    """``run``: rows to rows. ``needs``: columns that must be there; ``gives``: the schema of what comes out, if it is known, as DDL."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    gives: str | None = None


PROCESSORS: dict[str, Processor] = {}


def predicate(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    """Register a function of no argument, or of text behind a colon (``name:text``), that gives a condition."""

    def put(function: Callable[..., Column]) -> Callable[..., Column]:
        PREDICATES[name] = function
        return function

    return put


def processor(name: str, needs: Sequence[str] = (), gives: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a function from DataFrame to DataFrame."""

    def put(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        PROCESSORS[name] = Processor(name, function, tuple(needs), gives)
        return function

    return put


def keep(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """The rows for which each named predicate (``name`` or ``name:text``) holds; null counts as false."""
    for word in words:
        name, colon, text = word.partition(":")
        if name not in PREDICATES:
            raise ValueError(f"no such predicate: {name}; there are {sorted(PREDICATES)}")
        condition = PREDICATES[name](text) if colon else PREDICATES[name]()
        kind = df.select(condition.alias("c")).schema["c"].dataType.simpleString()
        if kind != "boolean":
            raise TypeError(f"predicate {name} gives {kind}, not a condition")
        df = df.where(condition)
    return df


def process(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows that each named processor makes, one after the other."""
    for name in names:
        if name not in PROCESSORS:
            raise ValueError(f"no such processor: {name}; there are {sorted(PROCESSORS)}")
        one = PROCESSORS[name]
        lacking = [c for c in one.needs if c not in df.columns]
        if lacking:
            raise ValueError(f"processor {name} needs {', '.join(lacking)}")
        df = one.run(df)
        if one.gives is not None:
            wanted = [(f.name, f.dataType) for f in StructType.fromDDL(one.gives)]
            if [(f.name, f.dataType) for f in df.schema] != wanted:
                raise TypeError(f"processor {name} gives {df.schema.simpleString()}, not {one.gives}")
    return df


def load(path: str) -> None:
    """Run a Python file that registers predicates, processors or features."""
    spec = importlib.util.spec_from_file_location("flowquery_extension", path)
    if spec is None:
        raise FileNotFoundError(path)
    spec.loader.exec_module(importlib.util.module_from_spec(spec))
