"""Per-flow protocol features: bytes in, nested values out.

A decoder is a small parser for one payload, run by Arrow-batched UDFs where Spark has dealt out the packets; what is
malformed or cut off ends a list or gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def decoder(parse: Callable[..., object], schema: str) -> Callable[..., Column]:
    """A column function from a parser of one payload, or of several side by side; failures give null, and nulls alone do."""

    def one(*payloads: bytes | None):
        if all(x is None for x in payloads):
            return None
        try:
            return parse(*payloads)
        except (IndexError, ValueError, UnicodeError):
            return None

    def column(*payloads: Column) -> Column:
        @F.pandas_udf(StructType.fromDDL(f"v {schema}"))
        def batch(*columns: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"v": [one(*x) for x in zip(*columns, strict=True)]}, dtype=object)

        return batch(*payloads)["v"]

    return column


class Reader:
    """Big-endian fields of bytes, one after another; past the end is an IndexError."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else min(end, len(data))

    def __bool__(self) -> bool:
        return self.at < self.end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise IndexError("past the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n))

    def part(self, n: int) -> bytes:
        """What a length of n bytes announces."""
        return self.take(self.number(n))
