"""Sums over the bytes of a value, by numpy in Arrow batches: a row of counts for each value, not a row for each byte."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", np.uint8)


def counts(data: Column) -> Column:
    """array<struct<byte, n>>: how often each byte that occurs does."""

    @F.pandas_udf("array<struct<byte:int,n:bigint>>")
    def histogram(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            n = np.bincount(_codes(v), minlength=256)
            out.append([{"byte": int(b), "n": int(n[b])} for b in np.flatnonzero(n)])
        return pd.Series(out)

    return histogram(data)


def quad_sums(data: Column) -> Column:
    """array of 5 numbers: the sums of the bytes at places 0 to 3 of each whole quad, and the bytes in whole quads."""

    @F.pandas_udf("array<bigint>")
    def sums(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            quads = _codes(v)[: len(v or b"") // 4 * 4].reshape(-1, 4)
            out.append([*quads.sum(axis=0, dtype=np.int64).tolist(), quads.size])
        return pd.Series(out)

    return sums(data)
