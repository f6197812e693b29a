"""Many patterns at once, by built-in functions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,stop:int,pattern:string>>"


def places(text: Column, pattern: str) -> Column:
    """Where ``pattern`` starts in ``text``, also where matches overlap: the text is split before each."""
    pieces = F.split(text, f"(?={re.escape(pattern)})", -1)
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + F.char_length(x)))
    starts = F.slice(F.reduce(pieces, F.array(F.lit(0)), add), 1, F.size(pieces))
    return F.when(text.startswith(pattern), starts).otherwise(F.slice(starts, 2, F.size(starts)))


def _spans(text: Column, pattern: str, longer: list[str]) -> Column:
    """The matches of ``pattern`` that are not the end of a match of one of ``longer``."""
    n = len(pattern)
    spans = F.transform(places(text, pattern), lambda at: F.struct(at.alias("start"), (at + n - 1).alias("stop"), F.lit(pattern).alias("pattern")))
    within = lambda s: reduce(lambda a, b: a | b, [(s["stop"] + 1 >= len(q)) & (F.substring(text, s["stop"] - len(q) + 2, F.lit(len(q))) == q) for q in longer])
    return F.filter(spans, lambda s: ~within(s)) if longer else spans


def find_all(text: Column, patterns: Iterable[str]) -> Column:
    """(start, stop, pattern) of all matches, by where they end; of those that end at one place the longest alone.

    A match is not the longest where a pattern that ends on it does, too; which patterns those are is known beforehand.
    """
    patterns = sorted({p for p in patterns if p})
    found = [_spans(text, p, [q for q in patterns if q != p and q.endswith(p)]) for p in patterns]
    all_spans = F.flatten(F.array(*found)) if found else F.array()
    by_stop = lambda a, b: a["stop"] - b["stop"]
    return F.when(F.char_length(text) > 0, F.array_sort(all_spans, by_stop)).otherwise(F.array()).cast(MATCHES)
