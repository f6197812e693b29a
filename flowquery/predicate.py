"""The predicate language: comparisons joined by ``,`` (and) and ``|`` (or, which binds tighter)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from flowquery.path import Item, parse_path

OPERATORS = "=~<>"
TOKEN = re.compile(r"[(),|]|[^(),|]+")


class PredicateError(ValueError):
    pass


@dataclass(frozen=True)
class Comparison:
    path: Item
    op: str
    literal: int | float | str
    text: str


@dataclass(frozen=True)
class Junction:
    """``op``: "," or "|"."""

    op: str
    parts: tuple[Comparison | Junction, ...]


def literal(text: str) -> int | float | str:
    """Digits are an integer, what reads as a number is one, all else is a pattern."""
    if text.isascii() and text.isdigit():
        return int(text)
    try:
        return float(text)
    except ValueError:
        return text


def comparison(text: str) -> Comparison:
    # name[{leaf>1}] stands for name[{leaf}]>1
    if inner := re.fullmatch(rf"(.*?)([{OPERATORS}])([^{OPERATORS}{{}}\[\]]+)([}}\]]+)", text):
        text = inner[1] + inner[4] + inner[2] + inner[3]
    found = re.fullmatch(rf"([^{OPERATORS}]+)([{OPERATORS}])(.+)", text)
    if not found or found[3][0] in OPERATORS:
        raise PredicateError(f"not a comparison: {text!r} (there is =, ~, < and >)")
    return Comparison(parse_path(found[1]), found[2], literal(found[3]), found[3])


def _tokens(text: str) -> list[str]:
    """As TOKEN, but commas within braces belong to the comparison, where they are refused."""
    out: list[str] = []
    depth = 0
    for t in TOKEN.findall("".join(text.split())):
        if depth and out:
            out[-1] += t
        else:
            out.append(t)
        depth += t.count("{") + t.count("[") - t.count("}") - t.count("]")
    return out


def parse_predicate(text: str) -> Comparison | Junction:
    tokens = _tokens(text)
    tree, at = _all(tokens, 0)
    if at != len(tokens):
        raise PredicateError(f"unexpected {tokens[at]!r} in {text!r}")
    return tree


def _all(tokens: list[str], at: int):
    return _joined(tokens, at, ",", lambda t, a: _joined(t, a, "|", _one))


def _joined(tokens: list[str], at: int, op: str, below):
    part, at = below(tokens, at)
    parts = [part]
    while at < len(tokens) and tokens[at] == op:
        part, at = below(tokens, at + 1)
        parts.append(part)
    return (parts[0] if len(parts) == 1 else Junction(op, tuple(parts))), at


def _one(tokens: list[str], at: int):
    if at == len(tokens) or tokens[at] in "),|":
        raise PredicateError("a comparison is missing")
    if tokens[at] == "(":
        tree, at = _all(tokens, at + 1)
        if at == len(tokens) or tokens[at] != ")":
            raise PredicateError("a parenthesis is not closed")
        return tree, at + 1
    return comparison(tokens[at]), at + 1
