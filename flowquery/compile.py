"""Predicates and templates as Columns, over typed columns or over a VARIANT column.

Typed columns are pruned and pushed down; in them SQL NULL stands for an absent key. A VARIANT
keeps a JSON null apart from an absent key and needs no schema. Predicates are conditions for filters:
NULL stands for false in them. They have no negation outside comparisons, so that is safe, and plain
comparisons of columns reach the scan as they are. ``flag`` makes true or false of one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType, StructType

from flowquery.path import Item
from flowquery.predicate import Comparison, Junction, parse_predicate


def glob_regex(pattern: str) -> str:
    """``*``, ``?`` and ``[seq]`` as an anchored regex; all else is literal."""
    out = ""
    for part in re.split(r"(\*|\?|\[[^\]!][^\]]*\])", pattern):
        if part == "*":
            out += ".*"
        elif part == "?":
            out += "."
        elif len(part) > 2 and part[0] == "[" and part[-1] == "]":
            out += "[" + re.sub(r"([\\^&\[])", r"\\\1", part[1:-1]) + "]"
        else:
            out += re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", part)
    return f"(?s)^{out}$"


def glob(column: Column, pattern: str) -> Column:
    """Whether a string matches; plain strings and prefixes compile to comparisons that scans can use."""
    if not re.search(r"[*?\[]", pattern):
        return column == pattern
    if not re.search(r"[*?\[]", pattern[:-1]) and pattern.endswith("*"):
        return column.startswith(pattern[:-1])
    return column.rlike(glob_regex(pattern))


@dataclass(frozen=True)
class Typed:
    """A typed value; ``kind`` None: a name that the schema lacks."""

    column: Column
    kind: DataType | None

    def child(self, name: str) -> Typed:
        if isinstance(self.kind, StructType) and name in self.kind.names:
            return Typed(self.column.getField(name), self.kind[name].dataType)
        if isinstance(self.kind, MapType):
            return Typed(F.try_element_at(self.column, F.lit(name)), self.kind.valueType)
        return Typed(F.lit(None), None)

    @property
    def array(self) -> bool:
        return isinstance(self.kind, ArrayType)

    def elements(self) -> Column:
        return F.coalesce(self.column, F.array().cast(self.kind)) if self.array else F.array()

    def element(self, column: Column) -> Typed:
        return Typed(column, self.kind.elementType if self.array else None)

    def present(self) -> Column:
        return self.column.isNotNull() if self.kind is not None else F.lit(False)

    def equals(self, c: Comparison) -> Column:
        if isinstance(self.kind, StringType):
            return glob(self.column, c.text)
        if isinstance(self.kind, NumericType) and not isinstance(c.literal, str):
            return self.column == c.literal
        return F.lit(False)

    def number(self) -> Column:
        return self.column if isinstance(self.kind, NumericType) else F.lit(None).cast("double")


@dataclass(frozen=True)
class Variant:
    """A VARIANT value; what it is shows only in the rows."""

    column: Column

    array = True

    def child(self, name: str) -> Variant:
        return Variant(F.try_variant_get(self.column, "$['" + name.replace("'", "\\'") + "']", "variant"))

    def elements(self) -> Column:
        return F.coalesce(F.try_variant_get(self.column, "$", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))

    def element(self, column: Column) -> Variant:
        return Variant(column)

    def present(self) -> Column:
        return self.column.isNotNull()

    def _is(self, *kinds: str) -> Column:
        return F.regexp_extract(F.schema_of_variant(self.column), "^[A-Z]+", 0).isin(*kinds)

    def number(self) -> Column:
        return F.when(self._is("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(self.column, "$", "double"))

    def equals(self, c: Comparison) -> Column:
        same = F.when(self._is("STRING"), glob(F.try_variant_get(self.column, "$", "string"), c.text))
        return F.coalesce(same, self.number() == c.literal if not isinstance(c.literal, str) else F.lit(False))


Value = Typed | Variant


def _sure(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _leaf(value: Value, c: Comparison) -> Column:
    if c.text == "*":
        return value.present()
    equal = value.equals(c)
    if c.op == "=":
        return equal
    if c.op == "~":
        return value.present() & ~(equal if isinstance(value, Typed) else _sure(equal))
    if isinstance(c.literal, str):
        return F.lit(False)
    return value.number() > c.literal if c.op == ">" else value.number() < c.literal


def _any(value: Value, path: Item, c: Comparison) -> Column:
    """Whether some value that ``path`` yields below ``value`` satisfies the comparison."""
    below = value.child(path.name)
    if path.kind == "object":
        return _any(below, path.templates[0][0], c)
    if path.kind == "leaf":
        if isinstance(below, Typed) and below.array:
            return F.exists(below.elements(), lambda x: _leaf(below.element(x), c))
        return _leaf(below, c)
    if not below.array:
        return F.lit(False)
    if path.kind == "whole":
        return F.exists(below.elements(), lambda x: _leaf(below.element(x), c))
    return F.exists(below.elements(), lambda x: _any(below.element(x), path.templates[0][0], c))


def compile_comparison(root: Value, c: Comparison) -> Column:
    if c.op == "~" and c.text == "*":  # nothing present, but an empty array that is itself the leaf
        return ~_any(root, c.path, Comparison(c.path, "=", "*", "*")) & ~_empty_leaf(root, c.path)
    return _any(root, c.path, c)


def _empty_leaf(value: Value, path: Item) -> Column:
    below = value.child(path.name)
    if path.kind == "object":
        return _empty_leaf(below, path.templates[0][0])
    if path.kind == "array" or not below.array:
        return F.lit(False)
    if isinstance(below, Variant):
        return _sure(F.size(F.try_variant_get(below.column, "$", "array<variant>")) == 0)
    return _sure(F.size(below.column) == 0)


def compile_predicate(root: Value, tree: Comparison | Junction) -> Column:
    if isinstance(tree, Comparison):
        return compile_comparison(root, tree)
    return reduce(lambda a, b: a & b if tree.op == "," else a | b, (compile_predicate(root, p) for p in tree.parts))


def where(schema: StructType, text: str) -> Column:
    """A predicate over typed columns."""
    return compile_predicate(_Row(schema), parse_predicate(text))


def flag(predicate: Column) -> Column:
    """A predicate as a column of true and false."""
    return _sure(predicate)


def where_variant(column: Column, text: str) -> Column:
    """A predicate over one VARIANT column."""
    return compile_predicate(Variant(column), parse_predicate(text))


@dataclass(frozen=True)
class _Row:
    """The columns of a DataFrame as the fields of a value."""

    schema: StructType

    def child(self, name: str) -> Typed:
        return Typed(F.col(f"`{name}`"), self.schema[name].dataType) if name in self.schema.names else Typed(F.lit(None), None)


def project(value: Value | _Row, template: tuple[Item, ...]) -> list[tuple[str, Column]]:
    """Name and column of each item that the schema has: structs of present children, arrays of present elements."""
    out = []
    for item in template:
        below = value.child(item.name)
        if isinstance(below, Typed) and below.kind is None:
            continue
        if item.kind in ("leaf", "whole"):
            out.append((item.name, below.column))
        elif item.kind == "object":
            if (made := _object(below, item.templates[0])) is not None:
                out.append((item.name, made))
        elif below.array:
            parts = [t for t in item.templates if _object(below.element(F.lit(None)), t) is not None]
            if parts:
                # one object for each element and template, element by element; those that yield nothing go
                names = [n for t in parts for n, _ in project(below.element(F.lit(None)), t)]

                made = F.filter(F.flatten(F.transform(below.elements(), _objects(below, parts, names))), lambda y: y.isNotNull())
                out.append((item.name, F.when(F.size(made) > 0, made)))
    return out


def _objects(value: Typed, templates: list[tuple[Item, ...]], names: list[str]):
    """An element's objects, one for each template."""
    return lambda x: F.array(*(_object(value.element(x), t, names) for t in templates))


def _object(value: Value, template: tuple[Item, ...], names: list[str] | None = None) -> Column | None:
    """A struct of what ``template`` finds, NULL where it finds nothing. ``names``: all fields of the struct."""
    fields = dict(project(value, template))
    if not fields:
        return None
    filled = [fields[n].alias(n) if n in fields else F.lit(None).alias(n) for n in dict.fromkeys(names or fields)]
    return F.when(reduce(lambda a, b: a | b, (c.isNotNull() for c in fields.values())), F.struct(*filled))


def select(schema: StructType, template: tuple[Item, ...]) -> list[Column]:
    return [c.alias(n) for n, c in project(_Row(schema), template)]


def change(value: Value | _Row, template: tuple[Item, ...], apply) -> list[tuple[str, Column]]:
    """Name and new column of each top-level item with ``apply`` done to its addressed leaves."""
    out = []
    for item in template:
        below = value.child(item.name)
        if isinstance(below, Typed) and below.kind is not None:
            out.append((item.name, _changed(below, item, apply)))
    return out


def _changed(value: Typed, item: Item, apply) -> Column:
    if item.kind in ("leaf", "whole"):
        return apply(value.column).cast(value.kind)
    if item.kind == "object":
        made = value.column
        for name, column in change(value, item.templates[0], apply):
            made = made.withField(name, column)
        return F.when(value.column.isNotNull(), made)

    def element(x: Column) -> Column:
        for template in item.templates:
            base = value.element(x)
            for name, column in change(base, template, apply):
                x = x.withField(name, column)
        return x

    return F.transform(value.column, element)
