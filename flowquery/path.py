"""The path language: ``name``, ``name{child,...}``, ``name[{child,...},...]`` and ``name[]``."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(r"[{}\[\],]|[^{}\[\],]+")


@dataclass(frozen=True)
class Item:
    """One name of a template.

    ``kind``: "leaf"; "object", with one template of children; "array", with one template for each
    object that an element yields; "whole", the array itself.
    """

    name: str
    kind: str = "leaf"
    templates: tuple[tuple[Item, ...], ...] = ()


class PathError(ValueError):
    pass


def parse_template(text: str) -> tuple[Item, ...]:
    """The items of a comma-separated template."""
    tokens = TOKEN.findall("".join(text.split()))
    items, at = _items(tokens, 0, "")
    if at != len(tokens) or not items:
        raise PathError(f"not a template: {text!r}")
    return items


def _items(tokens: list[str], at: int, end: str) -> tuple[tuple[Item, ...], int]:
    found: list[Item] = []
    while at < len(tokens) and tokens[at] != end:
        if tokens[at] == ",":
            at += 1
            continue
        item, at = _item(tokens, at)
        found.append(item)
    return tuple(found), at


def _item(tokens: list[str], at: int) -> tuple[Item, int]:
    name = tokens[at]
    if name in "{}[]":
        raise PathError(f"a name is missing before {name!r}")
    at += 1
    if at == len(tokens) or tokens[at] not in "{[":
        return Item(name), at
    if tokens[at] == "{":
        template, at = _braced(tokens, at)
        return Item(name, "object", (template,)), at
    at += 1
    templates = []
    while at < len(tokens) and tokens[at] != "]":
        if tokens[at] == ",":
            at += 1
            continue
        if tokens[at] != "{":
            raise PathError(f"{name}[ is followed by {tokens[at]!r}")
        template, at = _braced(tokens, at)
        templates.append(template)
    if at == len(tokens):
        raise PathError(f"{name}[ is not closed")
    return Item(name, "array" if templates else "whole", tuple(templates)), at + 1


def _braced(tokens: list[str], at: int) -> tuple[tuple[Item, ...], int]:
    template, at = _items(tokens, at + 1, "}")
    if at == len(tokens) or not template:
        raise PathError("braces are empty or not closed")
    return template, at + 1


def parse_path(text: str) -> Item:
    """A template that names one leaf, as predicates need."""
    items = parse_template(text)
    node = items
    while True:
        if len(node) != 1 or len(node[0].templates) > 1:
            raise PathError(f"a predicate names one leaf: {text!r}")
        if not node[0].templates:
            return items[0]
        node = node[0].templates[0]
