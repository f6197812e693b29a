"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

``parse`` builds a tree from tags as they come: void elements hold nothing, a start tag ends the elements
that it implies an end of (a block ends an open paragraph, ``li`` an ``li`` of its list, ``td`` a ``td`` of its
row, ...), an end tag ends what is open inside its element, and one without an element is
ignored. ``Sheet`` holds the page's own ``<style>`` rules as far as they show or hide: ``display`` and ``visibility`` by type,
class, id and attribute, alone or as descendants and children, in the order of importance, inline style, specificity and place.
``render`` walks the tree, leaves out what a browser would not show (what is not displayed goes with all in it; what is
invisible may hold visible elements), and emits all other text: runs of white space collapse but in ``pre``, blocks stand
on lines of their own with a blank line around those that have margins, list items get bullets or numbers (``start``,
``value``, ``reversed``) and hanging indents, and table cells are padded to the columns' widths (wide characters count two),
with row and column spans. Rules with pseudo-classes, sibling combinators or conditions on the medium's size are not looked at.

Both loops keep their own stacks, so nesting may be as deep as a page likes. Texts are read whole, in
one pass without a shuffle.

Defined results: a null or empty page gives an empty text; markup that is cut off counts as text or ends with
the page; repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the HTML standard: element names by their roles.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSHOWN = frozenset("audio canvas datalist embed head iframe math noembed noframes noscript object param script style svg template title video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
MARGINS = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
LISTS = frozenset("dir menu ol ul".split())
CELLS = frozenset(("td", "th"))
#: Starting one of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
#: Elements that a start tag ends, and those behind which it does not look for them.
ENDS = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    **{x: (frozenset(("tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))) for x in ("tbody", "thead", "tfoot")},
    "body": (frozenset(("head",)), frozenset()),
}
#: Kinds of input elements that show their value.
TYPED = frozenset("button color date datetime-local email month number reset search submit tel text time url week".split())
WHITE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list = field(default_factory=list)


COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
MEDIUM = re.compile(r"@media\s+([^{]*)\{((?:[^{}]*\{[^{}]*\})*[^{}]*)\}?", re.I)
COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+|\[[^\]]*\])*)", re.I)
SIMPLE = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


@dataclass
class Compound:
    """What one element must be: its tag (or any), classes, ids and attributes; ``child``: of the element before it, itself."""

    tag: str
    needs: list[tuple[str, str, str | None]]
    child: bool

    def holds(self, node: Node) -> bool:
        if self.tag not in ("*", node.tag):
            return False
        for kind, name, value in self.needs:
            if kind == "[":
                own = node.attrs.get(name.lower())
                if name.lower() not in node.attrs or (value is not None and own != value):
                    return False
            elif kind == "#":
                if node.attrs.get("id") != name:
                    return False
            elif name not in (node.attrs.get("class") or "").split():
                return False
        return True


def declared(text: str) -> list[tuple[bool, str, str]]:
    """(important, property, value) of each declaration that shows or hides."""
    return [(bool(m[3]), m[1].lower(), m[2].lower()) for m in DECLARED.finditer(COMMENT.sub(" ", text))]


def selector(text: str) -> list[Compound] | None:
    """Its compounds, the last first, or None where it has parts that are not looked at."""
    out, child = [], False
    for part in text.replace(">", " > ").split():
        if part == ">":
            child = True
            continue
        m = COMPOUND.fullmatch(part)
        if not m:
            return None
        needs = [(k[1] or "[", k[2] or k[3], k[4]) for k in SIMPLE.finditer(m[2])]
        out.append(Compound((m[1] or "*").lower(), needs, child))
        child = False
    return out[::-1] or None


class Sheet:
    """Rules of ``display`` and ``visibility``, filed by the id, class or tag that their last compound needs."""

    def __init__(self, texts: list[str]):
        self.filed: dict[str, list] = defaultdict(list)
        self.count = 0
        for text in texts:
            if "display" in text.lower() or "visibility" in text.lower():
                plain = COMMENT.sub(" ", text)
                self._add(MEDIUM.sub(lambda m: m[2] if m[1].strip().lower() in ("all", "screen") else " ", plain))

    def _add(self, text: str) -> None:
        for m in RULE.finditer(text):
            rules = declared(m[2])
            for one in m[1].rsplit(";", 1)[-1].split(",") if rules else ():
                compounds = selector(one)
                if compounds:
                    needs = [n for c in compounds for n in c.needs]
                    rank = (sum(k == "#" for k, _, _ in needs), sum(k != "#" for k, _, _ in needs), sum(c.tag != "*" for c in compounds))
                    first = min(compounds[0].needs, key=lambda n: "#.[".index(n[0]), default=("[", "", None))
                    key = first[0] + first[1] if first[0] != "[" else compounds[0].tag
                    self.filed[key].append((rank, self.count, compounds, rules))
                    self.count += 1

    def style(self, node: Node, above: list) -> dict[str, str]:
        """The element's own ``display`` and ``visibility``, where declared. ``above``: the places around it."""
        inline = node.attrs.get("style")
        if not self.count and not inline:
            return {}
        found = []
        if self.count:
            keys = ["*", node.tag, f"#{node.attrs.get('id')}", *(f".{c}" for c in (node.attrs.get("class") or "").split())]
            for key in keys:
                for rank, number, compounds, rules in self.filed.get(key, ()):
                    if compounds[0].holds(node) and self._above(compounds, above):
                        found += [((important, False, rank, number, k), p, v) for k, (important, p, v) in enumerate(rules)]
        if inline:
            found += [((important, True, (), 0, k), p, v) for k, (important, p, v) in enumerate(declared(inline))]
        return {p: v for _, p, v in sorted(found)}

    @staticmethod
    def _above(compounds: list[Compound], above: list) -> bool:
        """Whether the elements above hold the rest of the compounds; each descendant takes the nearest, a child the next, with a step back where that fails."""
        tries = [(1, len(above) - 1)]
        while tries:
            k, at = tries.pop()
            if k == len(compounds):
                return True
            if at < 0:
                continue
            if not compounds[k - 1].child:
                tries.append((k, at - 1))
            if compounds[k].holds(above[at].node):
                tries.append((k + 1, at - 1))
        return False


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.names = Counter(("html",))
        self.styles: list[str] = []

    def _close_to(self, depth: int) -> None:
        """Leave ``depth`` elements open."""
        for node in self.open[depth:]:
            self.names[node.tag] -= 1
        del self.open[depth:]

    def _end(self, tags: frozenset[str], barriers: frozenset[str]) -> None:
        """End the innermost open element of ``tags``, and all in it, unless a barrier is nearer."""
        if not any(self.names[t] for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                return self._close_to(depth)
            if tag in barriers:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in ENDS_P:
            self._end(frozenset(("p",)), CELLS | {"table", "caption", "button"})
        if tag == "body" or (tag in BLOCKS and self.names["head"]):
            self._end(frozenset(("head",)), frozenset())
        if tag in ("tbody", "thead", "tfoot"):
            self._end(*ENDS["tr"])
            self._end(frozenset(("tr",)), frozenset(("table",)))
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in CELLS and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # only void elements end at once

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in ("html", "body"):
            part = tag in CELLS or tag in ("tr", "table", "tbody", "thead", "tfoot", "caption")
            self._end(frozenset((tag,)), frozenset(("table",)) if part and tag != "table" else frozenset() if part else CELLS | {"caption"})

    def handle_data(self, data: str) -> None:
        last = self.open[-1]
        last.children.append(data)
        if last.tag == "style" and (last.attrs.get("media") or "all").strip().lower() in ("all", "screen"):
            self.styles.append(data)


def parse(html: str) -> tuple[Node, Sheet]:
    builder = TreeBuilder()
    builder.feed(html)
    if builder.rawdata.startswith("<!--"):  # a comment that is never closed
        builder.rawdata = ""
    builder.close()
    return builder.root, Sheet(builder.styles)


def width(text: str) -> int:
    """Columns that ``text`` takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in text)


class Canvas:
    """Lines of text, with the line being written and the blank lines due before it."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *others = text.replace("\r\n", "\n").split("\n")
            self._write(first)
            for x in others:
                self.flush(blank=True)
                self._write(x)
            return
        words = WHITE.split(text)
        if len(words) > 1 and not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            self._write(" " * (self.space and bool(self.line)) + body)
            self.space = False
        if len(words) > 1 and not words[-1]:
            self.space = True

    def _write(self, text: str) -> None:
        if text:
            self.line.append(text)

    def flush(self, blank: bool = False) -> None:
        """End the line. ``blank``: also where nothing is on it."""
        if self.line or blank:
            self.put(["".join(self.line).rstrip()])
        self.line, self.space = [], False

    def put(self, lines: list[str]) -> None:
        if lines:
            self.lines += [""] * (self.gap if self.lines else 0) + lines
            self.gap = 0

    def margin(self, lines: int) -> None:
        self.flush()
        self.gap = max(self.gap, lines)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(node: Node, name: str) -> int | None:
    value = (node.attrs.get(name) or "").strip()
    return int(value) if value.isascii() and value.lstrip("-").isdigit() and len(value) < 10 else None


def _columns(node: Node) -> int:
    return min(1000, max(1, _number(node, "colspan") or 1))  # the standard's bounds


def _rows(node: Node) -> int:
    """0 stands for all rows of the group."""
    n = _number(node, "rowspan")
    return 65534 if n == 0 else min(65534, max(1, n or 1))


class Table:
    """Cells by row and column; a cell reaches over its spans."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines)
        self.taken: dict[int, int] = {}  # rows that a span from above still takes, by column

    def row(self) -> None:
        self.rows.append([])
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}

    def cell(self, node: Node, lines: list[str]) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        at = row[-1][0] + row[-1][1] if row else 0
        while at in self.taken:
            at += 1
        wide, high = _columns(node), _rows(node)
        row.append((at, wide, lines))
        if high > 1:
            self.taken.update({c: high for c in range(at, at + wide)})

    def render(self) -> list[str]:
        widths: dict[int, int] = {}
        for single in (True, False):
            for at, wide, lines in (c for r in self.rows for c in r):
                if (wide == 1) == single:
                    need = max(map(width, lines), default=0) - sum(widths.setdefault(c, 0) + 2 for c in range(at, at + wide - 1))
                    widths[at + wide - 1] = max(widths.get(at + wide - 1, 0), need)
        starts, x = {}, 0
        for c in range(max(widths, default=-1) + 1):
            starts[c] = x
            x += widths.get(c, 0) + 2 if widths.get(c, 0) else 0
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        line += " " * (starts[at] - width(line)) + lines[k]
                out.append(line.rstrip())
        return out


@dataclass
class Place:
    """An element being rendered: what is left of its children, and where its text goes."""

    node: Node
    canvas: Canvas
    keep: bool = False
    table: Table | None = None
    count: int = 0
    step: int = 1
    visible: bool = True
    children: list = field(init=False)

    def __post_init__(self):
        self.children = self.node.children[::-1]


def render(root: Node, sheet: Sheet) -> str:
    """All visible text of a tree, laid out."""
    page = Canvas()
    stack = [Place(root, page)]
    while stack:
        here = stack[-1]
        if not here.children:
            stack.pop()
            _leave(here, stack)
            continue
        child = here.children.pop()
        closed = here.node.tag == "details" and "open" not in here.node.attrs
        if closed and (isinstance(child, str) or child.tag != "summary"):
            continue
        if isinstance(child, str):
            if here.visible:
                here.canvas.text(child, here.keep)
            continue
        style = sheet.style(child, stack)
        if _displayed(child, style):
            visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"), here.visible)
            if child.tag == "br":
                here.canvas.flush(blank=visible)
            elif child.tag == "input":
                if visible and (child.attrs.get("type") or "text").strip().lower() in TYPED:
                    here.canvas.text(child.attrs.get("value") or "", False)
            elif child.tag != "wbr":
                stack.append(_enter(child, here, visible))
    return "\n".join(page.done())


def _displayed(node: Node, style: dict[str, str]) -> bool:
    if node.tag in UNSHOWN:
        return False
    hidden = "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)
    return style.get("display", "none" if hidden else "") != "none"


def _enter(node: Node, here: Place, visible: bool) -> Place:
    tag = node.tag
    if tag in BLOCKS:
        # A list in a list, as a rule, has no margin of its own.
        inner = tag in LISTS and here.node.tag == "li"
        here.canvas.margin(1 if tag in MARGINS and not inner else 0)
    place = Place(node, here.canvas, here.keep or tag in ("pre", "textarea"), here.table, visible=visible)
    if tag in LISTS:
        backwards = tag == "ol" and "reversed" in node.attrs
        start = _number(node, "start")
        if start is None:
            start = sum(not isinstance(x, str) and x.tag == "li" for x in node.children) if backwards else 1
        place.step = -1 if backwards else 1
        place.count = start - place.step
    elif tag == "table":
        place.table = Table()
    elif tag in ("tbody", "thead", "tfoot") and here.table is not None:
        here.table.taken = {}  # spans end with their group of rows
    elif tag == "tr" and here.table is not None:
        here.table.row()
    elif tag == "li":
        value = _number(node, "value")
        here.count = value if value is not None else here.count + here.step
        place.count = here.count if here.node.tag == "ol" else 0
        place.canvas = Canvas()
    elif tag in CELLS or tag in ("blockquote", "dd"):
        place.canvas, place.table = Canvas(), here.table if tag in CELLS else None
    return place


def _leave(place: Place, stack: list[Place]) -> None:
    node, outer = place.node, stack[-1] if stack else None
    if outer is None:
        return
    if node.tag == "li":
        lines = place.canvas.done() or [""] * place.visible
        mark = "" if not place.visible else f"{place.count}. " if outer.node.tag == "ol" else "- "
        outer.canvas.put([(mark + x if k == 0 else " " * len(mark) + x).rstrip() for k, x in enumerate(lines)])
    elif node.tag in CELLS and outer.table is not None:
        outer.table.cell(node, place.canvas.done())
    elif node.tag in CELLS or node.tag in ("blockquote", "dd"):
        indent = "" if node.tag in CELLS else "  "
        outer.canvas.put([(indent + x).rstrip() for x in place.canvas.done()])
    elif node.tag == "table":
        outer.canvas.flush()
        outer.canvas.put(place.table.render())
    if node.tag in BLOCKS:
        outer.canvas.margin(1 if node.tag in MARGINS and not (node.tag in LISTS and outer.node.tag == "li") else 0)


def visible_text(html: str | None) -> str:
    return render(*parse(html)) if html else ""


def text_column(html: Column) -> Column:
    """The visible text of each page."""

    @F.pandas_udf(StringType())
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text, na_action=None)

    return texts(html)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row."""
    return pages.select("page_id", text_column(F.col("html")).alias("text"))
