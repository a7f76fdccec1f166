"""Operator 6: layout-aware text of HTML pages."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, others_of, plus

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist".split())
#: Hidden inside svg and math, whose other text is visible.
HIDDEN_FOREIGN = frozenset("desc metadata defs symbol clippath annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption ul".split())
#: Blocks with an empty line before and after them.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "option", "optgroup", "caption", "legend"} | {"li", "dd", "dt"}
#: start tag -> (open tags that it ends, tags beyond which it doesn't look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "caption", "thead", "tbody", "tfoot", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "caption", "thead", "tbody", "tfoot", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "caption", "thead", "tbody", "tfoot", "colgroup"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
#: An attribute; a quote opens a quoted value right after the equals sign only.
_VALUE = r"(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?+)?+"
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+){_VALUE}")
_TOKEN = re.compile(rf"<!--(?:(?=>|->)|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE.pattern.replace('(', '(?:').replace('(?:?:', '(?:')})*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_DECLARATION = re.compile(r"(?:^|;)\s*+(display|visibility)\s*+:\s*+([A-Za-z-]+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """`hidden` takes the whole element away; `visible` (None: as the parent) only the text that is not made visible again.
    `number` is a list's start or an item's value, `span` a cell's columns and rows (0 rows: to the end)."""

    __slots__ = ("children", "hidden", "number", "span", "tag", "visible")

    def __init__(self, tag: str, hidden: bool = False, number: int | None = None, visible: bool | None = None, span: tuple[int, int] = (1, 1)) -> None:
        self.tag, self.hidden, self.number, self.visible, self.span, self.children = tag, hidden, number, visible, span, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _style(attributes: dict[str, str]) -> dict[str, str]:
    """Display and visibility as the inline style has them last."""
    return {m[1].lower(): m[2].lower() for m in _DECLARATION.finditer(attributes["style"].lower())} if "style" in attributes else {}


def _hidden(tag: str, attributes: dict[str, str], style: dict[str, str], foreign: bool) -> bool:
    return tag in HIDDEN or (foreign and tag in HIDDEN_FOREIGN) or "hidden" in attributes or style.get("display") == "none" or (tag == "input" and attributes.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in attributes)


def _number(attributes: dict[str, str], name: str) -> int | None:
    value = attributes.get(name, "").strip()
    return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else None


def _spans(attributes: dict[str, str]) -> tuple[int, int]:
    """Columns and rows of a cell, within HTML's own bounds."""
    columns, rows = _number(attributes, "colspan"), _number(attributes, "rowspan")
    return min(1000, columns) if columns and columns > 0 else 1, min(65534, rows) if rows is not None and rows >= 0 else 1


class _Open:
    """The open elements, and at which depths each tag is open, so that no search walks them."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.at: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def close_to(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.at[self.nodes.pop().tag].pop()

    def deepest(self, tags: Iterable[str]) -> int:
        """The depth of the innermost of these; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def find(self, tags: frozenset[str] | set[str], until: frozenset[str] | set[str]) -> int:
        """The depth of the innermost of `tags` that no element of `until` is within; 0 if there is none."""
        return depth if (depth := self.deepest(tags)) and depth > self.deepest(until - tags) else 0

    def outermost(self, tags: Iterable[str], until: Iterable[str]) -> int:
        """The depth of the outermost of `tags` within the innermost of `until`; 0 if there is none."""
        beyond = self.deepest(until)
        found = [d[k] for t in tags if (d := self.at.get(t)) and (k := bisect_right(d, beyond)) < len(d)]
        return min(found, default=0)


def parse(html: str) -> Node:
    """The tree: end tags that HTML lets authors omit are implied, those that match nothing open are ignored, and what is
    open at the end ends there. Table parts without their parents get them; text ends the head. Time follows the page's
    length, whatever its depth."""
    root = Node("#root")
    opened = _Open(root)
    stack, close_to, find = opened.nodes, opened.close_to, opened.find
    at = 0

    def add_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            close_to(len(stack) - 1)
        stack[-1].children.append(text)

    def open_(tag: str, attributes: dict[str, str]) -> Node:
        number = _number(attributes, "start") if tag == "ol" else _number(attributes, "value") if tag == "li" else None
        style = _style(attributes)
        visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""))
        foreign = bool(opened.at.get("svg") or opened.at.get("math"))
        node = Node(tag, _hidden(tag, attributes, style, foreign), number, visible, _spans(attributes) if tag in ("td", "th") else (1, 1))
        stack[-1].children.append(node)
        return node

    scopes = frozenset({"table", "td", "th", "caption", "button", "object", "template"})
    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            add_text(unescape(html[at:]))
            break
        if m.start() > at:
            add_text(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                open_("br", {})
            elif tag == "p" and not find({"p"}, scopes):
                open_("p", {})
            elif depth := find({tag}, set() if tag in ("table", "body", "html") else {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else scopes):
                close_to(depth)
            continue
        if tag in CLOSES_P and (depth := find({"p"}, scopes)):
            close_to(depth)
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
            close_to(len(stack) - 1)
        if tag in IMPLIED:
            if depth := opened.outermost(*IMPLIED[tag]):
                close_to(depth)
        elif tag not in ("head", "html", "meta", "link", "base", "title", "script", "style", "noscript", "template") and stack[-1].tag == "head":
            close_to(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            opened.push(open_("tr", {}))
        node = open_(tag, _attributes(m[3]) if m[3] else {})
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at)
            text = html[at : end.start()]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = end.end()
        elif tag == "plaintext":
            node.children.append(html[at:])
            at = len(html)
        elif tag not in VOID:
            opened.push(node)
    return root


class _Out:
    """Lines of a block context: collapses white space, and keeps the largest gap asked for between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = True  # the line ends in white space or is empty
        self.gap = 0
        self.prefix = ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._add(first)
            for part in rest:
                self.newline()
                self._add(part)
            return
        text = _SPACE.sub(" ", text)
        if self.blank and text.startswith(" "):
            text = text[1:]
        if text:
            self._add(text)
            self.blank = text.endswith(" ")

    def _add(self, text: str) -> None:
        if text:
            self.line.append(text)
            self.blank = False

    def newline(self) -> None:
        """Ends the line, even an empty one."""
        self._flush("".join(self.line))

    def block(self, gap: int) -> None:
        """Ends the line if there is one; `gap` empty lines at least follow before the next text."""
        if line := "".join(self.line).rstrip(" "):
            self._flush(line)
        self.line, self.blank = [], True
        self.gap = max(self.gap, gap)

    def _flush(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(self.prefix + line.rstrip(" "))
        self.prefix = " " * len(self.prefix) if self.prefix.strip() else self.prefix
        self.line, self.blank = [], True

    def done(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        while lines and not lines[0].strip():
            lines.pop(0)
        return lines


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def _table(rows: list[list[tuple[list[str], tuple[int, int]]]]) -> list[str]:
    """Cells (their lines, and how many columns and rows they span) in aligned columns, a bar between them; a cell's further
    lines go below its first, and where it spans rows the cells of those stand beside it. Columns in which no cell begins
    are none."""
    taken: list[tuple[int, int, int]] = []  # first column, the one after the last, and the row that they are free again from
    placed = []
    for y, row in enumerate(rows):
        x, k, line, tall = 0, 0, [], []
        for lines, (columns, height) in row:
            while k < len(taken) and taken[k][0] <= x:
                x, k = max(x, taken[k][1]), k + 1
            line.append((x, x + columns, lines))
            if height != 1:
                tall.append((x, x + columns, y + height if height else len(rows)))
            x += columns
        placed.append(line)
        if taken or tall:
            taken = sorted([t for t in taken if t[2] > y + 1] + tall)
    begins = sorted({x for line in placed for x, _, _ in line})
    narrow = {x: k for k, x in enumerate(begins)}
    placed = [[(narrow[a], bisect_left(begins, b), lines) for a, b, lines in line] for line in placed]
    widths = [0] * len(begins)
    for wide in (False, True):
        for a, b, lines in (cell for line in placed for cell in line if (cell[1] - cell[0] > 1) == wide):
            room = sum(widths[a:b]) + 3 * (b - a - 1)
            widths[b - 1] += max(0, max(map(_width, lines), default=0) - room)
    out = []
    for line in placed:
        for i in range(max((len(lines) for _, _, lines in line), default=0)):
            cells, at = [], 0
            for a, b, lines in line:
                cells += [" " * w for w in widths[at:a]]
                text = lines[i] if i < len(lines) else ""
                cells.append(text + " " * (sum(widths[a:b]) + 3 * (b - a - 1) - _width(text)))
                at = b
            out.append(" | ".join(cells).rstrip())
    return out


def render(root: Node) -> str:
    """All visible text: blocks on lines of their own, empty lines around paragraphs and the like, list items marked and
    indented by depth, table cells aligned. Iterative, so that depth is no limit."""
    out = _Out()
    outs = [out]
    tables: list[list[list[tuple[list[str], tuple[int, int]]]]] = []
    shown = [True]
    counters: list[int | None] = []
    pre = 0
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            if shown[-1]:
                out.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden:
                continue
            if tag == "br":
                out.newline()
                continue
            if tag in BLOCK:
                out.block(0 if (tag in ("ul", "ol") and counters) else int(tag in SPACED))
            if tag == "hr":
                if shown[-1] if node.visible is None else node.visible:
                    out.text("---", False)
                out.block(1)
                continue
            if node.visible is not None:
                shown.append(node.visible)
            if tag in ("ul", "ol", "menu", "dir"):
                counters.append(None if tag != "ol" else node.number if node.number is not None else 1)
            elif tag == "li":
                inner = _Out()
                outs.append(inner)
            elif tag in ("td", "th", "table"):
                if tag == "table":
                    tables.append([])
                elif tables:
                    if not tables[-1]:
                        tables[-1].append([])
                    outs.append(_Out())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("pre", "textarea", "xmp", "plaintext", "listing"):
                pre += 1
            todo.append((node, True))
            todo += [(child, False) for child in reversed(node.children)]
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            counters.pop()
        elif tag == "li":
            lines = outs.pop().done()
            out = outs[-1]
            mark = "- "
            if counters and counters[-1] is not None:
                number = node.number if node.number is not None else counters[-1]
                counters[-1], mark = number + 1, f"{number}. "
            for i, line in enumerate(lines or [""] * shown[-1]):
                out._flush((mark if not i else " " * len(mark) if line else "") + line)
        elif tag in ("td", "th"):
            if tables:
                tables[-1][-1].append((outs.pop().done(), node.span))
            else:
                out.text(" ", False)
        elif tag == "table":
            out.block(1)
            for line in _table([row for row in tables.pop() if any(lines for lines, _ in row)]):
                out._flush(line)
        elif tag in ("pre", "textarea", "xmp", "plaintext", "listing"):
            pre -= 1
        if tag in BLOCK:
            outs[-1].block(0 if (tag in ("ul", "ol") and counters) else int(tag in SPACED))
        if node.visible is not None:
            shown.pop()
    return "\n".join(outs[0].done())


def visible_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html.replace("\x00", "")))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages' other columns and `out`, the visible text. A null page has a null text, an empty one an empty text; rows
    stay as they are, however long or broken the page."""
    others = others_of(pages, html_col, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(t) for t in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(texts, pa.string())], names=[*others, out])

    return map_batches(pages.select(*others, html_col), run, plus(pages.select(*others), f"`{out}` string"))


def op6_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
