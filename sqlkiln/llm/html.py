"""Visible text of HTML pages, laid out as a browser would read it aloud.

A tree builder takes the tokens of the standard library's HTML tokenizer and
applies the implied tags (a new paragraph closes the open one, a row closes a
cell, and so on); a renderer walks the tree and writes all text that is visible.
Blocks start on lines of their own, paragraphs and headings are set off by a
blank line, list items get bullets or numbers and are indented by depth, table
cells are padded to columns, preformatted text keeps its spaces.

Hidden are: elements that never render (script, style, head, template, ...),
``hidden``, ``aria-hidden`` aside, and inline styles ``display:none`` and
``visibility:hidden``; a descendant may set ``visibility:visible`` again.
Closed ``details`` show their summary alone, a closed ``dialog`` nothing. Style
sheets are not read: only attributes hide. Depth has no limit.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# The HTML standard's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style title template noscript iframe object audio video canvas svg math datalist "
                  "select textarea option optgroup rp noframes noembed".split())
RAW = NEVER - frozenset("select option optgroup".split())     # a table's part inside does not end them
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset details hr menu".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd dialog div dt figcaption footer form header hgroup html legend li "
                                "main nav search section summary caption tr td th thead tbody tfoot colgroup".split())
_CELL, _SECTION = ("td", "th"), ("thead", "tbody", "tfoot")
_IN_TABLE = ("table", "tr") + _SECTION
# A table's part goes into the innermost of these, out of stray elements in the table.
PARENTS = {"td": _IN_TABLE, "th": _IN_TABLE, "tr": ("table",) + _SECTION,
           **dict.fromkeys(_SECTION + ("caption", "colgroup", "col"), ("table",))}
# What stands directly in a table, a section or a row; text and all other elements go before the table.
TABLE_PARTS = frozenset(PARENTS) | {"form", "script", "style", "template"}
# An opening tag closes these open elements, up to the scope that bounds the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (_CELL + ("caption",), ("tr", "table")), "th": (_CELL + ("caption",), ("tr", "table")),
    "tr": (("tr", "caption") + _CELL, ("table",)),
    "caption": (("caption",), ("td", "th", "table")), "colgroup": (("caption",), ("td", "th", "table")),
    "thead": (_SECTION + ("tr", "caption", "colgroup"), ("table",)),
    "tbody": (_SECTION + ("tr", "caption", "colgroup"), ("table",)),
    "tfoot": (_SECTION + ("tr", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ()),
    "a": (("a",), ("td", "th", "table")),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
P_SCOPE = frozenset("td th table button object caption body html".split())

_HIDE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_INVISIBLE = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class TreeBuilder(HTMLParser):
    """Tokens to a tree, with the tags that authors leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.depth = 1

    def _push_open(self, node: Node) -> None:
        self.open.append(node)
        self.depth = max(self.depth, len(self.open))

    def _close(self, names, scope) -> None:
        """Close the innermost open element among ``names`` not beyond ``scope``, and all in it;
        then look again for the other names."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                del self.open[i:]
                return self._close(names, scope)
            if self.open[i].tag in scope:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and tag not in ("html", "head") and self.open[-1].tag == "head":
            self.open.pop()                              # anything else ends the head
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.open.pop()
        if tag in CLOSES_P:
            self._close(("p",), P_SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        if tag == "table" and self._in_table():
            del self.open[self._table():]                # a table directly in a table ends that
        if tag in PARENTS and self.open[-1].tag not in PARENTS[tag] + ("colgroup",):
            self._back(PARENTS[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self._push(Node("tbody"))
        elif tag in _CELL and self.open[-1].tag in ("table",) + _SECTION:
            self._push(Node("tr"))
        attributes = {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")     # the first of a repeated attribute counts
        node = Node(tag, attributes)
        in_table = self._in_table()
        if in_table and tag not in TABLE_PARTS:
            self._foster(node)
        else:
            self.open[-1].children.append(node)
        if in_table and tag == "form":
            return                                       # holds nothing there; the rows behind it are the table's
        if tag not in VOID:
            self._push_open(node)

    def _table(self) -> int:
        """The place of the innermost open table."""
        return max(i for i, n in enumerate(self.open) if n.tag == "table")

    def _in_table(self) -> bool:
        """Whether the innermost element is a table, or a section or row of one."""
        for n in reversed(self.open):
            if n.tag not in _IN_TABLE:
                return False
            if n.tag == "table":
                return True
        return False

    def _foster(self, child) -> None:
        """Put ``child`` before the innermost open table, which is the last child of its parent."""
        self.open[self._table() - 1].children.insert(-1, child)

    def _back(self, names) -> None:
        """Close what is open inside the innermost element among ``names``, in the innermost table."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                if any(n.tag == "table" for n in self.open[:i + 1]):
                    del self.open[i + 1:]
                return
            if self.open[i].tag in _CELL + ("caption",) or self.open[i].tag in RAW:
                return

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self._push_open(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)                 # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p"))     # a lone </p> is an empty paragraph
            return
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        # Only a table's own parts, and the page's, reach beyond a cell; nothing else leaves a table.
        of_table = tag in ("table", "tr", "caption", "body", "html") + _SECTION + _CELL or tag in RAW
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i].tag
            if here == tag:
                del self.open[i:]
                return
            if here == "table" and tag not in ("body", "html", "template") or here in _CELL and not of_table:
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head":
            if not data.strip():
                return
            self.open.pop()
        if self.open[-1].tag == "colgroup" and data.strip():
            self.open.pop()
        if data.strip() and self._in_table():
            self._foster(data)
        else:
            self.open[-1].children.append(data)


def build(html: str) -> Node:
    """The page's tree; whatever the markup, every character of text is in it.

    Elements nest as deep as the page says; the walk's recursion gets room for it.
    """
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 8 * builder.depth))
    return builder.root


def text_width(s: str) -> int:
    """Columns that a line takes: wide East Asian characters two, marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Collects text into lines; keeps track of the white space that is due."""

    def __init__(self, in_list: bool = False):
        self.in_list = in_list   # lists inside a list item stand close
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0             # blank lines due before the next text
        self.space = False       # a collapsed space is due

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._write(first)
            for part in rest:
                self._end(keep=True)
                self._write(part)
            return
        lead, trail = data[:1] in " \t\n\r\f", data[-1:] in " \t\n\r\f"
        body = _BLANKS.sub(" ", data).strip(" ")
        if not body:
            self.space = self.space or bool(data and self.line)
            return
        if lead and self.line:
            self.space = True
        self._write(body)
        self.space = trail

    def _write(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def _end(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif keep and self.lines:
            self.lines.append("")
        self.space = False

    def line_break(self) -> None:
        self._end(keep=True)

    def block(self, blank: int = 0) -> None:
        self._end()
        if self.lines:
            self.gap = max(self.gap, blank)

    def inset(self, lines: list[str], first: str, rest: str) -> None:
        """Lines of an inner page, the first behind ``first``, the others behind ``rest``."""
        self.block(self.gap)
        for i, line in enumerate(lines):
            self._write(((first if i == 0 else rest) + line).rstrip() if line else (first.rstrip() if i == 0 else ""))
            self._end(keep=True)

    def finish(self) -> list[str]:
        self._end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(m[1]) if m else default


def _marker(kind: str, n: int) -> str:
    if kind in ("a", "A") and n > 0:
        letters = ""
        while n:
            n, r = divmod(n - 1, 26)
            letters = chr(97 + r) + letters
        return (letters.upper() if kind == "A" else letters) + ". "
    if kind in ("i", "I") and 0 < n < 4000:
        roman = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"),
                            (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            roman += sign * (n // value)
            n %= value
        return (roman.upper() if kind == "I" else roman) + ". "
    return f"{n}. "


def _visibility(node: Node, seen: bool) -> tuple[bool, bool]:
    """``(rendered, its own text visible)``."""
    if node.tag in NEVER or "hidden" in node.attrs or node.tag == "input" or (node.tag == "dialog" and "open" not in node.attrs):
        return False, False
    style = node.attrs.get("style", "")
    if style:
        if _HIDE.search(style):
            return False, False
        for m in _INVISIBLE.finditer(style):
            seen = m[1].lower() == "visible"
    return True, seen


def _inner(nodes: list, seen: bool, pre: bool, in_list: bool = False) -> list[str]:
    page = Page(in_list)
    _walk(nodes, page, seen, pre)
    return page.finish()


def _list(node: Node, page: Page, seen: bool) -> None:
    n = _number(node.attrs.get("start"), 1)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            _walk([child], page, seen, False)
            continue
        shown, own = _visibility(child, seen)
        if not shown:
            continue
        if node.tag == "ol":
            n = _number(child.attrs.get("value"), n)
            mark = _marker(node.attrs.get("type", "1"), n)
            n += 1
        else:
            mark = "- "
        lines = _inner(child.children, own, False, in_list=True)
        if lines:
            page.block()
            page.inset(lines, mark, " " * len(mark))


def _rows(node: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
    """The rows of a table, head first and foot last, whatever their order."""
    parts = {"thead": [], "tfoot": [], "": []}
    for child in node.children:
        if not isinstance(child, str):
            shown, own = _visibility(child, seen)
            if shown:
                parts[child.tag if child.tag in ("thead", "tfoot") else ""].append((child, own))
    for part in ("thead", "", "tfoot"):
        for child, own in parts[part]:
            if child.tag == "tr":
                yield child, own
            elif child.tag in _SECTION:
                yield from _rows(child, own)


def _table(node: Node, page: Page, seen: bool) -> None:
    loose = [c for c in node.children if isinstance(c, str) or c.tag not in ("tr", "colgroup", "col") + _SECTION]
    _walk(loose, page, seen, False)                       # captions, and text that has no cell
    grid: list[list[tuple[int, list[str]]]] = []          # rows of (columns spanned, lines)
    held: dict[int, int] = {}                             # column -> rows it is still taken
    for row, own in _rows(node, seen):
        cells: list[tuple[int, list[str]]] = []
        at = 0
        for cell in row.children:
            if isinstance(cell, str):
                lines, span, down = ([cell.strip()] if own and cell.strip() else []), 1, 1
                if not lines:
                    continue
            else:
                shown, vis = _visibility(cell, own)
                if not shown:
                    continue
                lines = _inner(cell.children if cell.tag in _CELL else [cell], vis, False)
                span = min(max(_number(cell.attrs.get("colspan"), 1), 1), 1000)
                down = min(max(_number(cell.attrs.get("rowspan"), 1), 1), 65534)
            while held.get(at, 0) > 0:
                cells.append((1, []))
                at += 1
            cells.append((span, lines))
            for c in range(at, at + span):
                if down > 1:
                    held[c] = down
            at += span
        held = {c: k - 1 for c, k in held.items() if k > 1}
        grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        at = 0
        for span, lines in cells:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max([widths[at], *map(text_width, lines)])
            at += span
    for cells in grid:
        height = max([len(lines) for _, lines in cells], default=0)
        page.block()
        for k in range(height):
            out, at = [], 0
            for span, lines in cells:
                room = sum(widths[at:at + span]) + 2 * (span - 1)
                s = lines[k] if k < len(lines) else ""
                out.append(s + " " * (room - text_width(s)))
                at += span
            page.inset(["  ".join(out).rstrip()], "", "")


def _walk(nodes: list, page: Page, seen: bool, pre: bool) -> None:
    for node in nodes:
        if isinstance(node, str):
            if seen:
                page.text(node, pre)
            continue
        shown, own = _visibility(node, seen)
        if not shown:
            continue
        tag = node.tag
        if tag == "br":
            page.line_break()
        elif tag == "hr":
            page.block(1)
        elif tag == "img":
            pass                                          # an image has no text of its own
        elif tag not in BLOCKS:
            _walk(node.children, page, own, pre)
        else:
            blank = 1 if tag in PARAGRAPHS and not (page.in_list and tag in ("ul", "ol", "menu")) else 0
            page.block(blank)
            if tag in ("ul", "ol", "menu"):
                _list(node, page, own)
            elif tag == "table":
                _table(node, page, own)
            elif tag in ("blockquote", "dd", "figure"):
                lines = _inner(node.children, own, pre)
                if lines:
                    page.inset(lines, "    ", "    ")
            elif tag == "details" and "open" not in node.attrs:
                _walk([c for c in node.children if not isinstance(c, str) and c.tag == "summary"], page, own, pre)
            elif tag == "li":                             # outside any list
                lines = _inner(node.children, own, pre)
                if lines:
                    page.inset(lines, "- ", "  ")
            else:
                _walk(node.children, page, own, pre or tag == "pre")
            page.block(blank)


def render(html: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty string."""
    return "\n".join(_inner(build(html).children, True, False)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_lines)`` of every row of ``pages``.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are
    ignored. Null and empty html give an empty text with no lines; ids and
    urls, null or repeated, pass through; an empty table gives an empty result.
    Pages are rendered one by one where they lie: no shuffle, and memory
    follows the longest page.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["page_id", "url"]].assign(text=[render(h if isinstance(h, str) else None) for h in pdf["html"]])

    out = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long"))
