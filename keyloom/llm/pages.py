"""Layout-aware text of HTML pages.

A tokenizer and tree builder with implied tags (p, li, dd, dt, table parts, options; unclosed elements end
with their parent or the page), then a renderer: elements that a browser would not show are left out
(head, scripts, templates, `hidden`, display:none, visibility:hidden, closed details but for
the summary), everything else is kept, menus and footers too. Formulas (MathML) and the labels of drawings
(SVG) are inline text, labels, fractions and matrix cells with spaces around; of these only what is not drawn
goes (UNDRAWN, display="none"). A `use` is not followed. Blocks stand on lines of their own, paragraphs
and headings with an empty line around, list items are marked and indented, preformatted text keeps its
spaces, table cells are padded to columns.

A page is read in linear time, whatever its markup, and nothing recurses: elements may nest without end, and visibility
holds at any depth. Only layout has bounds, so that it does not outgrow the page: indentation (INDENT), aligned
columns (COLUMNS, WIDE) and tables within tables (NESTED); no text is lost by these.

Defined cases: null and empty pages have empty texts; a `<` that starts no tag, or a tag that no `>` ends, is text; an
unclosed comment goes to the end of the page; repeated rows are rendered each; an empty table
gives an empty result; further columns are carried along untouched.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, pack, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tables inside so many others are no longer aligned: their cells are lines.
NESTED = 20
#: Columns that are aligned (also the most that the HTML standard lets a cell span), and characters of a line that widen a column.
COLUMNS, WIDE = 1000, 200
#: Indentation does not go beyond about so many columns.
INDENT = 80
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?]|/)")
GAP, NAME, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
QUOTES = ('"', "'")
SPACES = re.compile(r"[ \t\r\n\f\xa0]+")
START = re.compile(r"-?\d{1,9}")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript noframes noembed iframe object audio video canvas datalist title meta link base param source track area".split())
#: Inside svg and math these are tags of their own, "svg" before the name.
UNDRAWN = frozenset("title desc metadata defs annotation annotation-xml mphantom".split())
DRAWN = UNDRAWN | frozenset("text tspan".split())
UNSEEN |= {f"svg {t}" for t in UNDRAWN}
DRAWINGS = frozenset(("svg", "g"))
APART = frozenset(("svg text", "mfrac", "mtr", "mtd"))  # as are the parts of an mfrac
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article nav aside header footer main address form li dt dd tr caption thead tbody tfoot details summary figcaption hr legend center dir menu option".split())
#: A start tag on the left ends an open element on the right, not beyond the scope.
ENDS = {t: ({"p"}, frozenset("button td th caption table".split())) for t in BLOCKS - {"li", "dt", "dd", "tr", "html", "body", "caption", "thead", "tbody", "tfoot", "option"}}
LISTS = frozenset("ul ol dir menu table td th".split())
ENDS |= {"li": ({"li", "p"}, LISTS), "dt": ({"dt", "dd", "p"}, frozenset(("dl", "td", "th"))), "dd": ({"dt", "dd", "p"}, frozenset(("dl", "td", "th")))}
ENDS |= {t: ({"td", "th", "caption"}, frozenset(("tr", "table"))) for t in ("td", "th")}
ENDS |= {"tr": ({"tr", "td", "th", "caption"}, frozenset(("table",))), "option": ({"option"}, frozenset(("select", "datalist")))}
ENDS |= {t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, frozenset(("table",))) for t in ("thead", "tbody", "tfoot")}
#: An end tag does not reach out of these.
WALLS = frozenset("td th table".split())
FREE_ENDS = WALLS | {"tr", "thead", "tbody", "tfoot"}
CLOSES = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class Open:
    """The open elements: a stack, and where each tag stands in it, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, length: int) -> None:
        while len(self.stack) > length:
            self.at[self.stack.pop().tag].pop()

    def top(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def end(self, names: set[str], scope: frozenset) -> None:
        """Close all up to the outermost open element of names inside the scope."""
        wall = self.top(scope - names)
        hits = [places[bisect_right(places, wall)] for t in names if (places := self.at.get(t)) and places[-1] > wall]
        if hits:
            self.cut(min(hits))

    def drawing(self) -> bool:
        return bool(self.at.get("svg") or self.at.get("math"))


def tag_rest(page: str, at: int, missing: set[str]) -> tuple[dict[str, str], int, bool]:
    """Attributes from `at` on, where the tag ends, and whether a slash ends it.

    Only a quote right after `=` opens a quoted value; if none closes it on the page (`missing` keeps which quotes
    do not come again), the value ends like an unquoted one. A `>` comes later, as the caller has made sure.
    """
    attrs: dict[str, str] = {}
    while True:
        at = GAP.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return attrs, at + 1, page[at - 1] == "/"
        m = NAME.match(page, at)
        name, value, at = m[0].lower(), "", m.end()
        if m := EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote in QUOTES:
                close = -1 if quote in missing else page.find(quote, at + 1)
                if close < 0:
                    missing.add(quote)
                    m = BARE.match(page, at + 1)
                    value, at = m[0], m.end()
                else:
                    value, at = page[at + 1 : close], close + 1
            else:
                m = BARE.match(page, at)
                value, at = m[0], m.end()
        attrs.setdefault(name, html.unescape(value) if "&" in value else value)


def parse(page: str) -> Node:
    """The tree of a page; every byte is read a bounded number of times."""
    root = Node("html", {})
    opened = Open(root)
    last = page.rfind(">")
    missing: set[str] = set()
    begin = at = 0

    def text(s: str) -> None:
        if s:
            opened.stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    while (lt := page.find("<", at)) >= 0:
        head = TAG.match(page, lt)
        if not head:  # a sign, no tag
            at = lt + 1
            continue
        mark, tag = head[1], (head[2] or "").lower()
        if not tag:  # a comment or a declaration
            text(page[begin:lt])
            if page.startswith("<!--", lt):
                end, width = page.find("-->", lt + 2), 3
            elif page.startswith("<![CDATA[", lt) and opened.drawing():
                end, width = page.find("]]>", lt), 3
                opened.stack[-1].kids.append(page[lt + 9 : end if end >= 0 else len(page)])
            else:
                end, width = page.find(">", lt), 1
            begin = at = end + width if end >= 0 else len(page)
            continue
        if last < head.end():  # no tag is closed from here on: the rest is text
            break
        text(page[begin:lt])
        if page[head.end()] == ">":
            attrs, at, slash = {}, head.end() + 1, False
        else:
            attrs, at, slash = tag_rest(page, head.end(), missing)
        begin = at
        if tag in DRAWN and opened.drawing():
            tag = f"svg {tag}"
        if mark:
            place = opened.top((tag,))
            if place and (tag in FREE_ENDS or place > opened.top(WALLS)):
                opened.cut(place)
            continue
        if tag == "html":
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            continue
        if tag == "body":
            if not opened.at.get("body"):
                opened.cut(1)  # ends an open head
                opened.stack[-1].kids.append(node := Node(tag, attrs))
                opened.push(node)
            continue
        if tag in BLOCKS and opened.stack[-1].tag == "head":
            opened.cut(len(opened.stack) - 1)
        if tag in ENDS:
            opened.end(*ENDS[tag])
        node = Node(tag, attrs)
        opened.stack[-1].kids.append(node)
        slash = slash and opened.drawing()  # elsewhere it says nothing
        if tag in RAW and not slash:
            close = CLOSES[tag].search(page, at)
            inner = page[at : close.start() if close else len(page)]
            node.kids.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            begin = at = page.find(">", close.end()) + 1 if close and close.end() <= last else len(page)
        elif tag not in VOID and not slash:
            opened.push(node)
    text(page[begin:])
    return root


def unseen(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a:
        return True
    if (node.tag in DRAWINGS or node.tag.startswith("svg ")) and (a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse")):
        return True
    return bool(a) and (bool(HIDING.search(a.get("style", ""))) or (node.tag == "input" and a.get("type", "").lower() == "hidden"))


class Lines:
    """Text as lines: inline text collapses its spaces, blocks start new lines, gaps of empty lines do not add up.

    An item indents what is in it, to INDENT columns at most, and has a mark before its first line.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.outer: list[tuple[str, int]] = []
        self.prefix, self.base = "", 0
        self.mark: str | None = None

    def inline(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if not self.line:
            s = s.lstrip(" ")
        elif self.line[-1].endswith(" ") and s.startswith(" "):
            s = s[1:]
        if s:
            self.line.append(s)

    def close(self) -> None:
        if s := "".join(self.line).rstrip(" "):
            self._add(s)
        self.line = []

    def _add(self, s: str) -> None:
        if s:
            self.lines.append((self.prefix if self.mark is None else self.mark) + s)
            self.mark = None
        else:
            self.lines.append("")

    def gap(self) -> None:
        self.close()
        if len(self.lines) > self.base and self.lines[-1]:
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        self.close()
        for s in lines:
            self._add(s)

    def enter(self, mark: str = "") -> None:
        self.close()
        self.outer.append((self.prefix, self.base))
        self.base = len(self.lines)
        before = self.prefix if self.mark is None else self.mark
        if mark.strip():
            self.mark = before + mark if len(before) < INDENT else before
        if len(self.prefix) < INDENT:
            self.prefix += " " * len(mark)

    def leave(self, item: bool = False) -> None:
        self.close()
        while len(self.lines) > self.base and not self.lines[-1]:
            self.lines.pop()
        if item:
            if len(self.lines) == self.base:
                self.lines.append("")
            self.mark = None
        self.prefix, self.base = self.outer.pop()

    def done(self) -> list[str]:
        self.close()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return max(1, min(int(value), most)) if value.isascii() and value.isdigit() and len(value) < 10 else 1


class Table:
    """Captions and stray text above, then rows with cells padded to the widest of their column.

    A cell takes the first column that no cell from above spans. Cells over several columns, and lines of over
    WIDE characters, widen no column; what would reach over stands two spaces on. From column COLUMNS on cells follow
    each other.
    """

    def __init__(self):
        self.above = Lines()
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.until: dict[int, int] = {}
        self.next = 0

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, node: Node) -> list:
        """A place for the cell's lines, which are put there when they are known."""
        if not self.rows:
            self.row()
        now = len(self.rows)
        while self.until.get(self.next, 0) >= now:
            self.next += 1
        cols, rows = span(node, "colspan", COLUMNS), span(node, "rowspan", 65_534)
        if rows > 1:
            for c in range(self.next, min(self.next + cols, COLUMNS)):
                self.until[c] = now + rows - 1
        place: list[str] = []
        self.rows[-1].append((self.next, cols, place))
        self.next += cols
        return place

    def done(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, cols, cell in row:
                if c < COLUMNS:
                    width[c] = max(width.get(c, 0), *(len(x) for x in cell if cols == 1 and len(x) <= WIDE), 0)
        start, at = {}, 0
        for c in sorted(width):
            start[c] = at
            at += width[c] + 2
        out = self.above.done()
        for row in self.rows:
            for i in range(max((len(cell) for _, _, cell in row), default=0)):
                parts, n = [], 0
                for c, _, cell in row:
                    if i < len(cell) and cell[i]:
                        pad = max(start.get(c, 0) - n, 2 if n else 0)
                        parts += (" " * pad, cell[i])
                        n += pad + len(cell[i])
                out.append("".join(parts).rstrip(" "))
        return out


def block(root: Node) -> list[str]:
    """The lines of what is in a node, by a list of things to do instead of recursion: pages may nest without end."""
    top = Lines()
    todo: list = []

    def inside(node: Node, out: Lines, depth: int, how=None) -> None:
        how = how or flow
        todo.extend((how, node, kid, out, depth) for kid in reversed(node.kids))

    def later(call, *args) -> None:
        todo.append((lambda *_: call(*args), None, None, None, 0))

    def flow(parent: Node, kid: Node | str, out: Lines, depth: int) -> None:
        if isinstance(kid, str):
            if parent.tag not in DRAWINGS or not kid.isspace():
                out.inline(kid)
            return
        tag = kid.tag
        if unseen(kid):
            return
        if tag == "br":
            out.close() if out.line else out.gap()
        elif tag == "hr":
            out.gap()
        elif tag == "pre":
            out.gap()
            out.whole(plain(kid).strip("\n").split("\n"))
            out.gap()
        elif tag == "table" and depth < NESTED:
            out.gap()
            own = Table()
            later(lambda: (out.whole(own.done()), out.gap()))
            inside(kid, own, depth + 1, in_table)
        elif tag in ("td", "th", "tr", "caption"):  # of tables too deep, or without one
            out.close()
            later(out.close)
            inside(kid, out, depth)
        elif tag in ("ul", "ol", "dir", "menu"):
            around = out.close if parent.tag == "li" else out.gap
            around()
            later(around)
            in_list(kid, out, depth)
        elif tag == "dd":
            out.enter("  ")
            later(out.leave)
            inside(kid, out, depth)
        elif tag == "details" and "open" not in kid.attrs:
            out.close()
            for x in reversed(kid.kids):
                if isinstance(x, Node) and x.tag == "summary":
                    later(out.leave)
                    inside(x, out, depth)
                    later(out.enter)
        elif tag == "textarea" or tag == "button" or tag in APART or parent.tag == "mfrac":
            out.inline(" ")
            later(out.inline, " ")
            inside(kid, out, depth)
        elif tag == "svg tspan" and not kid.attrs.keys().isdisjoint("xy"):
            out.inline(" ")
            inside(kid, out, depth)
        elif tag in BLOCKS:
            around = out.gap if tag in PARAGRAPHS else out.close
            around()
            later(around)
            inside(kid, out, depth)
        else:
            inside(kid, out, depth)

    def in_list(node: Node, out: Lines, depth: int) -> None:
        number = int(node.attrs["start"]) if START.fullmatch(node.attrs.get("start", "")) else 1
        steps = []
        for kid in node.kids:
            if isinstance(kid, str):
                if kid.strip():
                    steps += [(lambda *_, s=kid: out.whole([" ".join(s.split())]), None, None, None, 0)]
            elif not unseen(kid):
                item = kid.tag == "li"
                mark = (f"{number}. " if node.tag == "ol" else "- ") if item else ""
                number += item
                steps.append((lambda *_, m=mark: out.enter(m), None, None, None, 0))
                steps.append((lambda kid, *_: inside(kid, out, depth), kid, None, None, 0) if item else (flow, PLAIN, kid, out, depth))
                steps.append((lambda *_, i=item: out.leave(i), None, None, None, 0))
        todo.extend(reversed(steps))

    def in_table(parent: Node, kid: Node | str, own: Table, depth: int) -> None:
        if isinstance(kid, str):
            own.above.inline(kid)
        elif unseen(kid):
            return
        elif kid.tag in ("thead", "tbody", "tfoot", "tr"):
            if kid.tag == "tr":
                own.row()
            inside(kid, own, depth, in_table)
        elif kid.tag in ("td", "th"):
            place, cell = own.cell(kid), Lines()
            later(lambda: place.extend(cell.done()))
            inside(kid, cell, depth)
        else:
            own.above.enter()
            later(own.above.leave)
            inside(kid, own.above, depth)

    inside(root, top, 0)
    while todo:
        how, *args = todo.pop()
        how(*args)
    return top.done()


PLAIN = Node("div", {})


def plain(node: Node) -> str:
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        elif not unseen(k):
            apart = [" "] if k.tag in APART else []
            todo += [*apart, *reversed(k.kids), *apart]
    return "".join(out)


def page_text(page: str | None) -> str:
    return "\n".join(block(parse(page))) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`row` (all columns of pages) and `text`."""
    lean_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def rendered(column_: pd.Series) -> pd.Series:
        return column_.map(page_text)

    return pack(pages).select("row", rendered(F.col("row")[column]).alias("text"))


def op8_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select(F.col("row.page_id").alias("page_id"), F.length("text").cast("long").alias("n_chars"), "text")
