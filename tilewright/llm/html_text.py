"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware rendering.

Rendered: all text of visible elements, white space collapsed outside <pre> and <textarea>; blocks on lines of
their own, with an empty line around paragraphs, headings, lists, quotes, tables and the like; <br> and <hr>;
list items with `- ` or their number, indented by two blanks for each list around them; table cells padded to
their column's width (in terminal columns) and separated by ` | `, with the columns and rows that they span left
empty (HTML's limits: 1000 columns, 65534 rows) and columns without any text left out; the texts of SVG images, a
line each; the labels of buttons. Not rendered: comments, markup declarations, head, script, style, template and
other elements without boxes, `hidden` (unless a style displays it), display:none, visibility:hidden or collapse
(but a visible element inside shows), fields. Entities are decoded. Malformed markup never fails: unclosed tags end
where HTML's rules imply it, stray end tags are ignored, a `<` that begins no tag is text.

Null or empty html, or one without visible text: empty text. Repeated rows and ties: each is rendered. Neither the
builder nor the renderer recurses, and both work in time linear in the page, so pages are read in whole, however
long or deeply nested. Extra columns are not read. Empty table: empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
NO_BOX = frozenset("head title script style template noscript noembed noframes iframe object audio video canvas annotation annotation-xml datalist meta link base param source track map area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form fieldset legend li dt dd tr caption thead tbody tfoot figcaption details summary center dir option optgroup select textarea hgroup search".split())
CELLS = frozenset(("td", "th"))
#: A start tag on the left ends the open elements on the right, up to the nearest of SCOPE.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
P_SCOPE = frozenset("td th caption button object table".split())
TABLE_TAGS = frozenset("table tr td th tbody thead tfoot body html".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{x: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, {"html"}),
}
TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|([!?][^>]*>?)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
HUGE = re.compile(r"&#[0-9]{8,};?")  # numbers beyond all characters
NUMBER = re.compile(r"[ \t\n\r\f]*\+?([0-9]+)")
LABELLED = frozenset("submit button reset".split())
SPACE = re.compile(r"[ \t\n\r\f]+")
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # HTML's limits for colspan and rowspan
PRE, TEXTAREA = "pre", "textarea"


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


class _Open:
    """The open elements, and where those of each tag are among them."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, n: int) -> None:
        while len(self.nodes) > n:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def first_after(self, tags, n: int) -> int | None:
        return min((own[k] for t in tags if (own := self.at.get(t)) and (k := bisect_right(own, n)) < len(own)), default=None)

    def imply(self, tag: str) -> None:
        """Ends what a start tag ends."""
        ends, scope = ({"p"}, P_SCOPE) if tag in ENDS_P else IMPLIED.get(tag, ((), ()))
        if ends and (n := self.first_after(ends, self.last(scope))) is not None:
            self.cut(n)

    def close(self, tag: str) -> None:
        n = self.last((tag,))
        if n and (tag in TABLE_TAGS or self.last(("table", "td", "th")) <= n):
            self.cut(n)


def unescaped(text: str) -> str:
    return html.unescape(HUGE.sub("\ufffd", text)) if "&" in text else text


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescaped(a or b or c))
    return out


def parse(source: str) -> Node:
    """The tree of the markup, all below one root."""
    root = Node("#root")
    open_, at, n = _Open(root), 0, len(source)
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            open_.nodes[-1].children.append(unescaped(source[at:begin]))
        if begin == n:
            break
        m = TAG.match(source, begin)
        if not m:
            open_.nodes[-1].children.append("<")
            at = begin + 1
            continue
        at = m.end()
        if not m[4]:
            continue
        tag = m[4].lower()
        if m[3]:
            open_.close(tag)
            continue
        open_.imply(tag)
        node = Node(tag, attributes(m[5]) if m[5].strip(" /\n\t\r\f") else {})
        open_.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            inner, at = (source[at : end.start()], end.end()) if end else (source[at:], n)
            node.children.append(unescaped(inner) if tag in ("textarea", "title") else inner)
        elif tag not in VOID and not (m[5].endswith("/") and open_.at.get("svg")) and not (tag == "svg" and m[5].endswith("/")):
            open_.push(node)
    return root


def styles(node: Node) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in STYLE.findall(node.attributes["style"])} if "style" in node.attributes else {}


def displayed(node: Node, style: dict[str, str]) -> bool:
    a = node.attributes
    if node.tag in NO_BOX or style.get("display") == "none" or (node.tag == "dialog" and "open" not in a):
        return False
    return "hidden" not in a or "display" in style


def span(node: Node, name: str, most: int) -> int:
    m = NUMBER.match(node.attributes.get(name, ""))
    return min(int(m[1].lstrip("0")[:6] or 0), most) if m else 1


def columns(text: str) -> int:
    """Columns that text takes in a terminal."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Table:
    """Cells by row and column; busy: rows that a column is still taken for by cells from above."""

    def __init__(self):
        self.rows, self.busy, self.at = [], {}, 0

    def row(self) -> None:
        self.busy = {c: n - 1 for c, n in self.busy.items() if n > 1}
        self.rows.append({})
        self.at = 0

    def cell(self, text: str, wide: int, high: int) -> None:
        while self.at in self.busy:
            self.at += 1
        if text:
            self.rows[-1][self.at] = text
        if high > 1:
            self.busy |= dict.fromkeys(range(self.at, self.at + wide), high)
        self.at += wide

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, text in row.items():
                width[c] = max(width.get(c, 0), columns(text))
        used, out = sorted(width), []
        for row in filter(None, self.rows):
            cells = [row.get(c, "") for c in used]
            out.append(" | ".join(x + " " * (width[c] - columns(x)) for c, x in zip(used, cells)).rstrip())
        return out


class _Frame:
    """Lines under construction; the last one in parts."""

    def __init__(self):
        self.done, self.parts, self.space = [], [], False

    def text(self, words: str, pre: bool = False) -> None:
        if pre:
            first, *rest = words.split("\n")
            self.parts.append(first)
            for part in rest:
                self.break_line(False)
                self.parts.append(part)
            return
        lead, trail = words[:1] in " \t\n\r\f", words[-1:] in " \t\n\r\f"
        words = SPACE.sub(" ", words).strip(" ")
        if not words:
            self.space = self.space or lead
            return
        if self.parts and (self.space or lead):
            self.parts.append(" ")
        self.parts.append(words)
        self.space = trail

    def break_line(self, strip: bool = True) -> None:
        line = "".join(self.parts)
        self.done.append(line.rstrip() if strip else line)
        self.parts, self.space = [], False

    def end_line(self) -> None:
        if "".join(self.parts).strip():
            self.break_line()
        self.parts, self.space = [], False

    def blank(self) -> None:
        self.end_line()
        if self.done and self.done[-1] != "":
            self.done.append("")

    def lines(self) -> list[str]:
        self.end_line()
        a, b = 0, len(self.done)
        while b > a and not self.done[b - 1]:
            b -= 1
        while a < b and not self.done[a]:
            a += 1
        return self.done[a:b]


def render(root: Node) -> str:
    frames, lists, tables, pres, drawn = [_Frame()], [], [], 0, 0
    # drawn: inside svg; texts there are those of its <text> elements alone
    stack: list[tuple] = [(root, False, True, True)]  # node or text, leaving, visible, whether text shows
    while stack:
        node, leaving, shown, worded = stack.pop()
        if isinstance(node, str):
            if shown and worded:
                frames[-1].text(node, pres > 0)
            continue
        tag, f = node.tag, frames[-1]
        if not leaving:
            style = styles(node)
            if not displayed(node, style):
                continue
            shown = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"), shown)
            if tag == "br":
                f.break_line()
                continue
            if tag == "input":
                if shown and node.attributes.get("type", "").lower() in LABELLED and node.attributes.get("value", "").strip():
                    f.text(node.attributes["value"])
                continue
            worded = False if tag == "svg" else True if drawn and tag in ("text", "foreignobject") else worded
            drawn += tag == "svg"
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                f.blank()
            elif tag in BLOCK or drawn and tag == "text":
                f.end_line()
            if tag == "hr":
                if shown:
                    f.done.append("---")
                f.blank()
                continue
            if tag in (PRE, TEXTAREA):
                pres += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1")
                lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if tag == "ol" else None)
            elif tag == "li":
                frames.append(_Frame())
            elif tag == "table":
                tables.append(_Table())
                frames.append(_Frame())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in CELLS and tables:
                if not tables[-1].rows:
                    tables[-1].row()
                frames.append(_Frame())
            if tag not in VOID:
                stack.append((node, True, shown, worded))
                stack += [(c, False, shown, worded) for c in reversed(node.children)]
            continue
        drawn -= tag == "svg"
        if tag in (PRE, TEXTAREA):
            pres -= 1
            f.break_line(False)
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            frames.pop()
            mark, inner = "- ", f.lines()
            if lists and lists[-1] is not None:
                mark = f"{lists[-1]}. "
                lists[-1] += 1
            f = frames[-1]
            f.end_line()
            # an inner list's lines carry their own marks; all move under this item's text
            f.done += [(mark if i == 0 else "  ") + x if x else "" for i, x in enumerate(inner)]
            continue
        elif tag in CELLS and tables:
            frames.pop()
            cell = " ".join(x.strip() for x in f.lines() if x)
            tables[-1].cell(cell, max(1, span(node, "colspan", MOST_COLUMNS)), span(node, "rowspan", MOST_ROWS) or MOST_ROWS)
            continue
        elif tag == "table":
            frames.pop()
            loose, table = f.lines(), tables.pop()
            f = frames[-1]
            f.done += loose + table.lines()
        if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
            f.blank()
        elif tag in BLOCK or drawn and tag == "text":
            f.end_line()
    out = "\n".join(frames[0].lines())
    return re.sub(r"\n{3,}", "\n\n", out).replace("\xa0", " ")


def html_to_text(source) -> str:
    return render(parse(source)) if isinstance(source, str) and source else ""


def text_column(source: Column) -> Column:
    @F.pandas_udf("string")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([html_to_text(p) for p in pages], dtype=object)

    return rendered(source)


def extracted(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """Per row: page_id, text, n_chars, n_lines."""
    out = pages.select(F.col(page_id).alias("page_id"), text_column(F.col(source)).alias("text"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
