"""HTML extraction as a layout-aware rendering of all visible text.

A tree builder reads a page with the implied start and end tags of HTML, and a renderer lays the tree out:
blocks stand on lines of their own, with a blank line around those that have a margin; list items carry
bullets or numbers and are indented by depth; table cells are padded to the widths of their columns;
preformatted text keeps its lines; margins collapse, also through blocks without one. Invisible elements (by tag,
``hidden``, ``display`` or ``visibility``, closed details and dialogs) give nothing; buttons made by ``input`` show their
value. Neither the builder nor the renderer recurses, so elements may nest to any depth, and finding an open element
takes no search through those in between.

Defined results: a null page gives a null text, an empty page an empty one; broken markup never fails (stray
end tags are ignored, open elements end with their parent); pages of any length and depth are read whole; where the
padding of a table would be over ``PADDING`` times its text, columns are padded less and longer cells go on beyond
their column, without loss of text; an empty table of pages gives an empty one; rows repeated give equal texts; input
columns named like a new one are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: A table may be padded to this many times its text (and a page of 64 KB besides).
PADDING = 16

# HTML element names by their treatment.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe noembed noframes xmp textarea title".split())
INVISIBLE = frozenset(
    "head title script style template noscript iframe noembed noframes object canvas audio video datalist map param source track meta link base".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
MARGIN = frozenset("blockquote dir dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul xmp".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul li dd dt listing plaintext xmp".split()
)
LISTS = frozenset("ul ol menu dir".split())
ROW_GROUPS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
PREFORMATTED = frozenset("pre listing plaintext xmp textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BUTTONS = frozenset("submit reset button".split())

#: New tag: (open elements that it ends, elements that such an ending does not reach beyond).
IMPLIED_ENDS = {
    "li": (frozenset({"li"}), LISTS | {"table", "td", "th"}),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset({"table"})),
    "td": (CELLS | {"caption"}, frozenset({"table", "tr"})),
    "th": (CELLS | {"caption"}, frozenset({"table", "tr"})),
    "thead": (ROW_GROUPS | {"caption", "colgroup"}, frozenset({"table"})),
    "tbody": (ROW_GROUPS | {"caption", "colgroup"}, frozenset({"table"})),
    "tfoot": (ROW_GROUPS | {"caption", "colgroup"}, frozenset({"table"})),
    "caption": (frozenset({"caption"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "rt": (frozenset({"rt", "rp"}), frozenset({"ruby"})),
    "rp": (frozenset({"rt", "rp"}), frozenset({"ruby"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
#: End tags of these do not reach beyond a cell, a caption or (in lists) the nearest list.
SCOPES = frozenset("table td th caption template html".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?>[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


_PARAGRAPH = frozenset({"p"})


class TreeBuilder:
    """Builds a tree from tags; what HTML implies is opened and closed on the way."""

    def __init__(self) -> None:
        self.root = Element("html")
        self.open = [self.root]
        #: Where in ``open`` the elements of a tag are.
        self.places: dict[str, list[int]] = {"html": [0]}

    def build(self, page: str) -> Element:
        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.match(page, at)
            at = m.end()
            if m["text"]:
                self.text(html.unescape(m["text"]))
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self.end(tag)
                    continue
                attrs = m["attrs"]
                self.start(tag, _attributes(attrs) if "=" in attrs or attrs.strip(" /\n\t") else {}, attrs.endswith("/"))
                if tag in RAW_TEXT and self.open[-1].tag == tag:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    raw = page[at : close.start() if close else end]
                    if tag not in INVISIBLE and raw:
                        self.open[-1].children.append(html.unescape(raw) if tag == "textarea" else raw)
                    at = close.end() if close else end
                    self._end_from(len(self.open) - 1)
        return self.root

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._end_from(len(self.open) - 1)
        self.open[-1].children.append(data)

    def _end_from(self, at: int) -> None:
        """End the open elements from this place on."""
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags: frozenset[str]) -> int:
        """Where the innermost open element of these tags is, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def _end_back_to(self, tags: frozenset[str], stops: frozenset[str]) -> None:
        at = self._last(tags)
        if at > 0 and at >= self._last(stops):
            self._end_from(at)

    def _push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        self.places.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._end_from(len(self.open) - 1)
        if tag in ENDS_PARAGRAPH and self.places.get("p"):
            self._end_back_to(_PARAGRAPH, SCOPES | {"button"})
        if tag in IMPLIED_ENDS:
            self._end_back_to(*IMPLIED_ENDS[tag])
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._end_from(len(self.open) - 1)
        if tag in CELLS and self.open[-1].tag in ROW_GROUPS | {"table"}:
            self._push(Element("tr"))
        element = Element(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(element)
        else:
            self._push(element)
            if closed and tag in ("svg", "math"):
                self._end_from(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Element("br"))
            return
        if not self.places.get(tag) or tag in ("html", "body"):
            return
        stops = SCOPES - {tag} if tag != "table" else frozenset({"html"})
        if tag in ROW_GROUPS | {"tr"}:
            stops = frozenset({"table", "html"})
        if tag == "li":
            stops = stops | LISTS
        self._end_back_to(frozenset({tag}), stops)


def _hidden(e: Element) -> bool:
    if e.tag in INVISIBLE or "hidden" in e.attrs or e.tag == "dialog" and "open" not in e.attrs:
        return True
    return "style" in e.attrs and bool(_HIDING.search(e.attrs["style"]))


def _number(value: str | None, default: int) -> int:
    try:
        return int((value or "").strip())
    except ValueError:
        return default


class _Lines:
    """Lines of a block under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.margin = False

    def flush(self) -> None:
        """End the line of inline text, if there is any."""
        if self.inline:
            text = "".join(self.inline)
            self.inline = []
            for part in text.split("\n"):
                part = part.strip(" ")
                self._add(part if "\x00" not in part else part.replace("\x00", " ").rstrip())

    def _add(self, line: str) -> None:
        if line:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            self.lines.append(line)

    def edge(self, margin: bool) -> None:
        """Where a block begins or ends."""
        self.flush()
        self.margin |= margin

    def block(self, lines: list[str], margin: bool) -> None:
        self.edge(margin)
        if lines:
            if self.margin and self.lines:
                self.lines.append("")
            self.lines += lines
            self.margin = margin

    def word(self, text: str) -> None:
        """Inline text with white space collapsed, also across elements."""
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.inline or self.inline[-1].endswith((" ", "\n"))):
            text = text[1:]
        if text:
            self.inline.append(text)


Step = Generator["Step", object, object]


def _run(step: Step):
    """Run a generator whose yields are calls of others, on a stack of our own instead of Python's."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class Renderer:
    """Lays a tree out. The methods that yield are steps of ``_run``: ``x = yield self.block(...)`` is a call."""

    def render(self, root: Element) -> str:
        return "\n".join(_run(self.block(root, True)))

    def block(self, e: Element, visible: bool) -> Step:
        """Lines of an element laid out by itself."""
        out = _Lines()
        yield self.children(e, out, self._visible(e, visible), False)
        out.flush()
        return out.lines

    @staticmethod
    def _visible(e: Element, inherited: bool) -> bool:
        if "style" in e.attrs and (m := _VISIBILITY.search(e.attrs["style"])):
            return m[1].lower() == "visible" or m[1].lower() == "inherit" and inherited
        return inherited

    def children(self, e: Element, out: _Lines, visible: bool, pre: bool) -> Step:
        shut = e.tag == "details" and "open" not in e.attrs
        ordinal = None
        if e.tag == "ol":
            items = sum(isinstance(c, Element) and c.tag == "li" for c in e.children)
            ordinal = _number(e.attrs.get("start"), items if "reversed" in e.attrs else 1)
        for c in e.children:
            if isinstance(c, str):
                if not visible or shut:
                    continue
                if pre:
                    out.inline.append(c.replace("\r\n", "\n").replace("\t", "    ").replace(" ", "\x00"))
                elif e.tag not in LISTS | ROW_GROUPS | {"table", "tr"} or c.strip():
                    out.word(c)
                continue
            if _hidden(c) or shut and c.tag != "summary":
                continue
            seen, tag = self._visible(c, visible), c.tag
            if tag == "br":
                out.inline.append("\n")
            elif tag == "hr":
                out.block([], True)
            elif tag == "input":
                if seen and c.attrs.get("type", "").strip().lower() in BUTTONS:
                    out.word(c.attrs.get("value", ""))
            elif tag == "img":
                continue
            elif tag == "table":
                out.block((yield self.table(c, seen)), True)
            elif tag == "li":
                ordinal = yield self.item(c, out, visible, ordinal, "reversed" in e.attrs)
            elif tag in PREFORMATTED:
                inner = _Lines()
                yield self.children(c, inner, seen, True)
                text = "".join(inner.inline).replace("\x00", " ")
                lines = inner.lines + [x.rstrip() for x in text.removeprefix("\n").rstrip("\n ").split("\n")]
                out.block(lines if any(lines) else [], True)
            elif tag in LISTS:
                out.block((yield self.block(c, visible)), e.tag != "li")
            elif tag in ("dd", "blockquote"):
                lines = yield self.block(c, visible)
                out.block(["  " + x if x else x for x in lines], tag in MARGIN)
            elif tag in BLOCK:  # in the same lines: nothing is copied, however deep blocks nest
                out.edge(tag in MARGIN)
                yield self.children(c, out, seen, pre)
                out.edge(tag in MARGIN)
            else:
                yield self.children(c, out, seen, pre)

    def item(self, e: Element, out: _Lines, visible: bool, ordinal: int | None, down: bool) -> Step:
        """Lay out an item of a list; returns the next item's number."""
        if ordinal is not None:
            ordinal = _number(e.attrs.get("value"), ordinal)
        mark = f"{ordinal}. " if ordinal is not None else "- "
        lines = yield self.block(e, visible)
        if lines:
            pad = " " * len(mark)
            out.block([mark + lines[0], *(pad + x if x else x for x in lines[1:])], False)
        return None if ordinal is None else ordinal - 1 if down else ordinal + 1

    def table(self, e: Element, visible: bool) -> Step:
        """Rows of cells, each padded to its column; cells that span rows or columns hold their place."""
        before: list[str] = []
        groups: dict[str, list[list[tuple[Element, bool]]]] = {"thead": [], "tbody": [], "tfoot": []}
        parts = [(c, "tbody", visible) for c in reversed(e.children)]
        while parts:
            c, group, seen = parts.pop()
            if isinstance(c, str):
                if seen and c.strip():
                    before.append(_SPACE.sub(" ", c).strip())
            elif _hidden(c) or c.tag == "colgroup":
                continue
            elif c.tag in ROW_GROUPS:
                parts += [(x, c.tag, self._visible(c, seen)) for x in reversed(c.children)]
            elif c.tag == "tr":
                in_row = self._visible(c, seen)
                groups[group].append([(x, in_row) for x in c.children if isinstance(x, Element) and x.tag in CELLS and not _hidden(x)])
                loose = Element("div")
                loose.children = [x for x in c.children if not (isinstance(x, Element) and x.tag in CELLS)]
                before += yield self.block(loose, in_row)
            else:
                holder = Element("div")
                holder.children = [c]
                before += yield self.block(holder, seen)
        grid: list[list[tuple[int, list[str], int]]] = []
        spans: list[tuple[int, int, int]] = []  # columns that cells of earlier rows hold: (first, end, rows left)
        for row in (r for g in groups.values() for r in g):
            placed, held, column, k = [], [], 0, 0
            for cell, seen in row:
                while k < len(spans) and spans[k][0] <= column:
                    column = max(column, spans[k][1])
                    k += 1
                wide = min(max(1, _number(cell.attrs.get("colspan"), 1)), 1000)
                high = min(max(1, _number(cell.attrs.get("rowspan"), 1)), 65534)
                placed.append((column, (yield self.block(cell, seen)), wide))
                if high > 1:
                    held.append((column, column + wide, high - 1))
                column += wide
            spans = sorted([*((a, b, n - 1) for a, b, n in spans if n > 1), *held])
            grid.append(placed)
        return [x for x in [*before, *self._aligned(grid)] if x.strip()]

    @staticmethod
    def _aligned(grid: list[list[tuple[int, list[str], int]]]) -> list[str]:
        widths = {column: 0 for row in grid for column, _, _ in row}
        for row in grid:
            for column, lines, wide in row:
                if wide == 1:
                    widths[column] = max(widths[column], max(map(len, lines), default=0))
        size = sum(len(x) for row in grid for _, lines, _ in row for x in lines)
        height = sum(max((len(lines) for _, lines, _ in row), default=0) for row in grid)
        while height * sum(widths.values()) > PADDING * size + 65536 and max(widths.values()) > 8:
            most = max(widths.values()) // 2
            widths = {c: min(w, most) for c, w in widths.items()}
        starts, at = {}, 0
        for column in sorted(widths):
            starts[column] = at
            at += widths[column] + 2
        out = []
        for row in grid:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                line = ""
                for column, lines, _ in row:
                    if k < len(lines) and lines[k]:
                        line = (line.ljust(starts[column]) if len(line) < starts[column] or not line else line + "  ") + lines[k]
                out.append(line.rstrip())
        return out


def render(page: str | None) -> str | None:
    """All visible text of a page."""
    if page is None:
        return None
    return Renderer().render(TreeBuilder().build(page.replace("\x00", "")))


def extract_text(pages: DataFrame, markup: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``: the rendering of each whole page."""

    def make():
        return lambda texts: [[None if t is None else render(t.decode("utf-8", "replace")) for t in texts]]

    return map_texts(pages, {"text": T.StringType()}, make, markup, keep)
