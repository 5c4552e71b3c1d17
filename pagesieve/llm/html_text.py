"""HTML extraction: a small tree builder and a layout-aware renderer of all visible text.

The tree builder closes what a start tag ends by itself (paragraphs, list items, table parts, options), keeps end tags
inside their table cell, and takes the text of raw elements as it is. The renderer drops what a browser does not show
(scripts, styles, heads, comments, `hidden`, `display:none`, closed details), collapses white space except in `pre`,
keeps block spacing (paragraph-like blocks are set off by an empty line), writes list items with bullets or
numbers, and pads table cells to columns, with the places that row and column spans take kept free.

Defined cases: a null page gives null, an empty one an empty text; unclosed tags, stray end tags and broken markup never fail;
elements may be nested to any depth, as tree builder and renderer keep stacks of their own; beyond `INDENT` nested lists, quotes and
cells indentation and padding grow no further, but bullets, rows and text stay. Cells wider than `WRAP` characters are broken between
words, those of a table's last column excepted; a longer word stands out. Columns in which no cell begins take no space; a table that
would take more than `PADDED` characters keeps its separators, but is not padded. Other columns stay; an input column
named as the added one is replaced.
"""

from __future__ import annotations

import math
import re
import textwrap
from collections.abc import Generator, Iterator
from html import unescape
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagesieve.llm.tables import map_arrow

#: So many nested lists, quotes and cells indent; without a bound the white space grows with the square of the depth.
INDENT = 100
WRAP = 40
#: Without a bound, one row of many wide cells and many rows that span them take the product of both.
PADDED = 1 << 24

# Fixed values of the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template iframe noembed noframes datalist object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table ul tr caption thead tbody tfoot td th textarea select".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure hr article section fieldset".split())
ENDS_P = BLOCK - frozenset("body html dd dt li option optgroup tr td th caption thead tbody tfoot legend textarea select".split())
# What a start tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
WALLS = frozenset("table td th caption template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']?[^\s>]*))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children = name, attributes, []


class Stack:
    """The open elements, and the places of each name among them, so that no search walks the stack."""

    def __init__(self, root: Element) -> None:
        self.items = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.items))
        self.items.append(element)

    def innermost(self, names: frozenset[str] | set[str]) -> int:
        """The place of the innermost open element of these names, 0 where there is none."""
        return max((found[-1] for name in names if (found := self.places.get(name))), default=0)

    def cut(self, place: int) -> None:
        """Close the element at this place and all within it."""
        for element in self.items[place:]:
            self.places[element.name].pop()
        del self.items[place:]


def build(html: str) -> Element:
    """The tree of a page."""
    root = Element("#root", {})
    stack = Stack(root)
    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            stack.items[-1].children.append(unescape(html[at:start]))
        if start >= n:
            break
        at = _markup(html, start, stack)
    return root


def _markup(html: str, start: int, stack: Stack) -> int:
    """Take in the markup that begins at `start`; where the rest begins."""
    if html.startswith("<!--", start):
        end = html.find("-->", start + 4)
        return len(html) if end < 0 else end + 3
    if html.startswith(("<!", "<?"), start):
        end = html.find(">", start)
        return len(html) if end < 0 else end + 1
    closing = html.startswith("/", start + 1)
    name = _NAME.match(html, start + 1 + closing)
    if not name:
        if closing:
            end = html.find(">", start)
            return len(html) if end < 0 else end + 1
        stack.items[-1].children.append("<")
        return start + 1
    tag, at, attributes = name[0].lower(), name.end(), {}
    while (found := _ATTRIBUTE.match(html, at)) and found.end() > at:
        key, value = found[1].lower(), found[2] or ""
        if value[:1] in "\"'" and len(value) > 1:
            value = value[1:-1]
        attributes.setdefault(key, unescape(value))
        at = found.end()
    end = html.find(">", at)
    at = len(html) if end < 0 else end + 1
    if closing:
        _close(stack, tag)
        return at
    _open(stack, tag, attributes)
    if tag in RAW:
        stop = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
        body = html[at : stop.start() if stop else len(html)]
        stack.items[-1].children.append(unescape(body) if tag in ("textarea", "title") else body)
        at = stop.start() if stop else len(html)
    return at


def _open(stack: Stack, tag: str, attributes: dict[str, str]) -> None:
    if tag in ENDS_P:
        _close_up_to(stack, {"p"}, WALLS)
    if tag in CLOSES:
        names, walls = CLOSES[tag]
        while _close_up_to(stack, names, walls):
            pass
    element = Element(tag, attributes)
    stack.items[-1].children.append(element)
    if tag not in VOID:
        stack.push(element)


def _close_up_to(stack: Stack, names: set[str], walls: frozenset[str] | set[str]) -> bool:
    """Close the innermost element of these names, unless a wall is met first."""
    place = stack.innermost(names)
    if not place or place < stack.innermost(walls):
        return False
    stack.cut(place)
    return True


def _close(stack: Stack, tag: str) -> None:
    walls = frozenset({"table"}) if tag in WALLS or tag in ("tr", "tbody", "thead", "tfoot") else WALLS
    if tag == "table":
        walls = frozenset()
    _close_up_to(stack, {tag}, walls - {tag})


def hidden(element: Element) -> bool:
    attributes = element.attributes
    if element.name in UNSEEN or "hidden" in attributes:
        return True
    if element.name == "input" and attributes.get("type", "").lower() == "hidden":
        return True
    return "style" in attributes and bool(_HIDING.search(attributes["style"].lower()))


class Page:
    """Lines of text so far, the line in work, whether an empty line is due, and how many lists, quotes and cells are around."""

    def __init__(self, around: int = 0) -> None:
        self.around = around
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text:
            self.parts.append(text)

    def end_line(self, forced: bool = False) -> None:
        line = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
        self.parts = []
        if line or forced:
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def space(self) -> None:
        self.end_line()
        self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


#: A step of the renderer: yields the steps it needs the results of, and returns its own.
Step = Generator["Step", Any, Any]


def _run(step: Step) -> Any:
    """The result of a step, with the steps that wait for others on a stack of their own."""
    waiting, result = [step], None
    while waiting:
        try:
            step = waiting[-1].send(result)
        except StopIteration as done:
            waiting.pop()
            result = done.value
        else:
            waiting.append(step)
            result = None
    return result


def _walk(element: Element, page: Page) -> Step:
    children = element.children
    if element.name == "details" and "open" not in element.attributes:
        children = [child for child in children if isinstance(child, Element) and child.name == "summary"]
    for child in children:
        if isinstance(child, str):
            page.text(child)
        elif not hidden(child):
            yield _render(child, page)


def _inner(element: Element, around: Page) -> Step:
    """The lines of an element that is set apart within the page around it."""
    page = Page(around.around + 1)
    yield _walk(element, page)
    return page.done()


def _render(element: Element, page: Page) -> Step:
    name = element.name
    if name == "br":
        page.end_line(forced=True)
        return
    if name not in BLOCK:
        yield _walk(element, page)
        return
    page.space() if name in SPACED else page.end_line()
    if name == "pre" or name == "textarea":
        lines = _plain(element).strip("\n").split("\n")
        if any(lines):
            page.add([line.rstrip() for line in lines])
    elif name in ("ul", "ol", "menu", "dir"):
        yield _list(element, page)
    elif name == "table":
        yield _table(element, page)
    elif name in ("blockquote", "dd"):
        if lines := (yield _inner(element, page)):
            page.add(lines if page.around >= INDENT else [f"  {line}" if line else "" for line in lines])
    else:
        yield _walk(element, page)
    page.space() if name in SPACED else page.end_line()


def _plain(element: Element) -> str:
    """Text with its white space, of what is shown."""
    out, waiting = [], list(reversed(element.children))
    while waiting:
        child = waiting.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.name == "br":
            out.append("\n")
        elif not hidden(child):
            waiting += reversed(child.children)
    return "".join(out).replace("\r\n", "\n")


def _list(element: Element, page: Page) -> Step:
    number = element.attributes.get("start", "1")
    number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    for child in element.children:
        if isinstance(child, str):
            page.text(child)
        elif hidden(child):
            continue
        elif child.name != "li":
            yield _render(child, page)
        else:
            page.end_line()
            bullet = f"{number}. " if element.name == "ol" else "- "
            number += 1
            if lines := (yield _inner(child, page)):
                rest = " " * len(bullet) if page.around < INDENT else ""
                page.add([bullet + lines[0], *(rest + line if line else "" for line in lines[1:])])


def _span(cell: Element, name: str, most: int) -> int:
    """The value of a span, 0 as given: for rows it means all rows to the end of the group."""
    value = cell.attributes.get(name, "1")
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value) else 1


class Grid:
    """The cells of a table by row and column; cells that span rows keep their columns in the rows below."""

    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.number = 0
        self.held: list[tuple[int, int, float]] = []  # first column, end, row from which the columns are free

    def end_group(self) -> None:
        self.held = []

    def add(self, cells: list[tuple[list[str], int, int]]) -> None:
        """A row of cells: lines, columns and rows that each one spans."""
        held = [h for h in self.held if h[2] > self.number]
        row, column, at, more = {}, 0, 0, []
        for lines, columns, below in cells:
            while at < len(held) and held[at][0] <= column:
                column = max(column, held[at][1])
                at += 1
            row[column] = lines
            if below != 1:
                more.append((column, column + columns, self.number + below if below else math.inf))
            column += columns
        self.held = sorted(held + more)
        self.number += 1
        if any(row.values()):
            self.rows.append(row)

    def lines(self) -> Iterator[str]:
        """The rows as lines, columns in which no cell begins left out."""
        place = {c: k for k, c in enumerate(sorted({c for row in self.rows for c in row}))}
        rows = [{place[c]: cell for c, cell in row.items()} for row in self.rows]
        widths = [0] * len(place)
        for row in rows:
            for k, cell in row.items():
                if k < len(place) - 1:
                    row[k] = cell = [part for line in cell for part in _wrapped(line)]
                widths[k] = max([widths[k], *(len(line) for line in cell if len(line) <= WRAP)])
        ends = [0]
        for width in widths:
            ends.append(ends[-1] + width + 3)
        if sum(ends[max(row) + 1] * max(map(len, row.values())) for row in rows) > PADDED:
            widths = [0] * len(widths)
        for row in rows:
            # without padding the columns between cells are left out too
            columns = range(max(row) + 1) if any(widths) else sorted(row)
            for height in range(max(map(len, row.values()))):
                line = [cell[height] if height < len(cell := row.get(k, [])) else "" for k in columns]
                yield " | ".join(text.ljust(widths[k]) for k, text in zip(columns, line)).rstrip()


def _wrapped(line: str) -> list[str]:
    if len(line) <= WRAP:
        return [line]
    return textwrap.wrap(line, WRAP, expand_tabs=False, replace_whitespace=False, break_long_words=False, break_on_hyphens=False)


def _table(table: Element, page: Page) -> Step:
    grid = Grid()
    stray = Page(page.around)  # what stands in a table outside its cells is shown before it

    def visit(element: Element) -> Step:
        for child in element.children:
            if isinstance(child, str):
                stray.text(child)
            elif hidden(child):
                continue
            elif child.name in ("thead", "tbody", "tfoot", "colgroup"):
                grid.end_group()
                yield visit(child)
                grid.end_group()
            elif child.name == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, str):
                        stray.text(cell)
                    elif not hidden(cell) and cell.name in ("td", "th"):
                        columns = max(1, _span(cell, "colspan", MOST_COLUMNS))
                        cells.append(((yield _inner(cell, page)), columns, _span(cell, "rowspan", MOST_ROWS)))
                    elif not hidden(cell):
                        yield _render(cell, stray)
                grid.add(cells)
            else:
                yield _render(child, stray)

    yield visit(table)
    if before := stray.done():
        page.add(before)
    if page.around >= INDENT:
        for row in grid.rows:
            for height in range(max(map(len, row.values()))):
                page.add([" | ".join(cell[height] for cell in row.values() if height < len(cell) and cell[height])])
        return
    for line in grid.lines():
        page.add([line])


def extract(html: str | None) -> str | None:
    """All visible text of a page."""
    if html is None:
        return None
    page = Page()
    _run(_walk(build(html), page))
    return "\n".join(page.done()).strip("\n")


def extract_pages(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """The rows of `pages` with the visible text in place of the page."""
    held = [f for f in pages.schema.fields if f.name.lower() not in {column.lower(), into.lower()}]
    names = [f.name for f in held]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # a few pages at a time, as pages can be long
                part = batch.slice(first, 64)
                texts = pa.array([extract(one.as_py()) for one in part.column(column)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, texts], names=[*names, into])

    return map_arrow(pages, work, T.StructType([*held, T.StructField(into, T.StringType())]))
