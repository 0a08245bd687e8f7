"""Visible text of web pages, laid out as a browser would stack it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title svg math iframe object audio video canvas datalist rp".split())
#: Blocks with a blank line around them, and blocks that only begin a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address form li dt dd tr thead tbody tfoot caption "
    "figcaption details summary hr legend option optgroup center".split()
)
CELLS, ROWS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: A start tag closes the open elements named here, up to the border.
CLOSES = (
    {t: (("p",), ("table", "button", "td", "th", "object")) for t in BLOCK - {"html", "body", "li", "dt", "dd", "tr", "option", "optgroup"} - ROWS}
    | {"li": (("li", "p"), ("ul", "ol", "menu")), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",))}
    | {t: (("dt", "dd", "p"), ("dl",)) for t in ("dt", "dd")}
    | {t: (("td", "th", "p"), ("tr", "table")) for t in CELLS}
    | {"tr": (("tr", "td", "th", "p"), ("table", *ROWS))}
    | {t: (("tr", "td", "th", "p", "caption", *ROWS), ("table",)) for t in ROWS}
)
#: Start tags that may stand in a head; any other, and text, ends an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements whose content, whatever it is, leaves the head open.
HELD = frozenset("title style script noscript noframes template".split())
#: Foreign content; ``/>`` closes its elements, and the start tag of a block ends it, except below these parts of it.
FOREIGN, FOREIGN_TEXT = frozenset(("svg", "math")), frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Deeper elements become siblings, as in browsers; no text is lost.
DEPTH = 256
GAPS = re.compile(r"[ \t\n\r\f]+")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: A tag up to its end; quotes count after an equals sign only.
TAG = re.compile(r"""<[a-zA-Z/](?:[^>=]++|=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
OPENING = re.compile(r"<(?=[a-zA-Z/!?])")
RAW_TEXT = re.compile(r"<(script|style)(?=[ \t\n\r\f/>])", re.I)
RAW_ENDS = {t: re.compile(rf"</{t}(?=[ \t\n\r\f/>])", re.I) for t in ("script", "style")}
COMMENT_END = re.compile(r"--!?>")
WHOLE = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})")
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # of one cell, as in browsers


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []

    def hidden(self) -> bool:
        a = self.attributes
        closed = self.tag == "dialog" and "open" not in a
        return closed or self.tag in HIDDEN or "hidden" in a or bool(NOT_SHOWN.search(a.get("style") or ""))

    def number(self, name: str) -> int | None:
        """Whole number of an attribute; None if it is absent or none."""
        found = WHOLE.match(self.attributes.get(name) or "")
        return int(found[1]) if found else None


class TreeBuilder(HTMLParser):
    """Builds the element tree; end tags that HTML lets authors leave out are implied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body", {})
        self.open = [self.root]
        self.count = Counter()  # open elements by tag

    def close_from(self, place: int) -> None:
        self.count.subtract(n.tag for n in self.open[place:])
        del self.open[place:]

    def end_head(self) -> None:
        """Close an open head, with what is open in it, unless a title, script, style or template is still open there."""
        if not self.count["head"]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in HELD:
                return
            if self.open[k].tag == "head":
                self.close_from(k)
                return

    def foreign(self) -> int:
        """Place of the open svg or math element that the next tag is in; 0 if it is in none."""
        if not any(self.count[t] for t in FOREIGN):
            return 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in FOREIGN:
                return k
            if self.open[k].tag in FOREIGN_TEXT:
                return 0
        return 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK and (k := self.foreign()):
            self.close_from(k)
        if tag not in IN_HEAD:
            self.end_head()
        closed, border = CLOSES.get(tag, ((), ()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in border or not any(self.count[t] for t in closed):
                break
            if self.open[k].tag in closed:
                self.close_from(k)
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and (tag in FOREIGN or any(self.count[t] for t in FOREIGN)):
            self.close_from(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1 if self.count[tag] else 0, 0, -1):
            if self.open[k].tag == tag:
                self.close_from(k)
                return
            if self.open[k].tag in CELLS and tag not in ("table", "tr", *ROWS):
                break  # an end tag does not reach out of a cell
        if tag == "p":  # an end tag without a paragraph is an empty one
            self.open[-1].children.append(Node("p", {}))

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self.end_head()
        self.open[-1].children.append(data)


class Layout:
    """Lines of text with pending space: at most one blank, line break or blank line between two pieces."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space = [], "", 0, False

    def text(self, data: str) -> None:
        shown = GAPS.sub(" ", data)
        if shown[:1] == " " and self.line:
            self.space = True
        core = shown.strip(" ")
        if core:
            self.flush()
            self.line += (" " if self.space else "") + core
            self.space = shown[-1] == " "

    def flush(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def end_line(self, gap: int = 1) -> None:
        if self.line:
            self.lines.append(self.line)
            self.line = ""
        self.space = False
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str], gap: int) -> None:
        """Lines that are kept as they are."""
        self.end_line(gap)
        if lines:
            self.flush()
            self.lines += lines
            self.gap = gap


def render(node: Node) -> list[str]:
    """Lines of the visible text below a node."""
    out = Layout()
    fill(node, out)
    out.end_line()
    return out.lines


def fill(node: Node, out: Layout) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif child.tag == "br":
            if out.line or out.gap:
                out.end_line()
            else:
                out.lines.append("")
        elif child.tag == "table":
            out.whole(table_lines(child), 2)
        elif child.tag in ("ul", "ol", "menu"):
            out.whole(list_lines(child), 1 if node.tag == "li" else 2)
        elif child.tag == "pre":
            out.whole([x.rstrip() for x in raw(child).strip("\n").split("\n")], 2)
        elif child.tag == "dd":
            out.whole(["    " + x if x else x for x in render(child)], 1)
        elif child.tag in BLOCK:
            out.end_line(2 if child.tag in SPACED else 1)
            fill(child, out)
            out.end_line(2 if child.tag in SPACED else 1)
        else:
            fill(child, out)


def raw(node: Node) -> str:
    """Text of a preformatted element with its blanks."""
    parts = []
    for c in node.children:
        parts.append(c if isinstance(c, str) else "\n" if c.tag == "br" else raw(c))
    return "".join(parts)


def list_lines(node: Node) -> list[str]:
    """Items with their mark; further lines are set in below the text."""
    lines, step = [], 1
    start = node.number("start")
    if node.tag == "ol" and "reversed" in node.attributes:
        step = -1
        start = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if start is None else start
    number = (1 if start is None or node.tag != "ol" else start) - step
    loose = Node("div", {})
    for child in [*node.children, None]:
        if child is None or isinstance(child, Node) and child.tag == "li":
            lines += render(loose)  # text outside the items
            loose = Node("div", {})
            if child is None:
                break
            value = child.number("value")
            number = number + step if value is None else value
            mark = f"{number}. " if node.tag == "ol" else "- "
            inner = render(child)
            lines += [(mark if k == 0 else " " * len(mark) * bool(x)) + x for k, x in enumerate(inner)]
        else:
            loose.children.append(child)
    return lines


def table_rows(node: Node, group: Node) -> Iterator[tuple[Node, Node]]:
    """Rows of a table with the row group they are in and, as rows of their own, captions and whatever stands between them."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip(" \t\n\r\f"):
                stray = Node("caption", {})
                stray.children.append(child)
                yield stray, group
        elif child.tag in ROWS:
            yield from table_rows(child, child)
        else:
            yield child, group


def boxed(child: Node | str) -> list[str]:
    box = Node("div", {})
    box.children.append(child)
    return render(box)


def row_cells(row: Node) -> Iterator[tuple[list[str], int, int]]:
    """Lines, columns and rows (0: to the end of the row group) of each cell; text between cells is a cell of its own."""
    for c in row.children:
        if isinstance(c, Node) and c.tag in CELLS:
            columns, rows = c.number("colspan"), c.number("rowspan")
            columns = min(columns, MOST_COLUMNS) if columns and columns > 0 else 1
            yield render(c), columns, min(rows, MOST_ROWS) if rows is not None and rows >= 0 else 1
        elif not isinstance(c, str) or c.strip(" \t\n\r\f"):
            yield boxed(c), 1, 1


def table_grid(node: Node) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of placed cells: first column, the column after the last, and lines. A row without cells' text is left out."""
    grid = []
    held: list[tuple[int, int, int]] = []  # first column, column after, rows still to come; of the cells from rows above
    last = None
    for row, group in table_rows(node, node):
        if row.tag != "tr":
            lines = boxed(row)
            if lines:
                grid.append([(0, 0, lines)])
            continue
        if group is not last:
            held, last = [], group
        placed, at, taken = [], 0, 0
        below = [(a, b, n - 1) for a, b, n in held if n > 1]
        for lines, columns, rows in row_cells(row):
            while taken < len(held) and held[taken][0] < at + columns:
                at = max(at, held[taken][1])  # the first gap that is wide enough
                taken += 1
            placed.append((at, at + columns, lines))
            if rows != 1:
                below.append((at, at + columns, (rows or MOST_ROWS) - 1))
            at += columns
        held = sorted(below)
        if any(lines for *_, lines in placed):
            grid.append(placed)
    return grid


def table_lines(node: Node) -> list[str]:
    """Rows with cells aligned in columns two blanks apart; a cell may have several lines and span columns and rows."""
    grid = table_grid(node)
    widths: dict[int, int] = {}  # of the columns that a cell begins in
    for cells in grid:
        for first, after, lines in cells:
            if after:
                widths[first] = max(widths.get(first, 0), *map(len, lines), 0) if after - first == 1 else widths.get(first, 0)
    columns, offset, total = sorted(widths), {}, 0
    for column in columns:
        offset[column] = total
        total += widths[column] + 2
    out = []
    for cells in grid:
        for k in range(max(len(lines) for *_, lines in cells)):
            parts, length = [], 0
            for first, _, lines in cells:
                if k < len(lines) and lines[k]:
                    shift = max(offset.get(first, 0) - length, 2 if length else 0)
                    parts += [" " * shift, lines[k]]
                    length += shift + len(lines[k])
            out.append("".join(parts).rstrip())
    return out


def settle(node: Node, seen: bool = True) -> None:
    """Take out what is not displayed, and the text of invisible elements, whose boxes stay where they are."""
    summary = False
    kept = []
    for child in node.children:
        if isinstance(child, str):
            if seen and (node.tag != "details" or "open" in node.attributes):
                kept.append(child)
            continue
        if child.hidden() or (child.tag == "br" and not seen):
            continue
        if node.tag == "details" and "open" not in node.attributes:
            if summary or child.tag != "summary":
                continue
            summary = True
        visibility = VISIBILITY.findall(child.attributes.get("style") or "")
        settle(child, visibility[-1].lower() == "visible" if visibility else seen)
        kept.append(child)
    node.children = kept


def plain_markup(html: str) -> str:
    """The page with comments and declarations emptied, up to a tag, comment or script that nothing ends.

    As in browsers, what is left open holds the rest of the page. One pass: each
    tag is looked at once, and the first that does not end stops it.
    """
    parts, begin, at = [], 0, 0
    while found := OPENING.search(html, at):
        here = found.start()
        if html[here + 1] in "!?":
            if html.startswith(("<!-->", "<!--->"), here):
                end = html.index(">", here) + 1
            elif html.startswith("<!--", here):
                closing = COMMENT_END.search(html, here + 4)
                end = closing.end() if closing else 0
            else:
                end = html.find(">", here) + 1
            parts += [html[begin:here], "<!---->"]
            begin = at = end
        else:
            tag = TAG.match(html, here)
            end = at = tag.end() if tag else 0
            raw_text = RAW_TEXT.match(html, here)
            if tag and raw_text:
                closing = RAW_ENDS[raw_text[1].lower()].search(html, end)
                parts.append(html[begin:end])
                begin = end = at = closing.start() if closing else 0
            elif not tag:
                parts.append(html[begin:here])
        if not end:
            return "".join(parts)
    return "".join([*parts, html[begin:]])


def visible_text(html: str | None) -> str:
    """Text of one page; empty for null."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(plain_markup(html))
    builder.close()
    settle(builder.root)
    return "\n".join(render(builder.root)).strip("\n")


def extract_pages(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, text, n_chars`` of every page: all visible text with its layout.

    Paragraphs, headings, lists and tables stand between blank lines, other
    blocks on lines of their own; list items have marks; table cells are
    aligned. Scripts, styles, templates, the head and hidden elements are left
    out. Pages are parsed in place, without a shuffle.

    An element that is hidden, a closed dialog or all but the summary of closed
    details is left out; invisible elements keep their box and lose their text.
    A tag, comment or script that nothing ends holds the rest of the page.

    A null or empty page has an empty text. Text without any tag is its own
    visible text. Elements nested over 256 deep become siblings. Null and
    repeated keys keep a row per input row; an empty table gives no row; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    plain = df.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    shown = plain.mapInArrow(run, f"key {kind}, text string")
    return shown.select(F.col("key").alias(key), "text", F.char_length("text").cast("long").alias("n_chars"))
