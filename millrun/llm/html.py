"""Text of web pages as they are laid out: a tree builder and a renderer.

The builder closes what HTML closes by itself (paragraphs before blocks, list items,
table cells and rows, the head before content) and reads scripts, styles and titles as
raw text. The renderer emits all visible text: paragraphs and headings with a blank line
around them, other blocks on lines of their own, list items with markers and indents,
tables with aligned columns, preformatted text as it is. Not visible are the head,
scripts, styles, templates, comments, elements with ``hidden`` or an inline style of
``display:none``, dialogs that aren't open, and all of closed details but their summary.
An inline ``visibility`` of hidden or collapse hides the texts below it, up to elements
that are ``visible`` again. Cells that span rows keep their columns in the rows below, up to
the end of their row group.

Defined cases: a null or empty page gives an empty text; a page without tags is its text;
a tag that never ends is text; elements nest to any depth; text that stands in a table
but in no cell comes before its rows; of an attribute given twice the first counts, of a
declaration the last; ids may be null and repeat: each row is rendered; other columns have
any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.arrow import byte_values, slices

# Element names by how they are read or laid out.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp".split())
IN_HEAD = set("title meta link style script base noscript template".split())
HIDDEN = set("head script style template noscript iframe title datalist".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr".split())
BLOCKS = SPACED | set("html body div section article aside nav header footer main address form dialog "
                      "li dt dd tr td th thead tbody tfoot caption figcaption details summary "
                      "center legend option optgroup textarea".split())
ENDS_P = BLOCKS - set("html body tr td th thead tbody tfoot caption option optgroup".split())
# An element of the first kind ends open elements of the second, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(
    r"([^\s/=>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_MAYBE_UNSEEN = re.compile(r"hidden|style", re.I)
# Parts of a style whose colons and semicolons don't make declarations.
_OPAQUE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*+\"|'[^']*+'|\([^)]*+\)", re.S)
_NUMBER = re.compile(r"\s*(\d{1,9})")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class _Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def _limits(tag: str) -> set:
    """What an end tag doesn't reach across: inline ones blocks, others cells or tables."""
    if tag not in BLOCKS:
        return BLOCKS
    if tag in ("tr", "td", "th", "thead", "tbody", "tfoot"):
        return {"table"}
    return set() if tag == "table" else {"td", "th", "caption"}


def _attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape("".join(values)))
    return out


def _number(node: _Node, name: str) -> int | None:
    """An attribute's whole number."""
    found = _NUMBER.match(_attributes(node.attributes).get(name, "")) if node.attributes else None
    return int(found[1]) if found else None


def _declared(style: str) -> dict[str, str]:
    """The values that count of a style's properties."""
    out: dict[str, str] = {}
    important: set[str] = set()
    for declaration in _OPAQUE.sub(" ", style).lower().split(";"):
        name, _, value = map(str.strip, declaration.partition(":"))
        value, mark, _ = value.partition("!")
        if mark or name not in important:
            out[name] = value.strip()
        if mark:
            important.add(name)
    return out


def parse(page: str) -> _Node:
    """The page's tree; texts are strings among the children."""
    root = _Node("#root")
    stack = [root]
    places: dict = defaultdict(list)  # of the open elements in the stack, by tag
    blocks: list[int] = []  # of those in BLOCKS

    def push(node: _Node) -> None:
        places[node.tag].append(len(stack))
        if node.tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(node)

    def pop_from(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
            if node.tag in BLOCKS:
                blocks.pop()
        del stack[i:]

    def leave_head() -> None:
        if stack[-1].tag == "head":
            pop_from(len(stack) - 1)

    def add_text(raw: str) -> None:
        if raw.strip():
            leave_head()
        stack[-1].children.append(unescape(raw))

    def last(tags: set) -> int:
        if tags is BLOCKS:
            return blocks[-1] if blocks else 0
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set, limits: set) -> None:
        i = last(tags)
        if i and i >= last(limits):
            pop_from(i)

    at = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            add_text(page[at:m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(_Node("br"))
            else:
                close({tag}, _limits(tag))
        elif m[2]:
            tag, attributes = m[2].lower(), m[3] or ""
            if tag not in IN_HEAD:
                leave_head()
            if tag in ENDS_P:
                close({"p"}, {"td", "th", "table", "li", "button"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node = _Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                stop = end.start() if end else len(page)
                if tag not in HIDDEN:
                    node.children.append(unescape(page[at:stop]))
                at = end.end() if end else len(page)
            elif tag not in VOID and not attributes.endswith("/"):
                push(node)
    if at < len(page):
        add_text(page[at:])
    return root


def _displayed(node: _Node) -> tuple[bool, str]:
    """Whether the element has a box, and its own ``visibility`` (or an empty string)."""
    if node.tag in HIDDEN:
        return False, ""
    if node.tag == "dialog" and "open" not in _attributes(node.attributes):
        return False, ""
    if not node.attributes or not _MAYBE_UNSEEN.search(node.attributes):
        return True, ""
    attributes = _attributes(node.attributes)
    style = _declared(attributes.get("style", ""))
    return ("hidden" not in attributes and style.get("display") != "none",
            style.get("visibility", ""))


def _prune(root: _Node) -> _Node:
    """The tree without what isn't seen; hidden items lose their marker."""
    open_ = [(root, True)]
    while open_:
        node, seen = open_.pop()
        closed = node.tag == "details" and "open" not in _attributes(node.attributes)
        kept: list = []
        for child in node.children:
            if isinstance(child, str):
                if seen and not closed:
                    kept.append(child)
                continue
            if closed and (child.tag != "summary" or kept):
                continue
            displayed, visibility = _displayed(child)
            if not displayed:
                continue
            shown = {"hidden": False, "collapse": False, "visible": True,
                     "initial": True}.get(visibility, seen)
            if not shown and child.tag == "hr":
                continue
            if not shown and child.tag == "li":
                child.tag = "div"
            kept.append(child)
            open_.append((child, shown))
        node.children = kept
    return root


def _parts(node: _Node):
    """Texts, line breaks and blocks below a node, inline elements opened up."""
    open_ = [iter(node.children)]
    while open_:
        for child in open_[-1]:
            if isinstance(child, str) or child.tag == "br":
                yield child
            elif child.tag in BLOCKS:
                yield child
            else:
                open_.append(iter(child.children))
                break
        else:
            open_.pop()


# The functions that lay out a node append its lines to ``out`` and yield the layouts of
# nodes below it, which :func:`_run` runs before it goes on; so depth needs no call stack.


def _run(layout) -> None:
    stack = [layout]
    while stack:
        below = next(stack[-1], None)
        if below is None:
            stack.pop()
        else:
            stack.append(below)


def _lines(node: _Node, out: list[str]):
    """The node's content; an empty string is a blank line between blocks."""
    first = len(out)
    inline: list[str] = []
    number, step = 1, 1
    if node.tag == "ol":
        if "reversed" in _attributes(node.attributes):
            number, step = sum(getattr(c, "tag", "") == "li" for c in node.children), -1
        start = _number(node, "start")
        number = number if start is None else start

    def flush() -> None:
        if inline:
            text = "".join(inline)
            inline.clear()
            lines = [_SPACE.sub(" ", x).strip(" ") for x in text.split("\0")]
            out.extend(x for x in lines if x)

    for part in _parts(node):
        if isinstance(part, str):
            inline.append(part.replace("\0", "�"))
        elif part.tag == "br":
            inline.append("\0")
        else:
            flush()
            nested = part.tag in ("ul", "ol") and node.tag in ("li", "ul", "ol")
            gap = part.tag in SPACED and not nested
            blank = gap and len(out) > first and bool(out[-1])
            if blank:
                out.append("")
            at = len(out)
            if part.tag == "li":
                value = _number(part, "value") if node.tag == "ol" else None
                number = number if value is None else value
                marker = f"{number}. " if node.tag == "ol" else "- "
                number += step
                lines: list[str] = []
                yield _lines(part, lines)
                out.extend((marker if i == 0 else " " * len(marker) if x else "") + x
                           for i, x in enumerate(lines or [""]))
            else:
                yield _block(part, out)
            if len(out) == at:
                if blank:
                    out.pop()
            elif gap:
                out.append("")
    flush()
    while len(out) > first and not out[-1]:
        out.pop()


def _block(node: _Node, out: list[str]):
    if node.tag == "table":
        yield _table(node, out)
    elif node.tag == "hr":
        out.append("---")
    elif node.tag in ("pre", "textarea"):
        plain = _plain(node)
        if plain.strip():
            out.extend(plain.strip("\n").split("\n"))
    elif node.tag in ("blockquote", "dd"):
        lines: list[str] = []
        yield _lines(node, lines)
        out.extend("  " + x if x else x for x in lines)
    else:
        yield _lines(node, out)


def _plain(node: _Node) -> str:
    out: list[str] = []
    open_ = [iter(node.children)]
    while open_:
        for child in open_[-1]:
            if isinstance(child, str):
                out.append(child)
            elif child.tag == "br":
                out.append("\n")
            else:
                open_.append(iter(child.children))
                break
        else:
            open_.pop()
    return "".join(out)


def _rows(node: _Node):
    """Captions and rows of a table, not those of tables inside it, and what stands between
    them; a node ``#end`` after each row group."""
    stray = _Node("#stray")
    open_ = [iter(node.children)]
    while open_:
        for child in open_[-1]:
            tag = None if isinstance(child, str) else child.tag
            if tag not in ("tr", "caption", "thead", "tbody", "tfoot", "colgroup"):
                stray.children.append(child)
                continue
            if stray.children:
                yield stray
                stray = _Node("#stray")
            if tag in ("tr", "caption"):
                yield child
            else:
                open_.append(iter(child.children))
                break
        else:
            open_.pop()
            if open_:
                yield _Node("#end")
    yield stray


def _spanned(below: dict[int, int], column: int) -> bool:
    """Whether a cell of a row above stands in ``column``; counts that row down."""
    if column not in below:
        return False
    below[column] -= 1
    if not below[column]:
        del below[column]
    return True


def _table(node: _Node, out: list[str]):
    """Rows on lines of their own, cells of a column from the same place on."""
    grid = []
    below: dict[int, int] = {}  # rows that a cell above still takes, by column
    for row in _rows(node):
        if row.tag == "#end":
            below = {}
            continue
        if row.tag != "tr":
            lines: list[str] = []
            yield _lines(row, lines)
            out.extend(x for x in lines if x)
            continue
        cells: list[list[str]] = []
        spans: dict[int, int] = {}
        for cell in _parts(row):
            if isinstance(cell, str):
                if cell.strip():
                    out.append(_SPACE.sub(" ", cell).strip(" "))
                continue
            if cell.tag == "br":
                continue
            while _spanned(below, len(cells)):
                cells.append([])
            lines = []
            yield _block(cell, lines)
            wide = min(_number(cell, "colspan") or 1, 1000)
            high = _number(cell, "rowspan")
            high = 1 if high is None else min(high, 65534) or 65534  # 0: to the group's end
            for k in range(wide):
                if high > 1:
                    spans[len(cells)] = high - 1
                cells.append([x for x in lines if x] if k == 0 else [])
        for column in [c for c in below if c >= len(cells)]:
            _spanned(below, column)
        below |= spans
        if any(cells):
            grid.append(cells)
    widths = [max((len(x) for row in grid if c < len(row) for x in row[c]), default=0)
              for c in range(max(map(len, grid), default=0))]
    for row in grid:
        for k in range(max(map(len, row))):
            line = "  ".join((cell[k] if k < len(cell) else "").ljust(width)
                             for cell, width in zip(row, widths))
            out.append(line.rstrip(" "))


def render(page: str) -> str:
    """All visible text of a page."""
    out: list[str] = []
    _run(_lines(_prune(parse(page)), out))
    return "\n".join(out)


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars, n_lines) for every page."""
    src = df.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"),
                 pa.array([render((h or b"").decode("utf-8", "replace"))
                           for h in byte_values(batch.column("html"))], pa.string())],
                ["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").select(
        F.col("id").alias(id_col), "text", F.length("text").cast("bigint").alias("n_chars"),
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
        .cast("bigint").alias("n_lines"))
