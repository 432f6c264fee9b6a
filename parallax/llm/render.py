"""Visible text of HTML pages with their layout.

A tree builder reads tags one by one, supplies the end tags that HTML lets pages leave out, and ignores end tags
without a start. A renderer then walks the tree: what isn't displayed is skipped, blocks are set apart by line breaks or
blank lines, list items get markers and indentation, and the cells of a table stand below each other at common places,
over spans of rows and columns.

Visible are text, form fields' own text, options, texts of pictures (alt), of SVG and of MathML. Not displayed are the
elements in ``UNSEEN``, closed dialogs, the inside of closed details but for the summary, and what ``hidden`` or the
style attribute takes out, or a page's own style sheets by element, class or id; ``visibility`` is inherited and can be set back
further down. Of sheets, rules for printing and selectors of other kinds are left out; the more exact selector counts, then
the later rule, the style attribute above all but what is marked important.

Defined results: a null page has null text, an empty one empty text; unclosed markup is text up to its end; of repeated
attributes the first counts; numbers that aren't plain digits count as absent, and spans above HTML's bounds as these. No depth of nesting ends in an error or
changes what is shown: indentation grows to ``INDENT`` levels, tables nested deeper than ``TABLES`` have a line for each
row without common places, and so have tables wider than ``LINE`` characters; cells wider than ``WIDE`` don't widen their
columns. Blank lines inside a cell stay; rows without text have no line. Repeated ids are rendered row by row; an empty table gives no rows; other columns are kept, but for one with the
name of the result, which the result replaces.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

INDENT, TABLES, WIDE, LINE = 40, 12, 200, 2000
#: Spans above these count as these, as in browsers.
COLUMNS, ROWS = 1000, 65534

# Element names of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template title noscript iframe object audio video canvas datalist noembed noframes meta link area"
    " base param source track rp desc defs metadata symbol clippath annotation annotation-xml".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " select summary table ul caption tbody textarea thead tfoot tr xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp dl ol ul menu dir figure table hr".split())
LISTS = frozenset("ul ol menu dir".split())
SILENT_INPUTS = frozenset("hidden password checkbox radio file image range color".split())

# Start tag -> open elements that it ends, and where the search for them stops.
_P_ENDERS = BLOCK - frozenset("html body li dd dt caption tbody thead tfoot tr option optgroup select textarea legend".split())
_SCOPE = frozenset("table td th caption button object html".split())
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), LISTS | _SCOPE),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"}) | _SCOPE),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"}) | _SCOPE),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "body": (frozenset({"head"}), frozenset()),
}

#: Start tag -> what it ends everything down to, in the innermost table.
DOWN_TO = {t: frozenset({"table"}) for t in ("tbody", "thead", "tfoot", "caption", "colgroup")} | {"tr": frozenset("table tbody thead tfoot".split())}

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^A-Za-z>][^>]*(?:>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}
_NUMBER = re.compile(r"\s*([+-]?)0*([0-9]+)", re.A)
_COMMENT, _RULE, _MEDIA = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"([^{}]*)\{([^{}]*)\}"), re.compile(r"@media([^{}]*)\{", re.I)
_SELECTOR = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BODY_LIKE = frozenset("html head body".split())
_CELLS = frozenset("td th tr tbody thead tfoot caption".split())


class Node:
    __slots__ = ("name", "attributes", "children", "sheet")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []
        self.sheet: dict[str, tuple[str, bool]] = {}

    def number(self, name: str, default: int, low: int, high: int) -> int:
        m = _NUMBER.match(self.attributes.get(name) or "")
        if not m:
            return default
        size = int(m[2]) if len(m[2]) < 19 else 10**18
        return min(max(-size if m[1] == "-" else size, low), high)


class _Open:
    """The open elements, with the places of each name."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.stack))
        self.stack.append(node)

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            self.places[self.stack.pop().name].pop()

    def last(self, names: frozenset[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names: frozenset[str], stop: frozenset[str]) -> None:
        """End the innermost of the named elements and all in it, unless an element of ``stop`` lies between."""
        at = self.last(names)
        if at and at >= self.last(stop):
            self.pop(at)


def _for_screens(sheet: str) -> str:
    """A sheet without comments, and without what is for other media."""
    sheet = _COMMENT.sub(" ", sheet)
    out, at = [], 0
    while m := _MEDIA.search(sheet, at):
        out.append(sheet[at : m.start()])
        depth, end = 1, m.end()
        while depth and end < len(sheet):
            depth += (sheet[end] == "{") - (sheet[end] == "}")
            end += 1
        if m[1].strip().lower() in ("", "all", "screen"):
            out.append(sheet[m.end() : end - 1])
        at = end
    return "".join(out) + sheet[at:]


def _rules(sheets: list[str]) -> dict[str, list[tuple]]:
    """What the sheets say of display and visibility: rules by an id, class or name that their elements have."""
    out: dict[str, list[tuple]] = defaultdict(list)
    for k, (selectors, body) in enumerate(m.groups() for s in sheets for m in _RULE.finditer(_for_screens(s))):
        told = {}
        for part in body.lower().split(";"):
            name, _, value = part.partition(":")
            if name.strip() in ("display", "visibility"):
                value, important, _ = value.partition("!important")
                told[name.strip()] = (value.strip(), bool(important))
        for selector in selectors.split(",") if told else ():
            m = _SELECTOR.match(selector.strip())
            if m and (m[1] or m[2]):
                marks = re.findall(r"[.#][\w-]+", m[2])
                tag = (m[1] or "*").lower()
                exact = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), tag != "*", k)
                key = max(marks, key=lambda x: x[0] == "#") if marks else tag
                out[key].append((exact, tag, frozenset(marks), told))
    return out


def _style(root: Node, sheets: list[str]) -> None:
    """Put on each element what the sheets say of it."""
    rules = _rules(sheets)
    todo = [root] if rules else []
    while todo:
        node = todo.pop()
        todo += [c for c in node.children if isinstance(c, Node)]
        marks = {f".{c}" for c in (node.attributes.get("class") or "").split()}
        if node.attributes.get("id"):
            marks.add("#" + node.attributes["id"])
        found = [r for key in (*marks, node.name, "*") for r in rules.get(key, ()) if r[1] in ("*", node.name) and r[2] <= marks]
        for _, _, _, told in sorted(found, key=lambda r: r[0]):
            for name, (value, important) in told.items():
                if important or not node.sheet.get(name, ("", False))[1]:
                    node.sheet[name] = value, important


def parse(page: str) -> Node:
    """The tree of a page; text is kept as strings between the elements."""
    root = Node("#root", {})
    up, at = _Open(root), 0
    sheets: list[str] = []
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if up.stack[-1].name == "head" and not text.isspace():
                up.pop(len(up.stack) - 1)
            up.stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                up.stack[-1].children.append(Node("br", {}))
            elif name == "p" and not up.places.get("p"):
                up.stack[-1].children.append(Node("p", {}))
            elif name in _BODY_LIKE:
                up.close(frozenset({name}), frozenset())
            else:
                up.close(frozenset({name}), frozenset({"table"}) - {name})
            continue
        attributes: dict[str, str] = {}
        for k, a, b, c in _ATTRIBUTE.findall(m[3]):
            attributes.setdefault(k.lower(), a or b or c)
        if name in ENDS:
            up.close(*ENDS[name])
        if name in DOWN_TO and up.places.get("table"):
            up.pop(up.last(DOWN_TO[name]) + 1)
        if name in _P_ENDERS:
            up.close(frozenset({"p"}), _SCOPE)
        if name not in UNSEEN and up.stack[-1].name == "head" and name != "head":
            up.pop(len(up.stack) - 1)
        node = Node(name, attributes)
        up.stack[-1].children.append(node)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            body = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            if name == "style" and (attributes.get("media") or "all").strip().lower() in ("all", "screen"):
                sheets.append(body)
            stop = page.find(">", end.start()) if end else -1
            at = len(page) if stop < 0 else stop + 1
        elif name not in VOID:
            up.push(node)
    if sheets:
        _style(root, sheets)
    return root


def shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether an element is displayed, and whether its text is visible where its parent's is ``visible``."""
    a, sheet = node.attributes, node.sheet
    display, told = sheet.get("display", (None,))[0], sheet.get("visibility", ("",))[0]
    if told in ("hidden", "collapse", "visible"):
        visible = told == "visible"
    for part in html.unescape(a.get("style") or "").lower().split(";"):
        name, _, value = part.partition(":")
        name, important = name.strip(), "!important" in value
        value = value.replace("!important", "").strip()
        if not important and sheet.get(name, ("", False))[1]:
            continue
        if name == "display":
            display = value
        elif name == "visibility" and value in ("hidden", "collapse", "visible"):
            visible = value == "visible"
        elif name == "content-visibility" and value == "hidden":
            display = "none"
    gone = node.name in UNSEEN or display == "none" or (node.name == "dialog" and "open" not in a and not display)
    return not gone and not ("hidden" in a and not display), visible


def inside(node: Node) -> list:
    """The children that are laid out."""
    if node.name == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    first = node.children[0] if node.children else None
    if node.name in ("pre", "textarea") and isinstance(first, str) and first.startswith("\n"):
        return [first[1:], *node.children[1:]]
    return node.children


class _Lines:
    """Text laid out line by line, with collapsed white space and pending breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent = 0
        self.mark = ""
        self.gap = 0
        self.space = False

    def text(self, text: str, verbatim: bool) -> None:
        if verbatim:
            for k, line in enumerate(text.split("\n")):
                if k:
                    self.line()
                if line:
                    self.now.append(line)
            return
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words.endswith(" ")
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(words[:-1] if tail else words)
        self.space = tail

    def line(self) -> None:
        """End the line, empty or not."""
        self._put("".join(self.now))

    def block(self, gap: int) -> None:
        """End the line if it has text; what follows stands ``gap`` blank lines below, at least."""
        if self.now:
            self._put("".join(self.now))
        self.gap = max(self.gap, gap)
        self.space = False

    def _put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines += [""] * (self.gap - (self.lines[-1] == ""))
        self.gap = 0
        self.lines.append((self.mark or "  " * min(self.indent, INDENT)) + line if line or self.mark else "")
        self.mark = ""
        self.now, self.space = [], False

    def done(self) -> str:
        if self.now:
            self._put("".join(self.now))
        return "\n".join(self.lines).strip("\n")


def _around_cells(row: Node) -> set[int]:
    """Which elements below a row have cells below them; tables in it are left out."""
    above: dict[int, Node] = {}
    out: set[int] = set()
    todo = [row]
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, str) or c.name == "table":
                continue
            if c.name in ("td", "th"):
                up = n
                while up is not row and id(up) not in out:
                    out.add(id(up))
                    up = above[id(up)]
            else:
                above[id(c)] = n
                todo.append(c)
    return out


class _Grid:
    """Cells by row and column, with what earlier rows' spans take."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}

    def row(self) -> None:
        self.taken = {k: n - 1 for k, n in self.taken.items() if n > 1}
        self.rows.append([])
        self.at = 0

    def cell(self, text: str, across: int, down: int) -> None:
        while self.at in self.taken:
            self.at += 1
        self.rows[-1].append((self.at, across, text.split("\n")))
        if down > 1:
            self.taken |= {k: down for k in range(self.at, self.at + across)}
        self.at += across

    def text(self, aligned: bool) -> list[str]:
        widths: dict[int, int] = defaultdict(int)
        for k, across, lines in (c for row in self.rows for c in row):
            width = max(map(len, lines))
            if across == 1 and width <= WIDE:
                widths[k] = max(widths[k], width)
        # Cells over several columns widen the last of them, the narrower spans first.
        for k, across, lines in sorted((c for row in self.rows for c in row if c[1] > 1), key=lambda c: c[:2][::-1]):
            width, last = max(map(len, lines)), k + across - 1
            room = sum(widths[j] + 2 for j in range(k, last + 1) if widths.get(j)) - 2
            if room < width <= WIDE:
                widths[last] += width - room if widths.get(last) else max(1, width - room - 2)
        places, at = {}, 0
        for k in range(1 + max((c[0] + c[1] - 1 for row in self.rows for c in row), default=-1)):
            places[k] = at
            at += widths[k] + 2 if widths.get(k) else 0
        aligned = aligned and at <= LINE
        out = []
        for row in (r for r in self.rows if any(any(c[2]) for c in r)):
            for i in range(max(len(c[2]) for c in row)):
                line = ""
                for k, _, lines in row:
                    if i < len(lines) and lines[i]:
                        line += "  " if line else ""
                        line = (line.ljust(places[k]) if aligned else line) + lines[i]
                out.append(line)
        return out


def _table(node: Node, visible: bool, nested: int) -> list[str]:
    """Lines of a table. What stands outside of cells and caption goes before the table."""
    grid, caption, moved = _Grid(), [], []
    todo: list[tuple] = [(node, visible)]
    while todo:
        n, vis = todo.pop()
        if isinstance(n, str):
            moved.append((n, vis))
            continue
        if n is not node:
            displayed, vis = shown(n, vis)
            if not displayed:
                continue
        if n.name == "tr":
            grid.row()
            around = _around_cells(n)
            inner = [(c, vis) for c in reversed(n.children)]
            while inner:
                cell, v = inner.pop()
                if isinstance(cell, str):
                    moved.append((cell, v))
                    continue
                if cell.name not in ("td", "th") and id(cell) not in around:
                    moved.append((cell, v))
                    continue
                displayed, v = shown(cell, v)
                if not displayed:
                    continue
                if id(cell) in around:
                    inner += [(c, v) for c in reversed(cell.children)]
                else:
                    down = cell.number("rowspan", 1, 0, ROWS) or ROWS
                    grid.cell(_walk([(cell, v)], nested, of_cell=True), cell.number("colspan", 1, 1, COLUMNS), down)
        elif n.name == "caption":
            caption += _split(_walk([(c, vis) for c in n.children], nested))
        elif n is node or n.name in ("tbody", "thead", "tfoot"):
            loose = [c for c in n.children if isinstance(c, Node) and c.name in ("td", "th")]
            if loose:
                row_node = Node("tr", {})
                row_node.children = loose
                todo.append((row_node, vis))
            todo += [(c, vis) for c in reversed(n.children) if isinstance(c, str) or c.name not in ("td", "th")]
            if n is not node:
                grid.taken = {}  # spans end with their part of the table
        else:
            moved.append((n, vis))
    return [*_split(_walk(moved, nested)), *caption, *grid.text(nested <= TABLES)]


def _split(text: str) -> list[str]:
    return text.split("\n") if text else []


def _walk(nodes: list[tuple[Node | str, bool]], nested: int = 0, of_cell: bool = False) -> str:
    """Text of elements, each with its parent's visibility; with ``of_cell``, of what is below one whose own is given."""
    out = _Lines()
    if of_cell:
        nodes = [(c, nodes[0][1]) for c in inside(nodes[0][0])]
    # (node, visible, leaving?, preformatted?, list state or None)
    todo: list[tuple] = [(n, v, False, False, None) for n, v in reversed(nodes)]
    depth = 0
    while todo:
        node, visible, leaving, pre, state = todo.pop()
        if isinstance(node, str):
            if visible:
                out.text(node, pre)
            continue
        name = node.name
        if leaving:
            if name in LISTS:
                depth -= 1
                out.indent -= 1
            if name in ("blockquote", "dd"):
                out.indent -= 1
            if name == "li":
                if out.mark and not out.now:
                    out.mark = ""
                out.block(0)
            else:
                out.block(1 if name in SPACED and not (name in LISTS and depth) else 0)
            continue
        displayed, visible = shown(node, visible)
        if not displayed:
            continue
        if name == "br":
            out.line()
            continue
        if name == "hr":
            out.block(1)
            continue
        if name in ("img", "input", "optgroup"):
            text = node.attributes.get({"img": "alt", "input": "value", "optgroup": "label"}[name])
            if name == "optgroup":
                out.block(0)
            if text and visible and not (name == "input" and (node.attributes.get("type") or "").lower() in SILENT_INPUTS):
                out.text(html.unescape(text), False)
            if name != "optgroup":
                continue
        if name == "table" and nested < 4 * TABLES:
            out.block(1)
            for line in _table(node, visible, nested + 1):
                if line:
                    out.now.append(line)
                out.line()
            out.block(1)
            continue
        if name in BLOCK:
            out.block(1 if name in SPACED and not (name in LISTS and depth) else 0)
            todo.append((node, visible, True, pre, state))
        elif name in ("td", "th"):
            out.space = True
        children = inside(node)
        if name in LISTS:
            depth += 1
            out.indent += 1
            down = name == "ol" and "reversed" in node.attributes
            first = sum(isinstance(c, Node) and c.name == "li" for c in children) if down else 1
            state = [node.number("start", first, -(10**18), 10**18), name == "ol", -1 if down else 1]
        elif name == "li":
            marker = "- "
            if state:
                state[0] = node.number("value", state[0], -(10**18), 10**18)
                marker = f"{state[0]}. " if state[1] else marker
                state[0] += state[2]
            out.mark = "  " * min(max(0, out.indent - 1), INDENT) + marker if visible else ""
        elif name in ("blockquote", "dd"):
            out.indent += 1
        todo += [(c, visible, False, pre or name in ("pre", "textarea", "xmp"), state) for c in reversed(children)]
    return out.done()


def render(page: str | None) -> str | None:
    return None if page is None else _walk([(c, True) for c in parse(page).children])


def visible_text(pages: DataFrame, column: str = "html", name: str = "visible_text") -> DataFrame:
    """The rows of ``pages`` with the text that a reader sees."""
    return add_columns(pages, column, {name: T.StringType()}, lambda: lambda batch: [[render(p) for p in batch.to_pylist()]])
