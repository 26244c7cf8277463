"""Layout-aware HTML rendering: a tree with implied tags, visibility rules, blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import bounded_batches, pieces

#: The HTML standard's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist annotation annotation-xml desc defs metadata symbol".split())
#: Elements of a drawing whose own text is not shown.
DRAWN = frozenset("svg g switch".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table textarea ul caption tr".split()
)
#: Blocks that keep a blank line before and after them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr article section".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul dd dt li".split()
)
#: A start tag ends open elements of the first set, up to the nearest of the second.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "thead": (frozenset("tr td th thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("tr td th thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tr td th thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
SCOPE = frozenset("td th caption table html template button".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_SIMPLE = re.compile(r"([a-z][a-z0-9-]*|\*)?(#[\w-]+)?((?:\.[\w-]+)*)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
#: A column is padded to its widest cell, but no wider than this; longer cells stay whole.
WIDEST = 60
#: Levels of lists and quotes that indent a line; text of deeper ones stands at the last of them.
DEEPEST = 40
#: Tables within tables that are aligned; deeper ones are text, so that a page's text is padded so often at most.
NESTED = 3
#: Empty places that spans may make beside a table's cells, and characters of padding for those of its text; a table beyond either isn't aligned.
PLACES, PADDING = 4, 8

@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and texts


#: Ends a row that cells opened within a row group.
_END = Node("")


def parse(source: str) -> Node:
    """The element tree of a page, however broken: missing end tags are implied, stray ones skipped.

    The places of open elements are kept by tag, so that no end tag, implied or
    not, has to look through all that are open.
    """
    root = Node("html")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s))

    def close_to(index: int) -> None:
        for node in stack[index:]:
            places[node.tag].pop()
        del stack[index:]

    def last_open(tags: frozenset, fence: frozenset) -> int | None:
        innermost = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        k = innermost(tags)
        return k if k and k >= innermost(fence) else None

    while at < len(source):
        found = _TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            k = last_open(frozenset([tag]), frozenset() if tag in SCOPE else SCOPE - {"html"})
            if k is not None:
                close_to(k)
            continue
        if tag == "html" or tag == "body" and places.get("body"):
            continue
        if tag in CLOSES_P and (k := last_open(frozenset(["p"]), SCOPE)) is not None:
            close_to(k)
        if tag in IMPLIED_END:
            ends, fence = IMPLIED_END[tag]
            while (k := last_open(ends, fence)) is not None:
                close_to(k)
        elif stack[-1].tag == "head" and tag not in VOID | RAW | ESCAPABLE | {"noscript", "template"}:
            close_to(len(stack) - 1)
        attributes = {m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTRIBUTE.finditer(found[3])}
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            inner = re.sub(r"^\r?\n", "", inner) if tag == "textarea" else inner  # a first line end is not shown
            node.children.append(html.unescape(inner) if tag in ESCAPABLE else inner)
            at = end.end() if end else len(source)
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            at += tag in ("pre", "listing") and source.startswith("\n", at)  # a first line end is not shown
    apply_sheets(root)
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    display = _DISPLAY.findall(a.get("style", ""))
    return node.tag not in UNSEEN and "hidden" not in a and not (node.tag == "dialog" and "open" not in a) and not (display and display[-1].lower() == "none") and not (node.tag == "input" and a.get("type") == "hidden")


def veiled(node: Node, within: bool) -> bool:
    """Whether a node's own text is hidden: by its visibility, else by that of what it lies ``within``."""
    found = _VISIBILITY.findall(node.attributes.get("style", ""))
    return within if not found or found[-1].lower() == "inherit" else found[-1].lower() in ("hidden", "collapse")


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet's own rules; what stands in at-rules is left out."""
    css, at, depth, begin, skip = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S), 0, 0, 0, False
    head = ""
    for m in re.finditer(r"[{};]", css):
        if m[0] == "{":
            if not depth:
                head = css[begin : m.start()].strip()
                skip = head.startswith("@")
            depth, at = depth + 1, m.end() if not depth else at
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                if not skip:
                    yield head, css[at : m.start()]
                begin = m.end()
        elif m[0] == ";" and not depth:
            begin = m.end()  # an at-rule without a block


def apply_sheets(root: Node) -> None:
    """Adds to nodes' styles what the page's style sheets say of display and visibility, by selectors of one element: tag, #id, .class.

    The more specific selector wins, then the later one, and an element's own
    style over both. Selectors with combinators or conditions are left out.
    """
    nodes, todo, sheets = [], [root], []
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
        if node.tag == "style":
            sheets.append("".join(c for c in node.children if isinstance(c, str)))
    found: dict[str, list] = {}
    # nodes come last child first, and so do their sheets
    for order, (heads, body) in enumerate(rule for css in reversed(sheets) for rule in _rules(css)):
        said = [(name, v[-1]) for name, v in (("display", _DISPLAY.findall(body)), ("visibility", _VISIBILITY.findall(body))) if v]
        for head in heads.split(",") if said else ():
            m = _SIMPLE.fullmatch(head.strip())
            if m and m[0]:
                classes = [c for c in m[3].split(".") if c]
                key = m[2] or (f".{classes[0]}" if classes else (m[1] or "*").lower())
                found.setdefault(key, []).append(((bool(m[2]), len(classes), bool(m[1]) and m[1] != "*"), order, (m[1] or "*").lower(), m[2], frozenset(classes), said))
    for node in nodes if found else ():
        a = node.attributes
        classes = frozenset(a.get("class", "").split())
        keys = [node.tag, "*", f"#{a.get('id', '')}", *(f".{c}" for c in classes)]
        rules = sorted((r for k in keys for r in found.get(k, ()) if r[2] in ("*", node.tag) and r[3] in (None, f"#{a.get('id', '')}") and r[4] <= classes), key=lambda r: r[:2])
        if rules:
            a["style"] = ";".join([f"{n}:{v}" for r in rules for n, v in r[5]] + [a.get("style", "")])


class _Out:
    """Lines of a block's text; white space is collapsed, and blank lines never double."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.gap = False
        self.space = False
        self.prefix = ""
        self.depth = 0

    @property
    def indent(self) -> str:
        return "  " * min(self.depth, DEEPEST)

    def inline(self, s: str) -> None:
        parts = _BLANK.split(s)
        for k, part in enumerate(parts):
            if k:
                self.space = True
            if part:
                if self.space and self.current:
                    self.current.append(" ")
                self.current.append(part)
                self.space = False

    def exact(self, s: str) -> None:
        """Text whose white space stays."""
        first, *rest = s.split("\n")
        self.current += [first] * bool(first)
        for line in rest:
            if self.current:
                self.end_line()
            elif self.lines:
                self.lines.append("")
            self.current += [line] * bool(line)

    def end_line(self, gap: bool = False) -> None:
        if self.current:
            if self.gap and self.lines:
                self.lines.append("")
            indent = self.indent[2:] if self.prefix else self.indent  # a list's marker stands left of its text
            self.lines.append(f"{indent}{self.prefix}{''.join(self.current)}")
            self.current, self.gap, self.prefix = [], False, ""
        self.space = False
        self.gap |= gap

    def whole(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines += [self.indent + x for x in lines]
            self.gap = False


def _parts(table: Node, hidden: bool = False) -> Iterator[tuple[Node | str, bool]]:
    """What a table shows, in order, and whether it is hidden: rows, and whatever else lies in it or its row groups; cells outside a row open one."""
    implied, stack = None, [(c, hidden) for c in reversed(table.children)]
    while stack:
        node, veil = stack.pop()
        if isinstance(node, str):
            if node.strip():
                if implied:
                    yield implied
                    implied = None
                yield node, veil
            continue
        if not visible(node) or node.tag in ("colgroup", "col"):
            continue
        if node.tag in ("td", "th"):
            implied = implied or (Node("tr"), veil)
            implied[0].children.append(node)
            continue
        if implied:
            yield implied
            implied = None
        if node.tag in ("thead", "tbody", "tfoot"):
            stack += [(_END, veil), *((c, veiled(node, veil)) for c in reversed(node.children))]
        elif node.tag == "form":  # browsers take a form among rows as empty; its rows are the table's
            stack += [(c, veil) for c in reversed(node.children)]
        elif node is not _END:
            yield node, veil
    if implied:
        yield implied


def _cells(row: Node) -> list[Node | str]:
    return [c for c in row.children if (visible(c) if isinstance(c, Node) else c.strip())]


def _span(cell: Node | str, name: str, most: int) -> int:
    n = cell.attributes.get(name, "") if isinstance(cell, Node) else ""
    return min(int(n), most) if n.isdecimal() and len(n) < 9 else 1


def _is_layout(table: Node) -> bool:
    """Whether no row has two cells, so that there is nothing to align."""
    return all(isinstance(p, str) or p.tag != "tr" or len(_cells(p)) < 2 for p, _ in _parts(table))


def _cell_lines(cell: Node | str, hidden: bool, depth: int) -> list[str]:
    """A cell's text as one line, or as the lines of what it holds if a table within it is aligned."""
    if isinstance(cell, str):
        return [] if hidden else [_BLANK.sub(" ", cell).strip()]
    lines, aligned = _rendered(cell, depth + 1, hidden)
    if aligned:
        return lines
    text = _BLANK.sub(" ", " ".join(lines)).strip()
    return [text] if text else []


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[list[str]]] | None:
    """Cells (lines, colspan, rowspan) of rows in their columns; none if spans make too many empty places."""
    real, empty, below, out = sum(map(len, rows)), 0, {}, []
    for cells in rows:
        placed: list[list[str]] = []

        def skip_held() -> None:
            nonlocal empty
            while below.get(len(placed), 0) > 0:
                below[len(placed)] -= 1
                placed.append([])
                empty += 1

        for lines, across, down in cells:
            skip_held()
            for k in range(across):
                if down > 1:
                    below[len(placed)] = down - 1
                placed.append([] if k else lines)
            empty += across - 1
        skip_held()
        if empty > PLACES * real + 256:
            return None
        for k in [k for k, n in below.items() if k > len(placed) and n > 0]:
            below[k] -= 1
        out.append(placed)
    return out


def _table(table: Node, depth: int, hidden: bool) -> list[str]:
    """A table's captions and whatever else is outside its rows, then the rows; cells are padded to their column's width.

    A cell that spans rows keeps its columns empty in the rows below, as far as
    there are rows. A table whose spans or padding would outgrow its text isn't
    aligned: its cells stand two spaces apart.
    """
    rows, lines, size = [], [], 0
    for part, veil in _parts(table, hidden):
        if isinstance(part, str):
            lines += [] if veil else [_BLANK.sub(" ", part).strip()]
        elif part.tag != "tr":
            lines += _rendered(part, NESTED, veil)[0]
        else:
            veil = veiled(part, veil)
            cells = []
            for cell in _cells(part):
                down = _span(cell, "rowspan", 65_534) or 65_534  # 0 reaches to the end
                cells.append((_cell_lines(cell, veil, depth), max(1, _span(cell, "colspan", 100)), down))
                size += 9 + sum(map(len, cells[-1][0]))
            rows.append(cells)
    placed = _placed(rows)
    shown = [] if placed is None else [r for r in placed if any(r)]
    widths = [min(WIDEST, max(max(map(len, r[k]), default=0) for r in shown if k < len(r))) for k in range(max(map(len, shown), default=0))]
    ends = [0]
    for w in widths:
        ends.append(ends[-1] + w + 2)
    if placed is None or sum(ends[len(r)] * max(map(len, r), default=0) for r in shown) > PADDING * size + 4096:
        plain = ["  ".join(" ".join(c) for c, _, _ in cells if c) for cells in rows]
        return lines + [x for x in plain if x]
    for r in shown:
        for k in range(max(map(len, r))):
            lines.append("  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(r, widths, strict=False)).rstrip())
    return lines


def _options(select: Node) -> list[str]:
    """The options that a select shows: the chosen ones, or the first; a list of several rows shows all."""
    found, todo = [], list(reversed(select.children))
    while todo:
        node = todo.pop()
        if isinstance(node, Node) and visible(node):
            if node.tag == "option":
                found.append(node)
            elif node.tag == "optgroup":
                todo += reversed(node.children)
    if "multiple" not in select.attributes and _span(select, "size", 99) < 2:
        found = [o for o in found if "selected" in o.attributes][-1:] or found[:1]
    return [o.attributes.get("label") or "".join(c for c in o.children if isinstance(c, str)) for o in found]


def _rendered(root: Node, depth: int = 0, hidden: bool = False) -> tuple[list[str], bool]:
    """Lines of a tree, and whether any table in it is aligned; from ``NESTED`` tables on, tables are blocks like others."""
    out, lists, aligned = _Out(), [], False
    # a stack of steps, so that deep pages need no recursion
    steps: list[tuple] = [("open", root, False, veiled(root, hidden))]
    while steps:
        what, node, pre, veil = steps.pop()
        if what == "text":
            if veil:
                pass
            elif pre:
                out.exact(node)
            else:
                out.inline(node)
        elif what == "close":
            if node.tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.end_line(gap=not lists)
                out.depth -= 1
            elif node.tag in ("blockquote", "dd"):
                out.end_line(gap=node.tag == "blockquote")
                out.depth -= 1
            else:
                out.end_line(gap=node.tag in SPACED)
        elif node.tag == "br":
            if out.current:
                out.end_line()
            else:
                out.gap = True
        elif node.tag == "select":
            for text in () if veil else _options(node):
                out.inline(f" {text} ")
        elif node.tag == "table" and node is not root and depth < NESTED and not _is_layout(node):
            out.end_line(gap=True)
            out.whole(_table(node, depth, veil))
            out.gap = aligned = True
        else:
            if node.tag in BLOCK or node.tag in ("td", "th"):
                out.end_line(gap=node.tag in SPACED and not (node.tag in ("ul", "ol", "menu", "dir") and lists))
                if node.tag in ("ul", "ol", "menu", "dir"):
                    start = node.attributes.get("start", "")
                    lists.append([node.tag, int(start) if start.isdecimal() and len(start) < 9 else 1])
                    out.depth += 1
                elif node.tag in ("blockquote", "dd"):
                    out.depth += 1
                elif node.tag == "li" and lists:
                    kind, number = lists[-1]
                    out.prefix = f"{number}. " if kind == "ol" else "- "
                    lists[-1][1] += 1
                steps.append(("close", node, pre, veil))
            inner = pre or node.tag in ("pre", "listing", "plaintext", "textarea")
            for child in reversed(node.children):
                if isinstance(child, str):
                    if node.tag not in DRAWN:
                        steps.append(("text", child, inner, veil))
                elif visible(child):
                    steps.append(("open", child, inner, veiled(child, veil)))
    out.end_line()
    return [x.rstrip() for x in out.lines], aligned


def render(source: str | None) -> str:
    """The visible text of a page, as lines with blank lines between spaced blocks."""
    return "\n".join(_rendered(parse(source))[0]).strip("\n") if source else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks): one row per row of ``pages(page_id, html)``.

    Whole pages are rendered, with the text of drawings, the options that a
    select shows, and text areas; tables of one column are blocks of text. Time
    and output are in proportion to a page's length, however deep its elements
    nest and however far its cells span: tables in more than ``NESTED`` others,
    and those whose spans or padding outgrow their text, aren't aligned.
    Elements may be hidden by attributes, by their style, or by simple selectors
    of the page's style sheets; what is visible within a hidden one is shown. n_blocks counts the parts between blank lines.
    Null and empty pages, and those without visible text, give an empty text and
    no blocks. Repeated rows are rendered one by one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in pieces(batch, batch.column("html"), rows=256):
                texts = [render(x) for x in cut.column("html").to_pylist()]
                blocks = [len([b for b in t.split("\n\n") if b.strip()]) for t in texts]
                yield pa.record_batch([cut.column("page_id"), pa.array(texts, pa.string()), pa.array(blocks, pa.int64())], names=["page_id", "text", "n_blocks"])

    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, text string, n_blocks long")
