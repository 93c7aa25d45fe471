"""Layout-aware text of HTML: a tree with implied tags, visibility rules, and a rendering that keeps blocks, lists and tables."""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes noembed iframe xmp".split())
HIDDEN = frozenset("head script style template noscript noframes noembed iframe object audio video canvas datalist map title meta link base area param source track annotation annotation-xml mphantom".split())
#: In a drawing only text elements and HTML are text, and nothing of what stands in these is painted.
DRAWN = frozenset(["text", "foreignobject"])
UNPAINTED = HIDDEN | frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter desc metadata".split())
#: HTML inside drawings and formulas begins in these; start tags of the others end a drawing or formula left open.
HTML_POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure article section hr fieldset".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt li tbody td tfoot th thead tr caption legend summary figcaption".split()) | frozenset(["li", "dd", "dt"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these, looked for up to an element of the scope.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
}
#: What a cell or row needs around it, if it isn't there.
PARENTS = {"td": "tr", "th": "tr", "tr": "tbody"}
#: Parts of a table, and elements whose content is no part of the table around them.
PARTS = frozenset("caption thead tbody tfoot tr td th".split())
ENDS_TABLE = HIDDEN | frozenset(["td", "th", "caption", "table", "svg", "math", "select"])
P_SCOPE = frozenset("table td th caption button object template html body".split())
#: Elements that decide how far an end tag or an implied end reaches.
CELL_SCOPE = ("td", "th", "table")
INSIDE_TABLE = frozenset("table tr tbody thead tfoot body html div article section".split())
FOREIGN = ("svg", "math")
#: Start tags that end a select left open.
ENDS_SELECT = frozenset("select input textarea".split())
#: Levels of lists that are indented; deeper ones stand where the last of them does.
INDENTED = 64
#: Characters after which the lines of a table are folded.
FOLD = 1 << 12

# quotes count after an equals sign alone; a tag that never ends takes the rest of the page with it
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>\x00]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)|<[!?/][^>]*+>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")


def _unescape(text: str) -> str:
    """Character references as characters; numbers of any length, which the standard library refuses to read, are no character or lose leading zeros."""

    def known(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else html.unescape(f"&#{'' if m[1] else 'x'}{digits};")

    return html.unescape(_REFERENCE.sub(known, text) if "&#" in text else text)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if not text or text.isspace():
        return out
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), _unescape(next((v for v in values if v), "")))
    return out


class _Open:
    """The open elements, and for each tag where it is open: the nearest of some tags is found without a walk, however deep the page."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        self.at.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def cut(self, k: int) -> None:
        """Closes the element at ``k`` and all inside it."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()

    def last(self, *tags: str) -> int:
        """The nearest open element of some tags; 0, the root, if none is open."""
        k = 0
        for t in tags:
            if (found := self.at.get(t)) and found[-1] > k:
                k = found[-1]
        return k


def parse(text: str) -> Element:
    """The tree of a page: tags left open are closed where the next tag implies it, stray end tags are dropped."""
    root = Element("#root")
    opens, at, n = _Open(root), 0, len(text)
    stack = opens.stack

    def close(tags: Collection[str], scope: Collection[str]) -> None:
        k = opens.last(*tags)
        if k > opens.last("template", *scope):
            opens.cut(k)
            if "tr" in tags or "tbody" in tags:
                close(tags, scope)

    def opened(tag: str, attributes: dict[str, str]) -> Element:
        e = Element(tag, attributes)
        stack[-1].children.append(e)
        if tag not in VOID:
            opens.push(e)
        return e

    def foreign() -> int:
        """The drawing or formula that is open, if no HTML is open inside it."""
        k = opens.last(*FOREIGN)
        return k if k > opens.last(*HTML_POINTS) else 0

    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(_unescape(text[at : m.start()]))
        at = m.end()
        if m[2] is None or not m[0].endswith(">"):
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("br", "p") and not opens.last(tag):
                opened(tag, {})  # a stray </br> or </p> still breaks
                if tag == "p":
                    opens.cut(len(stack) - 1)
                continue
            k = opens.last(*HEADING) if tag in HEADING else opens.last(tag)
            if k and k >= opens.last("template") and (tag in INSIDE_TABLE or tag in CELL_SCOPE and k >= opens.last(*CELL_SCOPE) or k > opens.last(*CELL_SCOPE)):
                opens.cut(k)
            continue
        if tag in ENDS_SELECT and (k := opens.last("select")) > opens.last("table", "svg", "math"):
            opens.cut(k)
            if tag == "select":
                continue
        drawn = foreign()
        if drawn and tag in BREAKS_OUT:
            while drawn:
                opens.cut(drawn)
                drawn = foreign()
        if (drawn or tag in FOREIGN) and m[3].rstrip().endswith("/"):
            stack[-1].children.append(Element(tag, _attributes(m[3])))  # empty, as XML has it
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close(("p",), P_SCOPE)
        if tag in HEADING and stack[-1].tag in HEADING:
            opens.cut(len(stack) - 1)
        if tag in PARENTS and (inside := opens.last("table")):
            for need in (["tbody", "tr"] if tag in ("td", "th") else ["tbody"]):
                if opens.last(*(("tbody", "thead", "tfoot") if need == "tbody" else ("tr",))) < inside:
                    opened(need, {})
        e = opened(tag, _attributes(m[3]))
        if tag in RAW:  # its content is text up to its own end tag
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(text, at)
            stop = end.start() if end else n
            e.children.append(_unescape(text[at:stop]) if tag in ("textarea", "title") else text[at:stop])
            gt = text.find(">", stop)
            at = gt + 1 if end and gt >= 0 else n
            if stack[-1] is e:
                opens.cut(len(stack) - 1)
    if at < n:
        stack[-1].children.append(_unescape(text[at:]))
    return root


def hidden(e: Element) -> bool:
    """Whether nothing of an element is seen: by kind, the hidden attribute, aria-hidden, a style or an input that has no face."""
    if e.tag in HIDDEN:
        return True
    a = e.attributes
    if not a:
        return False
    return "hidden" in a and a["hidden"].lower() != "until-found" or a.get("aria-hidden", "").lower() == "true" or e.tag == "dialog" and "open" not in a or "style" in a and _STYLE_HIDES.search(a["style"]) is not None


class _Lines:
    """Lines being written: runs of white space as one space, blocks on lines of their own, at most one line left free."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.free = 0
        self.mark = ""

    def text(self, t: str, kept: bool = False) -> None:
        if kept:
            first, *rest = t.split("\n")
            if not self.now:
                self._before()
            self.now.append(first)
            for line in rest:
                self.lines.append("".join(self.now).rstrip())
                self.now = [line]
            return
        for k, part in enumerate(_SPACE.split(t)):
            if k:
                self.space = True
            if part:
                if self.space and self.now:
                    self.now.append(" ")
                self.space = False
                if not self.now and self.mark:
                    self.now.append(self.mark)
                    self.mark = ""
                self._before()
                self.now.append(part)

    def _before(self) -> None:
        if self.free and self.lines and self.lines[-1]:
            self.lines.append("")
        self.free = 0

    def end(self, free: bool = False) -> None:
        if self.now:
            self._before()
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.free |= free

    def brk(self) -> None:
        if self.now:
            self.end()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _run(steps: Iterator) -> str:
    """The result of a generator that yields generators whose results it waits for: calls of any depth without a deep stack."""
    waiting, value = [steps], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


def render(e: Element) -> str:
    """All visible text under an element: blocks apart, list items marked and indented, cells of a table in columns."""
    return _run(_text(e))


def _text(e: Element) -> Iterator:
    out = _Lines()
    yield _write(e, out)
    return out.result()


def _write(e: Element, out: _Lines, depth: int = 0, pre: bool = False, number: list[int] | None = None) -> Iterator:
    for c in e.children:
        if isinstance(c, str):
            out.text(c, pre)
            continue
        tag = c.tag
        if hidden(c):
            continue
        if tag == "br":
            out.brk()
        elif tag == "hr":
            out.end(True)
        elif tag == "img" or tag == "input":
            shown = c.attributes.get("alt") if tag == "img" else c.attributes.get("value") if c.attributes.get("type", "").lower() in ("submit", "button", "reset") else None
            out.text(shown or "")
        elif tag == "select":
            for x in _chosen(c):
                out.text(f" {x.attributes.get('label') or ' '.join((yield _text(x)).split())} ")
        elif tag == "svg":
            for t in _drawn(c):
                out.text(" ")
                yield _write(t, out, depth, pre)
                out.text(" ")
        elif tag in ("mtr", "mlabeledtr", "mtd"):
            out.text(" ")
            yield _write(c, out, depth, pre)
            out.text(" ")
        elif tag == "table":
            out.end(True)
            for line in (yield _grid(c)):
                out.now.append("  " * min(depth, INDENTED) + line)
                out.end()
            out.end(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.end(depth == 0)
            start = c.attributes.get("start", "1")
            yield _write(c, out, depth + 1, pre, [int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1] if tag == "ol" else None)
            out.end(depth == 0)
        elif tag == "li":
            out.end()
            mark = "- "
            if number is not None:
                mark = f"{number[0]}. "
                number[0] += 1
            out.mark = "  " * min(max(depth - 1, 0), INDENTED) + mark
            yield _write(c, out, max(depth, 1), pre)
            out.end()
            out.mark = ""
        elif tag in BLOCKS:
            out.end(tag in SPACED)
            yield _write(c, out, depth, pre or tag == "pre")
            out.end(tag in SPACED)
        else:
            yield _write(c, out, depth, pre or tag == "textarea", number)


def _chosen(e: Element) -> list[Element]:
    """The options that a select shows: the last that is selected, else the first that is enabled; all visible ones if it is a list."""
    options, todo = [], [(e, True, False)]
    while todo:
        x, seen, off = todo.pop()
        for c in reversed(x.children):
            if isinstance(c, Element) and c.tag not in HIDDEN:
                todo.append((c, seen and not hidden(c), off or "disabled" in c.attributes and c.tag in ("option", "optgroup")))
        if x.tag == "option":
            options.append((x, seen, off))
    size = e.attributes.get("size", "")
    if "multiple" in e.attributes or size.isdecimal() and size.isascii() and size.strip("0") not in ("", "1"):
        return [x for x, seen, _ in options if seen]
    chosen = [x for x, _, _ in options if "selected" in x.attributes]
    return chosen[-1:] or [x for x, _, off in options if not off][:1]


def _drawn(e: Element) -> Iterator[Element]:
    """The elements of a drawing that show text, in order."""
    todo = [e]
    while todo:
        x = todo.pop()
        if x.tag in DRAWN:
            yield x
            continue
        for c in reversed(x.children):
            if isinstance(c, Element) and c.tag not in UNPAINTED and not hidden(c) and c.attributes.get("display") != "none" and c.attributes.get("visibility") not in ("hidden", "collapse"):
                todo.append(c)


def _parts(e: Element) -> tuple[list[list], list[Element], list[list[Element]]]:
    """What a table holds: runs of loose content, captions, and rows of cells; parts are found through any wrapper but a nested table.

    Text and elements outside cells are loose: browsers show them before the table.
    """
    holds, order = {id(e)}, [(e, -1)]  # wrappers above a part; elements with the place of their parent
    for at, (x, _) in enumerate(order):
        for c in x.children:
            if isinstance(c, Element):
                k = at if c.tag in PARTS else -1
                while k >= 0 and id(order[k][0]) not in holds:
                    holds.add(id(order[k][0]))
                    k = order[k][1]
                if c.tag not in ENDS_TABLE:
                    order.append((c, at))
    runs, captions, rows = [[]], [], []
    todo = [(iter(e.children), None, True)]  # children left, cells of the row around them, whether loose content is seen
    while todo:
        children, row, seen = todo[-1]
        c = next(children, None)
        if c is None:
            todo.pop()
            runs.append([])
        elif isinstance(c, Element) and (c.tag in PARTS or id(c) in holds):
            runs.append([])
            gone = hidden(c)
            if c.tag not in PARTS:
                todo.append((iter(c.children), row, seen and not gone))
            elif gone:
                continue
            elif c.tag == "caption":
                captions.append(c)
            elif c.tag in ("td", "th"):
                if row is None:
                    rows.append(row := [])
                    todo[-1] = (children, row, seen)
                row.append(c)
            else:
                if c.tag == "tr":
                    rows.append([])
                todo.append((iter(c.children), rows[-1] if c.tag == "tr" else None, seen))
        elif seen:
            runs[-1].append(c)
    return [r for r in runs if any(isinstance(c, Element) or not c.isspace() for c in r)], captions, rows


def _span(e: Element, name: str) -> int:
    """A span as the HTML standard reads it: 1000 columns and 65534 rows at most, 1 if it is no number."""
    m = re.match(r"[ \t\n\f\r]*\+?0*([0-9]+)", e.attributes.get(name, ""))
    return 1 if m is None else min(int(m[1]) if len(m[1]) < 6 else 1 << 16, 1000 if name == "colspan" else 65534)


def _grid(e: Element) -> Iterator:
    """The lines of a table: loose content, a caption, then rows with cells padded to the width of their column; spans leave cells empty."""
    runs, captions, rows = _parts(e)
    above = []
    for x in [*(Element("#loose", children=r) for r in runs), *captions]:
        if t := (yield _text(x)):
            above += t.split("\n")
    placed: list[list[tuple[int, str]]] = []
    growing: list[tuple[int, int, int]] = []  # columns from, up to, that cells of rows above take, and until which row
    height = len(rows)
    for r, row in enumerate(rows):
        growing = [x for x in growing if x[2] > r]
        col, nth, own, more = 0, 0, [], []
        for c in row:
            while nth < len(growing) and growing[nth][0] <= col:
                col = max(col, growing[nth][1])
                nth += 1
            across, down = _span(c, "colspan") or 1, _span(c, "rowspan")
            down = height - r if down == 0 else min(down, height - r)  # 0: all rows that follow
            own.append((col, " ".join((yield _text(c)).split("\n"))))
            if down > 1:
                more.append((col, col + across, r + down))
            col += across
        if more:
            growing = _joined(sorted(growing + more))
        placed.append(own)
    return above + _aligned(placed)


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring columns that are taken until the same row as one."""
    out = spans[:1]
    for start, end, until in spans[1:]:
        if until == out[-1][2] and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), until)
        else:
            out.append((start, end, until))
    return out


def _aligned(rows: list[list[tuple[int, str]]]) -> list[str]:
    """Lines of rows of (column, text): columns as wide as their widest cell and a bar between them.

    A table is folded at ``FOLD`` characters, as a printed one is at the edge of its page: columns that would end beyond it go
    on a line of their own below, and a cell wider than a line ends its line and widens no column. Cells stand in their columns
    whatever the number of rows, and no row's line depends on how large the table is.
    """
    width: dict[int, int] = {}
    for row in rows:
        for col, text in row:
            width[col] = max(width.get(col, 0), len(text) if len(text) <= FOLD else 0)
    bands: list[list[int]] = [[]]
    place: dict[int, tuple[int, int]] = {}
    taken = 0
    for c in sorted(width):
        if bands[-1] and taken + width[c] > FOLD:
            bands.append([])
            taken = 0
        place[c] = len(bands) - 1, len(bands[-1])
        bands[-1].append(c)
        taken += width[c] + 3
    lines: list[str] = []
    for row in rows:
        now, line = -1, []
        for c, text in row:
            if not text:
                continue
            band, nth = place[c]
            if band != now:
                lines.append(" | ".join(line).rstrip(" |"))
                now, line = band, []
            line += [" " * width[x] for x in bands[band][len(line) : nth]]
            line.append(text.ljust(width[c]))
            if len(text) > width[c]:
                now = -1
        lines.append(" | ".join(line).rstrip(" |"))
    return [x for x in lines if x]


def extract(page: str | None) -> tuple[str | None, str]:
    """(title, visible text) of a page; null and empty pages have none."""
    if not page:
        return None, ""
    root = parse(page)
    titles = [root]
    for e in titles:  # breadth first, as far as the title
        if e.tag == "title":
            return " ".join("".join(c for c in e.children if isinstance(c, str)).split()) or None, render(root)
        titles += [c for c in e.children if isinstance(c, Element) and c.tag not in ("body", "svg")]
    return None, render(root)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, n_lines) of every row of ``pages(page_id, url, html)``; one row for one row, no shuffle.

    Null and empty pages have an empty text and no title; pages of any length and depth are read whole;
    repeated rows each give theirs; an empty table gives no rows; other columns are not looked at.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [extract(h) for h in b.column("html").to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for _, t in got]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([t for _, t in got], pa.string()), pa.array(lines, pa.int64())], ["page_id", "url", "title", "text", "n_lines"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return slim.mapInArrow(extracted, "page_id long, url string, title string, text string, n_lines long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
