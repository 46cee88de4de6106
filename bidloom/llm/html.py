"""Visible text of HTML pages, laid out.

A tokenizer reads tags as browsers do (quoted attributes, comments, raw text of scripts and styles); a tree builder supplies what the
page leaves out: end tags of p, li, dt, dd, option, cells, rows and row groups, and rows around cells. Elements that are not
displayed (head, script, style, template, noscript and the like; hidden; display: none; closed details and dialogs) are left out with
all they hold; visibility: hidden leaves out the text but keeps its place. What remains is laid out: white space is collapsed except
in pre, blocks stand on lines of their own, paragraphs, headings, tables and outer lists are parted by a blank line, list items carry
a dash or their number and are indented by their depth, and the cells of a table are padded so that columns align.

A cell of several lines stands on as many, beside its neighbours; one that spans rows keeps its column free in those below, to the end of
their group at most; wide characters count as two columns. A table with one cell in each row is laid out as its cells are. So that
a page cannot blow up with the square of its size, a table padded to more than `PADDING` times its text goes without the padding of its
widest columns.
Null or empty pages give an empty text. Very long pages are read whole; work is linear in the page but for the padding, and nesting needs
no recursion. Repeated rows and ties are rendered alike, each for itself. An empty table gives an empty one. Extra columns pass, and
those named text or n_lines are replaced.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bidloom.llm.common import map_documents

ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())])


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
HIDDEN = _set("head title script style template noscript noembed noframes iframe object audio video canvas svg math map datalist rp base link meta param source track area col colgroup")
BLOCKS = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul")
CLOSE_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt")
SPACED = _set("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure fieldset")
LISTS = _set("ul ol menu dir")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: An opening tag ends these open elements, unless one of the second set stands between.
ENDS = {
    "li": (_set("li"), LISTS),
    "dt": (_set("dt dd"), _set("dl")),
    "dd": (_set("dt dd"), _set("dl")),
    "option": (_set("option"), _set("select datalist optgroup")),
    "optgroup": (_set("option optgroup"), _set("select")),
    "td": (_set("td th"), _set("tr table")),
    "th": (_set("td th"), _set("tr table")),
    "tr": (_set("tr td th"), _set("table tbody thead tfoot")),
    "tbody": (_set("tbody thead tfoot tr td th caption"), _set("table")),
    "thead": (_set("tbody thead tfoot tr td th caption"), _set("table")),
    "tfoot": (_set("tbody thead tfoot tr td th caption"), _set("table")),
    "rt": (_set("rt rp"), _set("ruby")),
    "rp": (_set("rt rp"), _set("ruby")),
}
PADDING = 16
MOST_ROWS = 65_534
_WIDE = re.compile("[\u1100-\u115f\u2e80-\u303e\u3041-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6\U0001f300-\U0001faff\U00020000-\U0003fffd]")
_MARKS = re.compile("[\u0300-\u036f\u200b-\u200d\u2060\ufeff]")
BARRIERS = _set("table td th caption html template body")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+(?:[\"'=][^>]*+)?)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WHITE = re.compile(r"[ \t\n\f\r]+")
_DECLARED = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)")


def tokens(page: str):
    """("text", text), ("open", name, attributes), ("close", name)."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2 if page.startswith(("<!-->", "<!--->"), lt) else lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?") or nxt == "/" and not page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/"):
            yield "text", "<", ""
            at = lt + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            return  # a tag that never ends takes the rest with it
        name = m[2].lower()
        at = m.end()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if name not in ("script", "style"):
                yield "text", page[at:stop], ""
            close = page.find(">", stop) if end else -1
            yield "close", name, ""
            at = n if close < 0 else close + 1


class Frame:
    """An open element. A block has lines of its own; an inline one writes to the block around it."""

    __slots__ = ("tag", "lines", "inline", "gap", "rows", "number", "shown", "visible", "pre", "block", "span", "depth", "marker", "down")

    def __init__(self, tag: str, parent: Frame | None):
        self.tag, self.block = tag, tag in BLOCKS or parent is None
        self.lines: list[str] = []
        self.inline: list[tuple[str, bool]] = []
        self.gap = 0
        self.rows: list = []
        self.number, self.span, self.down, self.marker = 1, 1, 1, None
        self.shown = parent.shown if parent else True
        self.visible = parent.visible if parent else True
        self.pre = (parent.pre if parent else False) or tag in ("pre", "textarea", "xmp")
        self.depth = (parent.depth if parent else 0) + (tag in LISTS)

    def flush(self) -> None:
        if not self.inline:
            return
        text, self.inline = "", self.inline
        for part, kept in self.inline:
            text += part if kept else _WHITE.sub(" ", part)
        kept = any(k for _, k in self.inline)
        self.inline = []
        text = (text.rstrip() if kept else _WHITE.sub(" ", text).strip(" ")).replace("\xa0", " ")
        if text or kept:
            self.put([text], 0)

    def put(self, lines: list[str], gap: int) -> None:
        if not lines:
            return
        if not self.lines:
            self.lines = lines
        else:
            if max(self.gap, gap):
                self.lines.append("")
            self.lines += lines
        self.gap = gap


class Layout:
    def __init__(self) -> None:
        self.stack = [Frame("", None)]
        self.blocks = [self.stack[0]]
        self.open: dict[str, int] = {}

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not top.shown or not top.visible or top.tag == "details" and top.number < 0:
            return
        text = unescape(raw) if "&" in raw else raw
        block = self.blocks[-1]
        if block.tag in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol") and not text.strip():
            return
        if not top.pre:
            block.inline.append((text, False))
            return
        first, *rest = text.replace("\r\n", "\n").split("\n")
        block.inline.append((first, True))
        for part in rest:
            block.flush()
            block.inline.append((part, True))

    def start(self, name: str, attributes: str) -> None:
        if name in CLOSE_P and self.open.get("p"):
            self._end(_set("p"), BARRIERS | _set("button"))
        if name in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if name in ENDS:
            ends, stops = ENDS[name]
            while self._end(ends, stops):
                pass
        if name in ("td", "th") and self.open.get("table") and self.blocks[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.push("tr", "")
        if name == "br":
            if self.stack[-1].shown:
                block = self.blocks[-1]
                if block.inline:
                    block.flush()
                elif block.lines:
                    block.gap = 1
            return
        if name == "wbr":
            return
        self.push(name, attributes)
        if name in VOID:
            self.pop()

    def push(self, name: str, attributes: str) -> None:
        f = Frame(name, self.stack[-1])
        if name in HIDDEN:
            f.shown = False
        if attributes.strip() or name in ("details", "dialog"):
            own = {}
            for k, v in _ATTRIBUTE.findall(attributes):
                own.setdefault(k.lower(), unescape(v.strip("\"'")) if v else "")
            self.style(f, own)
        parent = self.stack[-1]
        if parent.tag == "details" and parent.number < 0 and name != "summary":
            f.shown = False
        self.stack.append(f)
        self.open[name] = self.open.get(name, 0) + 1
        if f.block:
            self.blocks[-1].flush()
            self.blocks.append(f)
        if name == "li":
            around = next((b for b in reversed(self.blocks[:-1]) if b.tag in LISTS), None)
            if around is not None and around.tag == "ol":
                if f.marker is not None:
                    around.number = f.marker
                f.marker = f"{around.number}. "
                around.number += 1
            else:
                f.marker = "- "

    def style(self, f: Frame, own: dict[str, str]) -> None:
        if "hidden" in own and own["hidden"].lower() != "until-found" or f.tag == "dialog" and "open" not in own or f.tag == "input" and own.get("type", "").lower() == "hidden":
            f.shown = False
        for what, value in _DECLARED.findall(own.get("style", "").lower()):
            if what == "display" and value == "none":
                f.shown = False
            elif what == "visibility":
                f.visible = value not in ("hidden", "collapse")
        if f.tag == "details" and "open" not in own:
            f.number = -1
        if f.tag in ("td", "th") and re.fullmatch(r"[0-9]{1,9}", own.get("rowspan", "")):
            f.down = int(own["rowspan"]) or MOST_ROWS
        number = own.get("start" if f.tag == "ol" else "value" if f.tag == "li" else "colspan" if f.tag in ("td", "th") else "", "")
        if re.fullmatch(r"-?[0-9]{1,9}", number):
            if f.tag == "ol":
                f.number = int(number)
            elif f.tag == "li":
                f.marker = int(number)
            else:
                f.span = max(1, min(1000, int(number)))

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name == "p" and not self.open.get("p"):
            self.push("p", "")
            self.pop()
        elif self.open.get(name):
            self._end(_set(name), frozenset() if name in BARRIERS or name in ("tr", "tbody", "thead", "tfoot") else BARRIERS)

    def _end(self, names: frozenset[str], stops: frozenset[str]) -> bool:
        """Close the innermost open element of these names, and what is open inside it."""
        if not any(self.open.get(n) for n in names):
            return False
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in names:
                while len(self.stack) > k:
                    self.pop()
                return True
            if tag in stops:
                return False
        return False

    def pop(self) -> None:
        f = self.stack.pop()
        self.open[f.tag] -= 1
        if not f.block:
            return
        f.flush()
        self.blocks.pop()
        parent = self.blocks[-1]
        if f.tag in ("td", "th") and parent.tag == "tr":
            if f.shown:
                parent.rows.append((f.lines, f.span, f.down))
            return
        if f.tag == "tr":
            around = parent if parent.tag in ("table", "tbody", "thead", "tfoot") else None
            if around is not None:
                around.put(f.lines, 0)
                if f.rows:
                    around.rows.append(f.rows)
                return
            f.put(_table([f.rows]), 0)
        elif f.tag in ("tbody", "thead", "tfoot") and parent.tag == "table":
            parent.put(f.lines, 0)
            parent.rows += [None, *f.rows, None]  # spans of rows end with their group
            return
        elif f.tag == "table" or f.rows:
            f.put(_table(f.rows), 0)
        if not f.shown or not f.lines:
            return
        lines, gap = f.lines, f.tag in SPACED or f.tag in LISTS and f.depth == 1
        if f.tag == "li":
            pad = " " * len(f.marker)
            lines = [f.marker + lines[0], *(pad + x if x else x for x in lines[1:])]
        elif f.tag in ("dd", "blockquote"):
            lines = ["  " + x if x else x for x in lines]
        parent.put(lines, int(gap))

    def finish(self) -> list[str]:
        while len(self.stack) > 1:
            self.pop()
        self.stack[0].flush()
        return self.stack[0].lines


def width(text: str) -> int:
    """Columns that a text takes: wide characters take two, marks on others none."""
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text)) - len(_MARKS.findall(text))


def _placed(rows: list[list[tuple[list[str], int, int]] | None]) -> list[list[tuple[int, list[str], int]]]:
    """Cells of each row with their column: those of rows above that span this one are passed over. None ends a group of rows."""
    out, open_ = [], []  # open_: [first column, end, rows left], in order of columns
    for r in rows:
        if r is None:
            open_ = []
            continue
        at, k, placed, new = 0, 0, [], []
        for lines, span, down in r:
            while k < len(open_) and open_[k][0] < at + 1:
                at, k = max(at, open_[k][1]), k + 1
            placed.append((at, lines, span))
            if down > 1:
                if new and new[-1][1] == at and new[-1][2] == down - 1:
                    new[-1][1] = at + span
                else:
                    new.append([at, at + span, down - 1])
            at += span
        out.append(placed)
        for x in open_:
            x[2] -= 1
        open_ = [x for x in open_ if x[2] > 0]
        open_ = sorted(open_ + new) if new else open_
    return out


def _table(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """Rows with the cells of a column under each other; a cell of several lines stands on as many, beside its neighbours, and one that spans
    several rows stands in the first."""
    placed = [r for r in _placed(rows) if any(lines for _, lines, _ in r)]
    if all(len(r) == 1 and r[0][0] == 0 for r in placed):  # nothing to align: a table that only frames what it holds
        return [x for r in placed for _, lines, _ in r for x in lines]
    widths: dict[int, int] = {}
    for r in placed:
        for at, lines, span in r:
            if span == 1 and lines:
                widths[at] = max(widths.get(at, 0), *map(width, lines))
    high = sum(max(len(lines) for _, lines, _ in r) for r in placed)
    bound = PADDING * (sum(len(x) for r in placed for _, lines, _ in r for x in lines) + 4096)
    while widths and high * sum(widths.values()) > bound:
        del widths[max(widths, key=widths.__getitem__)]
    columns = sorted({0} | {c for r in placed for at, _, span in r for c in (at, at + span)} | set(widths) | {c + 1 for c in widths})
    begin, x = {}, 0  # where each column begins
    for c, after in zip(columns, [*columns[1:], columns[-1]], strict=True):
        begin[c] = x
        x += widths.get(c, 0) + 2 * (after - c) if after > c else 0
    out = []
    for r in placed:
        for k in range(max(len(lines) for _, lines, _ in r)):
            x, parts = 0, []
            for at, lines, _ in r:
                text = lines[k] if k < len(lines) else ""
                if text:
                    gap = max(begin[at] - x, 2 if parts else 0)
                    parts += [" " * gap, text]
                    x += gap + width(text)
            out.append("".join(parts))
    return out


def render(page: str) -> list[str]:
    layout = Layout()
    for kind, value, attributes in tokens(page):
        if kind == "text":
            layout.text(value)
        elif kind == "open":
            layout.start(value, attributes)
        else:
            layout.end(value)
    return layout.finish()


def visible_text(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """pages with text and n_lines."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            done = [render(p.as_py() or "") for p in batch.column(html)]
            return {"text": pa.array(["\n".join(x) for x in done], pa.string()), "n_lines": pa.array([len(x) for x in done], pa.int64())}

        return work

    return map_documents(pages, make, ADDED, carry)
