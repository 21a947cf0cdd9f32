"""HTML extraction: a tree builder with implied tags, visibility rules, and a renderer that keeps the layout.

Everything is one pass over the page with a stack of open elements and an index of it; nothing recurses and nothing is
read twice, so depth is no limit.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, read

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table hr figure fieldset menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption thead tbody tfoot tr td th".split())
ENDS_P = (BLOCK | {"hr"}) - frozenset("body html option optgroup td th tr thead tbody tfoot caption".split())
HEAD = frozenset("head title meta link base style script noscript template".split())
#: What an opening tag closes first, and within which element.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
WALLS = frozenset("table td th caption html body".split())
#: What may start a piece of mark-up, and the parts of a tag; each of them reads every character once.
MARK = re.compile(r"<(?:(!--)|([!?]|/(?![A-Za-z>]))|(/?)([A-Za-z][^\s/>]*)|(/>))")
COMMENT_END = re.compile(r"--!?>")
NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?\s*(=)?\s*")
BARE = re.compile(r"[^\s>]*")
NONE, GONE, SHOWN = re.compile(r"display\s*:\s*none", re.I), re.compile(r"visibility\s*:\s*(?:hidden|collapse)", re.I), re.compile(r"visibility\s*:\s*visible", re.I)
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)", re.I)
PLAIN = re.compile(r"[\w-]*[.#]?[\w-]+")
#: Inputs whose value is not shown as text.
MUTE = frozenset("checkbox radio password file image color range".split())
#: Levels of lists that are shown by indentation, deeper ones by their number; tables whose padding would be more than
#: so many times their text are written without it. Both keep what a page renders to in proportion to the page.
INDENTED, PADDING = 20, 8


class Buffer:
    """Lines of text; spaces are folded unless told, and the gap before the next text is remembered, not written."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap, self.space, self.prefix = 0, False, ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            self._open()
            self.out.append(s)
            self.space = False
            return
        words = s.split()
        if not words:
            self.space = self.space or bool(s)
            return
        lead = self.space or s[0].isspace()
        fresh = self._open()
        self.out.append((" " if lead and not fresh else "") + " ".join(words))
        self.space = s[-1].isspace()

    def _open(self) -> bool:
        """Writes the gap; true at the start of a line."""
        fresh = not self.out or self.gap > 0
        if self.out and self.gap:
            self.out.append("\n" * self.gap)
        if self.prefix:
            self.out.append(self.prefix)
            self.prefix = ""
        elif not fresh and self.out[-1].endswith("\n"):
            fresh = True
        self.gap, self.space = 0, False if fresh else self.space
        return fresh

    def line(self, n: int) -> None:
        self.gap, self.space = max(self.gap, n), False

    def rule(self) -> None:
        if self.gap:
            self.gap = min(self.gap + 1, 2)
        elif self.out:
            self.out.append("\n")
        self.space = False

    def value(self) -> str:
        return "".join(self.out).strip("\n")


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """rows of cells (text, colspan, rowspan) as rows of (first column, end, text), around cells that reach down."""
    out, held = [], []  # held: [first, end, the row before which it ends], in order of columns
    ending: dict[int, list[int]] = {}  # the first columns of those that end before a row
    for r, row in enumerate(rows):
        for first in ending.pop(r, ()):
            del held[bisect_left(held, [first])]
        at, k, line, new = 0, 0, [], []
        for text, wide, high in row:
            while k < len(held) and held[k][0] < at + wide:  # the next one stands in the way
                at, k = max(at, held[k][1]), k + 1
            line.append((at, at + wide, text))
            if high > 1:
                if new and new[-1][1] == at and new[-1][2] == r + high:
                    new[-1][1] = at + wide
                else:
                    new.append([at, at + wide, r + high])
            at += wide
        out.append(line)
        for h in new:
            insort(held, h)
            ending.setdefault(h[2], []).append(h[0])
    return out


def _table(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of cells (text, colspan, rowspan) as lines; a column starts at the same place in all of them."""
    rows = [r for r in rows if r]
    if len(rows) == 1 and len(rows[0]) == 1:
        return rows[0][0][0]
    placed = _placed(rows)
    starts = {c: i for i, c in enumerate(sorted({a for line in placed for a, _, _ in line}))}
    order, widths, spanning, size = list(starts), [0] * len(starts), [], 0
    lines = []
    for line in placed:
        cells = []
        for a, b, text in line:
            first, end, parts = starts[a], bisect_left(order, b), text.split("\n")
            need = max(map(len, parts))
            size += len(text) + 3
            if end - first == 1:
                widths[first] = max(widths[first], need)
            else:
                spanning.append((end - first, first, end, need))
            cells.append((first, parts))
        lines.append(cells)
    for _, first, end, need in sorted(spanning):
        widths[end - 1] += max(0, need - sum(widths[first:end]) - 3 * (end - first - 1))
    offset = [0, *accumulate(w + 3 for w in widths)]
    height = lambda cells: max(len(parts) for _, parts in cells)
    aligned = sum(offset[cells[-1][0]] * height(cells) for cells in lines) <= PADDING * size + 4096
    out = []
    for cells in lines:
        for k in range(height(cells)):
            done = ""
            for n, (first, parts) in enumerate(cells):
                place = offset[first] if aligned else 0
                done = done.ljust(place - 3 if n else place) + (" | " if n else "") + (parts[k] if k < len(parts) else "")
            out.append(done.rstrip())
    return "\n".join(out)


def _span(text: str | None, most: int) -> int:
    return min(max(int(text), 1), most) if text and re.fullmatch(r"\s*\d{1,6}\s*", text) else 1


class Page:
    """Open elements: [tag, display, visible, keep white space, buffer before a cell, rows of a table, list counter, spans].

    at holds for each tag where in the stack it stands, so that no search goes through the stack.
    """

    def __init__(self, source: str, hidden_by: set[str] | None = None) -> None:
        """hidden_by: what the whole page's style sheets hide, if that is known from a pass before."""
        self.source, self.stack, self.root = source, [], Buffer()
        self.at: dict[str, list[int]] = {}
        self.buffer, self.hidden_by = self.root, hidden_by or set()
        self.known, self.late = hidden_by is not None, False

    def unseen(self, tag: str, at: dict[str, str]) -> bool:
        style = at.get("style", "")
        if "hidden" in at or tag in UNSEEN or (style and NONE.search(style)) or (tag == "input" and at.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in at):
            return True
        return bool(self.hidden_by) and (tag in self.hidden_by or ("id" in at and f"#{at['id']}" in self.hidden_by) or any(f".{c}" in self.hidden_by or f"{tag}.{c}" in self.hidden_by for c in at.get("class", "").split()))

    def style(self, css: str) -> None:
        """Takes plain selectors (tag, .class, #id, tag.class) whose last display is none, from rules that hold on a screen.

        Rules within @media for all or the screen and within @layer count, those of other at-rules do not: what hangs on
        a condition stays visible.
        """
        if self.known:
            return
        self.late = self.late or bool(self.root.out) or any(e[0] not in ("html", "head", "style") for e in self.stack)
        css, at, open_blocks, counts = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S), 0, [], True
        for m in re.finditer(r"[{};]", css):
            head, at = css[at : m.start()].strip(), m.end()
            if m[0] == "{":
                applies = counts
                if head.startswith("@"):
                    name, _, query = head[1:].partition(" ")
                    kinds = {q.strip().lower().removeprefix("only ").strip() for q in query.split(",")}
                    applies = counts and (name.lower() == "layer" or (name.lower() == "media" and bool(kinds & {"", "all", "screen"})))
                open_blocks.append((head, at, counts))
                counts = applies
            elif m[0] == "}" and open_blocks:
                head, start, before = open_blocks.pop()
                if counts and not head.startswith("@"):
                    self._rule(head, css[start : m.start()])
                counts = before

    def _rule(self, selectors: str, body: str) -> None:
        if shown := DISPLAY.findall(body):
            plain = {x for x in map(str.strip, selectors.split(",")) if PLAIN.fullmatch(x)}
            (self.hidden_by.update if shown[-1].lower() == "none" else self.hidden_by.difference_update)(plain)

    def shown(self) -> bool:
        return not self.stack or (self.stack[-1][1] and self.stack[-1][2])

    def last(self, *tags: str) -> int:
        """Where the innermost of the tags stands, -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def open(self, tag: str, at: dict[str, str]) -> None:
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD:
            self.close("head")
        if tag in ENDS_P:
            self.end_within({"p"}, WALLS | {"button"})
        if tag in CLOSES:
            self.end_within(*CLOSES[tag])
        if tag in ("td", "th") and self.last("table") > self.last("tr"):
            self.push("tr", {})
        if tag in VOID:
            if self.shown() and not self.unseen(tag, at):
                if tag == "br":
                    self.buffer.rule()
                elif tag == "hr":
                    self.buffer.line(2)
                elif tag == "img" and at.get("alt", "").strip():
                    self.buffer.text(at["alt"], False)
                elif tag == "input" and at.get("type", "text").strip().lower() not in MUTE and at.get("value"):
                    self.buffer.text(f" {at['value']} ", False)
            return
        self.push(tag, at)

    def push(self, tag: str, at: dict[str, str]) -> None:
        up = self.stack[-1] if self.stack else ["", True, True, False]
        style = at.get("style", "")
        visible = (up[2] or bool(SHOWN.search(style))) and not GONE.search(style) if style else up[2]
        new = [tag, up[1] and not self.unseen(tag, at), visible, up[3] or tag in ("pre", "textarea"), None, None, None, None]
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(new)
        if not new[1]:
            return
        if tag == "table":
            new[4], new[5] = self.buffer, []
            self.buffer = Buffer()  # what stands outside the cells
        elif tag == "tr" and (k := self.last("table")) >= 0 and self.stack[k][5] is not None:
            self.stack[k][5].append([])
        elif tag in ("td", "th") and (k := self.last("table")) >= 0 and self.stack[k][5]:
            new[4], new[7] = self.buffer, (_span(at.get("colspan"), 1_000), _span(at.get("rowspan"), 65_534))
            self.buffer = Buffer()
        elif tag in ("ul", "ol", "menu"):
            new[6] = int(at["start"]) - 1 if tag == "ol" and re.fullmatch(r"-?\d{1,9}", at.get("start", "")) else 0
            self.buffer.line(2 if self.last("li") < 0 else 1)
        elif tag == "li":
            self.buffer.line(1)
            depth = sum(len(self.at.get(t, ())) for t in ("ul", "ol", "menu"))
            k = self.last("ul", "ol", "menu")
            mark = "- "
            if k >= 0 and self.stack[k][6] is not None:
                self.stack[k][6] += 1
                mark = f"{self.stack[k][6]}. " if self.stack[k][0] == "ol" else mark
            self.buffer.prefix = "  " * max(0, min(depth, INDENTED) - 1) + (f"({depth}) " if depth > INDENTED else "") + mark
        elif tag in BLOCK:
            self.buffer.line(2 if tag in SPACED else 1)

    def end_within(self, tags: set[str], walls: set[str] | frozenset[str]) -> None:
        """Ends the outermost of tags that stands inside the innermost of walls."""
        wall, found = self.last(*walls), len(self.stack)
        for t in tags:
            places = self.at.get(t, ())
            if places and (i := bisect_right(places, wall)) < len(places):
                found = min(found, places[i])
        while len(self.stack) > found:
            self.pop()

    def close(self, tag: str) -> None:
        k = self.last(tag)
        if k >= 0 and (tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or k >= self.last("td", "th", "caption")):
            while len(self.stack) > k:
                self.pop()
        elif tag == "p" and self.shown():
            self.buffer.line(2)
        elif tag == "br" and self.shown():
            self.buffer.rule()

    def pop(self) -> None:
        tag, display, _, _, before, rows, _, spans = self.stack.pop()
        self.at[tag].pop()
        if not display:
            return
        if rows is not None:
            outside, self.buffer = self.buffer.value(), before
            for part in (outside, _table(rows)):
                if part:
                    self.buffer.line(2)
                    self.buffer.text(part, True)
            self.buffer.line(2)
        elif before is not None:
            cell, self.buffer = self.buffer.value(), before
            rows = self.stack[self.last("table")][5]
            if not rows:
                rows.append([])
            rows[-1].append((cell, *spans))
        elif tag in BLOCK:
            self.buffer.prefix = "" if tag == "li" else self.buffer.prefix
            self.buffer.line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and self.last("li") >= 0) else 1)

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """A tag's attributes from there on and where the tag ends, the end of the page if it never does."""
        source, out, size = self.source, {}, len(self.source)
        while at < size:
            m = NAME.match(source, at)
            at = m.end()
            if m[1] and m[2]:
                if at < size and source[at] in "\"'":
                    end = source.find(source[at], at + 1)
                    if end < 0:
                        return out, size
                    value, at = source[at + 1 : end], end + 1
                else:
                    v = BARE.match(source, at)
                    value, at = v[0], v.end()
                out.setdefault(m[1].lower(), html.unescape(value))
            elif m[1]:
                out.setdefault(m[1].lower(), "")
            elif at < size and source[at] == ">":
                return out, at + 1
            elif not m[0]:
                at += 1
        return out, size

    def render(self) -> str:
        source, at, size = self.source, 0, len(self.source)
        while m := MARK.search(source, at):
            if m.start() > at:
                self.say(source[at : m.start()])
            at = m.end()
            if m[1]:
                end = at if source.startswith(">", at) else at + 1 if source.startswith("->", at) else None
                found = COMMENT_END.search(source, at) if end is None else None
                at = end + 1 if end is not None else found.end() if found else size
                continue
            if m[2]:
                at = end + 1 if (end := source.find(">", at)) >= 0 else size
                continue
            if m[5]:
                continue
            tag = m[4].lower()
            attributes, at = self.attributes(at)
            if at == size and not source.endswith(">"):
                break  # a tag that never ends is none
            if m[3]:
                self.close(tag)
                continue
            self.open(tag, attributes)
            if tag == "plaintext":
                break
            if tag in RAW:
                end = _raw_end(tag).search(source, at)
                inner, at = source[at : end.start()], end.end()
                if tag == "style":
                    if attributes.get("media", "all").strip().lower() in ("", "all", "screen"):
                        self.style(inner)
                elif tag in ("textarea", "xmp"):
                    self.say(inner)
                self.close(tag)
        if at < size:
            self.say(source[at:])
        while self.stack:
            self.pop()
        lines = [x.rstrip() for x in self.root.value().split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")

    def say(self, s: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and s.strip():
            self.close("head")
        if self.shown():
            self.buffer.text(html.unescape(s) if "&" in s else s, bool(self.stack) and self.stack[-1][3])


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I)


def render(source: str | None) -> str:
    """The page's visible text; a style sheet that stands after some of it takes a second pass."""
    if not source:
        return ""
    page = Page(source)
    text = page.render()
    return Page(source, page.hidden_by).render() if page.late else text


def html_text(pages: DataFrame, *, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines), a row for each row of pages: all the text that a browser would show.

    Blocks stand on lines of their own, paragraphs, lists and tables with a blank line around; list items have a dash or
    their number and are indented by depth, beyond 20 levels told by number; cells are padded to their column (across
    spans of columns and rows) and parted by " | ", but for tables whose padding would be over eight times their text.
    Heads, scripts, hidden elements (attribute, style, plain rules of the page's own style sheets, wherever they stand) are
    left out. Null and
    empty pages have an empty text; broken mark-up ends where the page does, and a tag that never ends is none. Time and
    memory grow with the page's length, whatever it holds. Repeated rows and rows with a null id come back each. Other
    columns are not read, also one named text.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([render(s) for s in b.column("html").to_pylist()], pa.string())], ["id", "text"])

    own = pages.select(F.col(page_id).alias("id"), F.col(source).alias("html"))
    out = own.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", page_id)
    return out.select(page_id, "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read(spark, sf_dir, "pages"))
