"""Layout-aware rendering of HTML to text.

A tree builder reads tags, supplies the ones that authors leave out, and hands on opening, closing and text in tree
order; a renderer applies visibility rules and lays the visible text out: blocks stand on lines of their own, blocks
with margins are set off by an empty line, list items carry their mark and indent, preformatted text keeps its
blanks, and the cells of a table are padded to the widths of their columns. Both keep their own stacks, so deeply
nested pages need no recursion.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"<style\b[^>]*>(.*?)(?:</style|\Z)", re.I | re.S)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_AT_BLOCK = re.compile(r"@[^{;]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"[.#]?-?[A-Za-z_][\w-]*")

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes object datalist audio video canvas svg".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table caption ul".split())
MARGIN = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
CLOSES_P = BLOCK - frozenset("html body li dd dt option optgroup caption legend".split()) | {"hr"}
#: Opening the first closes an open element among the second, unless one among the third stands between.
IMPLIED = {
    "li": ({"li"}, LISTS | {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements whose closing tag doesn't reach beyond these.
FENCES = frozenset("table td th caption template".split())


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('open' | 'close' | 'text', tag, attributes or text) in tree order; every opened element is closed."""
    stack: list[str] = []

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            yield "close", stack.pop(), ""

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        slash, tag, rest = m.group(1), m.group(2), m.group(3)
        if tag is None:
            token = m.group()
            if token[:2] not in ("<!", "<?") or token == "<":
                if stack and stack[-1] == "head" and token.strip():
                    yield from close_to(len(stack) - 1)
                yield "text", stack[-1] if stack else "", html.unescape(token) if "&" in token else token
            continue
        tag = tag.lower()
        if slash:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] == tag:
                    yield from close_to(depth)
                    break
                if stack[depth] in FENCES and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                    break
            else:
                if tag == "br":
                    yield "open", "br", ""
            continue
        if stack and stack[-1] == "head" and tag not in HIDDEN and tag not in ("meta", "link", "base", "noscript"):
            yield from close_to(len(stack) - 1)
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] == "p":
                    yield from close_to(depth)
                    break
                if stack[depth] in FENCES or stack[depth] == "button":
                    break
        ends, fence = IMPLIED.get(tag, ((), ()))
        if ends:
            found = None
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in ends:
                    found = depth
                if stack[depth] in fence:
                    break
            if found is not None:
                yield from close_to(found)
        if tag in ("td", "th") and (not stack or stack[-1] != "tr") and "table" in stack:
            yield "open", "tr", ""
            stack.append("tr")
        yield "open", tag, rest
        if tag in VOID:
            continue
        stack.append(tag)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            if raw := page[at : end.start()]:
                yield "text", tag, html.unescape(raw) if tag in ("title", "textarea") else raw
            at = end.end()
            yield "close", stack.pop(), ""
    yield from close_to(0)


def attributes(text: str) -> dict[str, str]:
    return {m.group(1).lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTRIBUTE.finditer(text)}


class _Flow:
    """Lines of one flow of text: the page's, or a table cell's."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # a blank is due before the next word of the line
        self.gap = False  # an empty line is due before the next line
        self.indent: list[str] = []
        self.mark = ""

    def text(self, text: str) -> None:
        words = _BLANKS.split(text)
        if len(words) == 1 and words[0]:
            self._word(words[0])
            return
        for k, word in enumerate(words):
            if k:
                self.blank = True
            if word:
                self._word(word)

    def _word(self, word: str) -> None:
        if self.blank and self.now:
            self.now.append(" ")
        self.blank = False
        self.now.append(word)

    def literal(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for line in more:
            self.end_line(keep=True)
            self.now.append(line)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.now)
        self.now.clear()
        self.blank = False
        if not line.strip() and not keep:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.indent)
        if self.mark:
            lead = lead[: len(lead) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append((lead + line).rstrip())

    def block(self, margin: bool) -> None:
        self.end_line()
        self.gap |= margin


class _Table:
    """Rows of cells; a cell is a box of lines, with the columns and rows that it spans."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def _placed(self) -> list[tuple[int, int, int, int, list[str]]]:
        """(row, column, across, down, lines) of each cell, moved right of what reaches down from the rows above."""
        out = []
        reaching: list[tuple[int, int, int]] = []  # columns from, to, and the row where the cell has ended
        for r, row in enumerate(self.rows):
            reaching = sorted(x for x in reaching if x[2] > r)
            c, k = 0, 0
            fresh = []
            for lines, across, down in row:
                while k < len(reaching) and reaching[k][0] <= c:
                    c = max(c, reaching[k][1])
                    k += 1
                down = min(down, len(self.rows) - r)
                out.append((r, c, across, down, lines))
                if down > 1:
                    fresh.append((c, c + across, r + down))
                c += across
            reaching += fresh
        return out

    def lines(self) -> list[str]:
        """Boxes side by side, padded to their columns and rows; one over several columns or rows widens the last of them if it must."""
        cells = self._placed()
        widths: dict[int, int] = {}
        heights = [0] * len(self.rows)
        for span in (False, True):
            for r, c, across, down, lines in cells:
                if (across > 1) == span:
                    wide = max(map(len, lines), default=0)
                    have = sum(widths.get(c + k, 0) for k in range(across)) + 2 * (across - 1)
                    if wide > have:
                        widths[c + across - 1] = widths.get(c + across - 1, 0) + wide - have
                if (down > 1) == span and (short := len(lines) - sum(heights[r : r + down])) > 0:
                    heights[r + down - 1] += short
        starts, x = {}, 0
        named = sorted({c for _, c, _, _, _ in cells} | set(widths))
        for c in named:
            starts[c] = x
            x += widths[c] + 2 if widths.get(c) else 0
        tops, y = [], 0
        for h in heights:
            tops.append(y)
            y += h
        canvas: list[list[tuple[int, str]]] = [[] for _ in range(y)]
        for r, c, _, _, lines in cells:
            for k, line in enumerate(lines):
                if line:
                    canvas[tops[r] + k].append((starts[c], line))
        out = []
        for parts in canvas:
            line = ""
            for at, text in sorted(parts):
                line = line.ljust(at) + (" " if len(line) > at and not line.endswith(" ") else "") + text
            out.append(line)
        return out


def _span(value: str | None, most: int) -> int:
    """Columns or rows that a cell spans, within the limits of the HTML standard."""
    return min(most, max(1, int(value))) if value and value.isdecimal() and len(value) < 9 else 1


def _seen(declarations: str) -> tuple[bool | None, bool | None]:
    """(displayed, visible) as a style says; None where it says nothing. Of several declarations the last counts."""
    displayed = visible = None
    for declaration in declarations.lower().split(";"):
        name, _, value = declaration.partition(":")
        name, value = name.strip(), value.partition("!")[0].strip()
        if name == "display" and value:
            displayed = value != "none"
        elif name == "visibility" and value in ("hidden", "collapse", "visible"):
            visible = value == "visible"
    return displayed, visible


def style_rules(page: str) -> dict[str, tuple[bool | None, bool | None]]:
    """What the page's own style sheets say of display and visibility, by simple selector: a tag, .class or #id.

    Rules of other selectors and within @-blocks are left out, as whether they apply depends on more than the element.
    """
    rules: dict[str, tuple[bool | None, bool | None]] = {}
    for sheet in _STYLE.findall(page):
        plain = _AT_BLOCK.sub("", _COMMENT.sub("", sheet))
        for selectors, body in _RULE.findall(plain):
            displayed, visible = _seen(body)
            if displayed is None and visible is None:
                continue
            for selector in selectors.split(","):
                if _SIMPLE.fullmatch(name := selector.strip()):
                    name = name if name[0] in ".#" else name.lower()
                    old = rules.get(name, (None, None))
                    rules[name] = (old[0] if displayed is None else displayed, old[1] if visible is None else visible)
    return rules


def render(page: str | None) -> str:
    """The visible text of a page; '' for null or a page without visible text.

    Not shown: what the standard never shows (HIDDEN), the hidden attribute, closed dialogs, display:none, and
    visibility:hidden unless an element inside is visible again. Styles count if they stand in the element or in a
    sheet of the page under a simple selector; scripts aren't run. Contents of closed details are shown.
    """
    page = page or ""
    rules = style_rules(page) if "<style" in page.lower() else {}
    flow = _Flow()
    flows = [flow]
    tables: list[_Table] = []
    lists: list[list] = []  # [kind, number of the last item]
    hidden = pre = 0
    visible = True
    closing: list[tuple[str, bool, bool]] = []  # of each open element: its tag, whether it hides what it holds, what was visible before
    for kind, tag, value in events(page):
        if kind == "text":
            if hidden or not visible:
                continue
            if pre:
                flow.literal(value)
            elif not (tag in ("table", "tr", "thead", "tbody", "tfoot", "ul", "ol", "dl", "select") and not value.strip()):
                flow.text(value)
            continue
        if kind == "open":
            own = attributes(value) if value.strip(" /\n\t") else {}
            displayed, shown = None, None
            if rules:
                for name in (tag, *(f".{c}" for c in own.get("class", "").split()), f"#{own.get('id', '')}"):
                    found = rules.get(name, (None, None))
                    displayed, shown = displayed if found[0] is None else found[0], shown if found[1] is None else found[1]
            unseen = tag in HIDDEN or (tag == "dialog" and "open" not in own)
            if displayed is None and "hidden" in own:
                displayed = False
            if "style" in own:
                found = _seen(own["style"])
                displayed, shown = displayed if found[0] is None else found[0], shown if found[1] is None else found[1]
            unseen |= displayed is False
            if tag not in VOID:
                closing.append((tag, unseen, visible))
                hidden += unseen
            if hidden or unseen:
                continue
            before = visible
            if shown is not None:
                visible = shown
            if tag == "br":
                flow.gap |= not flow.now
                flow.end_line()
            elif tag == "hr":
                flow.block(True)
            elif tag == "input" and own.get("type", "").lower() in ("submit", "button", "reset") and visible:
                flow.text(f" {own.get('value', '')} ")
            elif tag == "table":
                flow.block(True)
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                closing[-1] = (f"{tag} {_span(own.get('colspan'), 1000)} {_span(own.get('rowspan'), 65534)}", False, before)
                flow = _Flow()
                flows.append(flow)
            elif tag in BLOCK:
                flow.block(tag in MARGIN and not (tag in LISTS and lists))
                if tag in LISTS:
                    start = own.get("start", "")
                    lists.append([tag, int(start) - 1 if start.isdecimal() and len(start) < 9 else 0])
                elif tag == "li":
                    if lists:
                        lists[-1][1] += 1
                    flow.mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                    flow.indent.append(" " * len(flow.mark))
                elif tag in ("blockquote", "dd"):
                    flow.indent.append("  ")
                pre += tag == "pre"
            if tag in VOID:
                visible = before
            continue
        name, unseen, before = closing.pop()
        if unseen:
            hidden -= 1
            visible = before
            continue
        if hidden:
            continue
        visible = before
        if name.startswith(("td ", "th ")):
            flow.end_line()
            _, across, down = name.split()
            flows.pop()
            box, flow = flow.lines, flows[-1]
            while box and not box[-1]:
                box.pop()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((box, int(across), int(down)))
        elif tag == "table" and tables:
            flow.block(True)  # what stands in a table outside its cells comes before it
            for line in tables.pop().lines():
                flow.now.append(line)
                flow.end_line(keep=True)
            flow.block(True)
        elif tag in BLOCK:
            flow.block(tag in MARGIN and not (tag in LISTS and len(lists) > 1))
            if tag in LISTS and lists:
                lists.pop()
            elif tag in ("li", "blockquote", "dd"):
                flow.indent.pop()
                flow.mark = ""
            pre -= tag == "pre"
    while len(flows) > 1:  # only if a table was torn apart
        rest = flows.pop()
        rest.end_line()
        flows[-1].lines += rest.lines
    flows[0].end_line()
    return "\n".join(flows[0].lines).strip("\n")


def rendered(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages' key columns page_id and url with text, one row for each row of pages.

    Null and empty pages give an empty text. Repeated rows keep a row each; extra columns are not read. A page is
    rendered whole, however long.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [render(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    chosen = pages.select("page_id", "url", F.col(html_col).alias("html"))
    kind = chosen.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(work, f"page_id {kind}, url string, text string")
