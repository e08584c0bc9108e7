"""Layout-aware rendering of HTML: all visible text, with blocks, lists and aligned tables.

The tree builder supplies the tags that HTML lets authors leave out and closes what a new
element ends; it hands open, text and close events to a renderer that keeps a stack, so
depth of nesting is no limit. Invisible elements are left out with all they hold.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head script style template noscript title svg math iframe object audio video canvas datalist select textarea".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset address".split())
LINES = frozenset(
    "html body div section article main nav header footer aside form li dt dd tr caption figcaption hr details summary legend".split()
)

#: A new element ends an open one of these, looked for up to the named borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
BORDERS = frozenset({"table", "td", "th", "caption", "button", "html", "body"})
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
IN_HEAD = frozenset("title style script meta link base noscript template".split())

#: Parts of a table; end tags of others do not reach out of a cell.
OF_TABLE = frozenset("td th tr table thead tbody tfoot body html".split())

#: Rules of a style sheet outside of blocks for other media, and selectors that name one
#: element, class or id.
AT_BLOCK = re.compile(r"/\*.*?\*/|@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", re.S)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)

#: Levels of indentation that are shown, and the widest cell that others are padded to: what
#: is rendered stays in proportion to the page.
INDENTS, PADDED = 64, 200


class Sheet:
    """Lines of one block of text; blank lines only between paragraphs."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent: list[str] = []
        self.mark = ""

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._put(first)
            for part in rest:
                self._end(True)
                self._put(part)
            return
        words = text.split()
        if not words:
            self.space = self.space or bool(text)
            return
        if self.line and (self.space or text[0].isspace()):
            self._put(" ")
        self._put(" ".join(words))
        self.space = text[-1].isspace()

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indent[:INDENTS])
            self.line.append(lead[: len(lead) - len(self.mark)] + self.mark if self.mark else lead)
            self.mark = ""
        self.line.append(text)

    def _end(self, keep: bool = False) -> None:
        if self.line or keep:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def end_line(self) -> None:
        self._end()

    def end_block(self) -> None:
        self._end()
        self.blank = True

    def text(self) -> str:
        self._end()
        return "\n".join(self.lines).strip("\n")


class Renderer:
    def __init__(self):
        self.sheets = [Sheet()]
        self.tables: list[list[list[str]]] = []
        self.lists: list[int | None] = []
        self.hidden = self.kept = 0
        self.rules: set[tuple[str, str, str]] = set()

    def styled(self, sheet: str) -> None:
        """Selectors of one element, class or id that a style sheet hides."""
        for selectors, body in RULE.findall(AT_BLOCK.sub(" ", sheet)):
            if HIDDEN_STYLE.search(body):
                for one in selectors.split(","):
                    found = SELECTOR.fullmatch(one.strip())
                    if found and one.strip():
                        self.rules.add(tuple((x or "").lower() if i == 0 else x or "" for i, x in enumerate(found.groups())))

    def _by_rule(self, tag: str, attrs: dict) -> bool:
        if not self.rules:
            return False
        names = [("", "")] + [(".", c) for c in (attrs.get("class") or "").split()]
        names += [("#", attrs["id"])] if attrs.get("id") else []
        return any((t, *n) in self.rules for t in (tag, "") for n in names)

    def open(self, tag: str, attrs: dict) -> None:
        style = attrs.get("style") or ""
        never = tag in NEVER or "hidden" in attrs or HIDDEN_STYLE.search(style)
        if self.hidden or never or self._by_rule(tag, attrs):
            self.hidden += tag not in VOID
            return
        sheet = self.sheets[-1]
        if tag == "br":
            if not sheet.line and sheet.lines:
                sheet.blank = True
            sheet.end_line()
        elif tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.lists):
            sheet.end_block()
        elif tag in LINES or tag in ("ul", "ol"):
            sheet.end_line()
        if tag in ("ul", "ol"):
            start = attrs.get("start") or "1"
            digits = start.lstrip("-").isdigit() and len(start) < 10
            self.lists.append((int(start) if digits else 1) if tag == "ol" else None)
        elif tag == "li":
            at = self.lists[-1] if self.lists else None
            sheet.mark = "- " if at is None else f"{at}. "
            sheet.indent.append(" " * len(sheet.mark))
            if at is not None:
                self.lists[-1] = at + 1
        elif tag in ("blockquote", "dd"):
            sheet.indent.append("  ")
        elif tag == "pre":
            self.kept += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.sheets.append(Sheet())

    def close(self, tag: str) -> None:
        if self.hidden:
            self.hidden -= 1
            return
        if tag in ("td", "th") and self.tables and len(self.sheets) > 1:
            # A cell is one line, so columns stay aligned.
            cell = " ".join(self.sheets.pop().text().split())
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(cell)
            return
        sheet = self.sheets[-1]
        if tag == "table" and self.tables:
            sheet.end_block()
            for line in aligned(self.tables.pop()):
                sheet._put(line)
                sheet.end_line()
            sheet.end_block()
        elif tag in PARAGRAPHS and not (tag in ("ul", "ol") and len(self.lists) > 1):
            sheet.end_block()
        elif tag in LINES or tag in ("ul", "ol"):
            sheet.end_line()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("li", "blockquote", "dd") and sheet.indent:
            sheet.indent.pop()
            sheet.mark = ""
        elif tag == "pre":
            self.kept -= 1

    def text(self, data: str) -> None:
        if not self.hidden:
            self.sheets[-1].write(data, bool(self.kept))


def aligned(rows: list[list[str]]) -> list[str]:
    """Cells padded to the width of their column; very wide ones stand out of it."""
    rows = [r for r in rows if any(r)]
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row):
            if len(cell) <= PADDED:
                widths[i] = max(widths[i], len(cell))
    return [" | ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in rows]


class Builder(HTMLParser):
    """Keeps the stack of open elements and supplies the tags that may be left out.

    The places of each tag in the stack are kept as well, so no step walks the stack, however
    deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.out = Renderer()

    def _push(self, tag: str, attrs: dict) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append(tag)
        self.out.open(tag, attrs)

    def _pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.stack.pop()
            self.places[tag].pop()
            self.out.close(tag)

    def _last(self, *tags: str) -> int:
        """Place of the innermost of these, -1 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _end_open(self, ended: set[str], borders: set[str]) -> None:
        border = self._last(*borders)
        inside = []
        for tag in ended:
            own = self.places.get(tag) or []
            at = bisect_right(own, border)
            inside += own[at : at + 1]
        if inside:
            self._pop_to(min(inside))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and tag not in ("html", "head") and self.stack and self.stack[-1] == "head":
            self._pop_to(len(self.stack) - 1)
        if tag in IMPLIED:
            self._end_open(*IMPLIED[tag])
        if tag in PARAGRAPHS or tag in LINES:
            self._end_open({"p"}, BORDERS)
        if tag in ("td", "th", "tr") and self._last("table") < 0:
            return
        if tag in ("td", "th") and self._last("tr") < self._last("table"):
            self._push("tr", {})
        if tag in VOID:
            self.out.open(tag, dict(attrs))
        else:
            self._push(tag, dict(attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._last(tag)
        if at >= 0 and (tag in OF_TABLE or self._last("td", "th", "table") <= at):
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1] == "head" and data.strip():
            self._pop_to(len(self.stack) - 1)
        if self.stack and self.stack[-1] == "style":
            self.out.styled(data)
        self.out.text(data)


def rendered(html: str | None) -> str:
    """Visible text of a page; null has none."""
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    builder._pop_to(0)
    return builder.out.sheets[0].text()


def render(html: Column) -> Column:
    def batch(pages: pa.Array) -> pa.Array:
        return pa.array([rendered(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(batch, T.StringType())(html)


def extract(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: key, visible text, its lines and characters.

    Hidden are elements by attribute, by their own style, and by rules of the page's style
    sheets that name one element, class or id; what they hold is hidden with them, also
    where it asks to be visible. Cells that span columns or rows count as one cell. Null and
    empty pages give empty text; broken markup is repaired as far as the implied tags go and
    its text kept; repeated rows stay repeated; an empty table gives an empty result.
    """
    out = pages.select(F.col(key).alias(key), render(F.col(html)).alias("visible_text"))
    lines = F.when(F.col("visible_text") == "", 0).otherwise(F.size(F.split("visible_text", "\n")))
    return out.withColumn("n_lines", lines.cast("long")).withColumn(
        "n_chars", F.length("visible_text").cast("long")
    )
