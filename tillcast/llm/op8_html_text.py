"""Operator 8: HTML extraction by layout-aware rendering.

A page is built into a tree with the tags that HTML lets authors leave out
(paragraphs, list items, table rows and bodies, cells, options), and the tree
is laid out as text: blocks on lines of their own, paragraphs, headings, lists
and tables apart by an empty line, list items with their marks and indents,
preformatted text as it is, and table cells in aligned columns. All visible
text is emitted; what a browser would not show is not: scripts, styles, the
head, templates, comments, elements hidden by attribute, inline style or a
simple rule of the page's own style sheets (``tag``, ``.class``, ``#id`` or a
tag with one of them), closed dialogs, and closed details but for their summary.
Rules within at-rules count where they hold for a screen of ``SCREEN``; where
that cannot be told, only what they show counts. Formulas are text like other,
and of drawings (svg) the text elements and embedded HTML are.

Edge cases: a null page gives a null text, an empty one or one without visible
text an empty text; unclosed or misnested tags never lose text; below
``MAX_DEPTH`` open elements, further ones are siblings; column widths stop at
``MAX_WIDTH`` (longer cells run over, whole); spans beyond 1,000 count as 1,000;
repeated rows are rendered each for itself.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession

from .common import first_columns, table

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = set("head script style title template noscript noembed noframes iframe datalist audio video canvas object annotation annotation-xml param".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption colgroup".split())
SPACED = set("blockquote dl figure form h1 h2 h3 h4 h5 h6 menu ol p pre table ul dir hr fieldset".split())
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption colgroup option optgroup legend".split())
#: A start tag ends these open elements, up to the elements that bound the search.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
        "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}), "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
        "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "body": ({"head"}, set()), "caption": ({"caption", "colgroup"}, {"table"})}
BOUNDARY = {"table", "td", "th", "caption", "button", "html"}
#: What of a drawing is not drawn in place; where HTML goes on within foreign elements; and the tags that end them.
UNDRAWN = set("clippath defs desc filter lineargradient marker mask metadata pattern radialgradient script style symbol title".split())
POINTS = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
                 "span strong strike sub sup table tt u ul var".split())
MAX_DEPTH, MAX_WIDTH = 200, 60
SCREEN = {"width": 1280, "height": 800}

#: A quote opens a value only right after the equals sign, and only if it is closed; elsewhere it is a plain character.
ONE = r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+("[^"]*"|'[^']*'|[^ \t\n\r\f>]*+))?+"""
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^ \t\n\r\f/>]*)((?:[ \t\n\r\f/]++|" + ONE.replace("([^", "(?:[^").replace('("[', '(?:"[') + r")*+)>", re.S)
#: For the rest of a page in which a tag was begun and never ended: quotes open nothing any more.
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^ \t\n\r\f/>]*)([^>]*)>", re.S)
BEGUN = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(ONE)
BLANKS = re.compile(r"[ \t\n\r\f]+")
CSS = re.compile(r"""\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'|[{};]""", re.S)
SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?$")


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes(text: str) -> dict:
    if "=" not in text and not text.strip(" /"):
        return {}
    return {k.lower(): html.unescape(v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v) for k, v in ATTRIBUTE.findall(text)}


def build(page: str) -> tuple[Element, list[tuple[str, bool | None]]]:
    """The tree of a page, and its style sheets, each with whether it holds for a screen."""
    root, sheets, drawn = Element("html", {}), [], False
    open_, at, size, tags, last = [root], 0, len(page), TAG, page.rfind(">")

    def close(to: int):
        del open_[to:]

    def find(names: set, bounds: set) -> int:
        """Lowest index of the open elements among ``names`` that nothing of ``bounds`` encloses, or 0."""
        got = 0
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in names:
                got = i
            elif open_[i].tag in bounds:
                break
        return got

    def foreign() -> int:
        """Index of the open svg or math that the present element is a foreign part of, or 0."""
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in ("svg", "math"):
                return i
            if open_[i].tag in POINTS:
                break
        return 0

    def push(tag: str, attrs: dict):
        node = Element(tag, attrs)
        open_[-1].children.append(node)
        if len(open_) < MAX_DEPTH:
            open_.append(node)
        return node

    while at < size:
        begin, m = page.find("<", at), None
        while begin >= 0:
            # beyond the last > nothing but an open comment is markup
            if begin < last or page.startswith("<!--", begin):
                m = tags.match(page, begin)
                if m is None and tags is TAG and BEGUN.match(page, begin):
                    # this tag goes on to the end of the page: every later one would be read to there as well
                    tags = LOOSE
                    m = tags.match(page, begin)
                if m is not None:
                    break
            begin = page.find("<", begin + 1)
        if m is None:
            open_[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            open_[-1].children.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                open_[-1].children.append(Element("br", {}))
            elif tag == "p" and not find({"p"}, BOUNDARY):
                open_[-1].children.append(Element("p", {}))
            else:
                # an end tag closes its nearest element; cells and tables keep stray ones inside
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag == tag:
                        close(i)
                        break
                    if open_[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        attrs = attributes(m[3])
        if tag == "html":
            root.attributes.update(attrs)
            continue
        if drawn and (i := foreign()):
            if tag in BREAKS_OUT:
                close(i)
            elif tag not in RAW or m[3].endswith("/"):
                if m[3].endswith("/"):
                    open_[-1].children.append(Element(tag, attrs))
                else:
                    push(tag, attrs)
                continue
        if tag in ("svg", "math"):
            drawn = True
            if m[3].endswith("/"):
                continue
        if tag in CLOSES_P and (i := find({"p"}, BOUNDARY)):
            close(i)
        if tag in ENDS and (i := find(*ENDS[tag])):
            close(i)
        elif open_[-1].tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            close(len(open_) - 1)
        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            if tag == "style":
                sheets.append((page[at:end.start()], holds(attrs.get("media", ""))))
            elif tag in ("textarea", "xmp"):
                node = Element("pre", attrs)
                node.children.append(html.unescape(page[at:end.start()]) if tag == "textarea" else page[at:end.start()])
                open_[-1].children.append(node)
            at = end.end()
        elif tag in VOID:
            open_[-1].children.append(Element(tag, attrs))
        else:
            push(tag, attrs)
    return root, sheets


def declared(style: str) -> dict:
    """Property -> (whether it is important, value); a later one wins unless only the earlier is important."""
    out: dict = {}
    for name, _, value in (d.partition(":") for d in style.split(";")):
        name, (value, _, mark) = name.strip().lower(), value.strip().lower().partition("!")
        if value and (found := (mark.strip() == "important", value.strip()))[0] >= out.get(name, (False, ""))[0]:
            out[name] = found
    return out


def top_level(body: str) -> str:
    """A rule's own declarations, without the rules within it."""
    out, start, depth = [], 0, 0
    for m in CSS.finditer(body):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= depth > 0
            if not depth:
                start = m.end()
        elif m[0] == ";" and not depth:
            out.append(body[start:m.end()])
            start = m.end()
    return "".join(out) + ("" if depth else body[start:])


def both(parts: list) -> bool | None:
    """Whether all of ``parts`` hold; None where that cannot be told."""
    return False if False in parts else None if None in parts else True


def negated(x: bool | None) -> bool | None:
    return None if x is None else not x


def feature(text: str) -> bool | None:
    """Whether one media feature, without its brackets, holds for ``SCREEN``."""
    name, _, value = (x.strip() for x in text.partition(":"))
    if name == "orientation":
        return value == "landscape" if value in ("landscape", "portrait") else None
    low, _, of = name.rpartition("-")
    number = re.fullmatch(r"(\d+(?:\.\d+)?|\.\d+)(px|em|rem)", value)
    if of not in SCREEN or low not in ("min", "max") or not number:
        return None
    size = float(number[1]) * (1 if number[2] == "px" else 16)
    return SCREEN[of] >= size if low == "min" else SCREEN[of] <= size


def holds(queries: str) -> bool | None:
    """Whether a list of media queries holds for a screen; None where that cannot be told."""
    found = []
    for query in queries.lower().split(","):
        parts = re.split(r"\s+and\s+|\s+and(?=\()|(?<=\))and\s+", query.strip())
        first = parts[0].split()
        invert = len(first) > 1 and first[0] == "not"
        if len(first) > 1 and first[0] in ("not", "only"):
            parts[0] = " ".join(first[1:])
        got = []
        for part in parts:
            if part in ("", "all", "screen"):
                got.append(True)
            elif re.fullmatch(r"[a-z-]+", part):
                got.append(False)
            else:
                inner = re.fullmatch(r"\(([^()]*)\)", part)
                got.append(feature(inner[1]) if inner else None)
        found.append(negated(both(got)) if invert else both(got))
    return negated(both([negated(x) for x in found]))


def style_rules(sheet: str, hold: bool | None):
    """(selectors, body, whether it holds) of each style rule, in order; at-rules are entered by the depth of braces."""
    open_, at, start, depth = [], 0, 0, 0
    for m in CSS.finditer(sheet):
        if m[0] == ";":
            if not depth and sheet[start:m.start()].lstrip().startswith("@"):
                start = m.end()
        elif m[0] == "{":
            head = sheet[start:m.start()].strip()
            if not depth and head.startswith("@"):
                name, _, rest = head[1:].replace("(", " (", 1).partition(" ")
                name = name.lower()
                own = holds(rest) if name == "media" else True if name == "layer" else None if name in ("supports", "container", "scope") else False
                open_.append(hold)
                hold, start = both([hold, own]), m.end()
            else:
                if not depth:
                    at = m.end()
                depth += 1
        elif m[0] == "}":
            if depth:
                depth -= 1
                if not depth:
                    yield sheet[start:at - 1], sheet[at:m.start()], hold
                    start = m.end()
            else:
                hold, start = open_.pop() if open_ else hold, m.end()
    if depth:  # the end of a sheet closes what is open
        yield sheet[start:at - 1], sheet[at:], hold


def rules(sheets: list[tuple[str, bool | None]]) -> dict:
    """By simple selector, property -> (important, specificity, order, value) of the rule that wins."""
    out: dict = {}
    order = 0
    for sheet, hold in sheets:
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S).replace("<!--", " ").replace("-->", " ")
        for selectors, body, holding in style_rules(sheet, hold):
            order += 1
            set_ = {k: v for k, v in declared(top_level(body) if "{" in body else body).items() if k in ("display", "visibility")}
            if holding is None:
                set_ = {k: v for k, v in set_.items() if v[1] not in ("none", "hidden", "collapse")}
            if set_ and holding is not False:
                for s in selectors.split(","):
                    if (m := SELECTOR.match(s.strip())) and s.strip():
                        own = out.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {})
                        weight = (("", ".", "#").index(m[2] or ""), bool(m[1]))
                        for name, (important, value) in set_.items():
                            own[name] = max(own.get(name, (False,)), (important, weight, order, value))
    return out


INLINE = (3, False)


def styled(node: Element, sheet: dict) -> dict:
    """display and visibility of an element by importance, then specificity (its
    own style before id, class and tag), then order of the rules."""
    out: dict = {}
    if sheet:
        names = [("", "")] + [(".", c) for c in node.attributes.get("class", "").split()] + [("#", node.attributes.get("id", ""))]
        for kind, name in names:
            for tag in ("", node.tag):
                if (tag or kind) and (found := sheet.get((tag, kind, name))):
                    for k, v in found.items():
                        out[k] = max(out.get(k, (False,)), v)
    if "style" in node.attributes:
        for k, (important, value) in declared(node.attributes["style"]).items():
            out[k] = max(out.get(k, (False,)), (important, INLINE, 0, value))
    return {k: v[3] for k, v in out.items()}


class Flow:
    """Lines of laid out text."""

    def __init__(self):
        self.lines, self.now, self.apart, self.indent, self.mark = [], "", 0, 0, ""

    def begin(self):
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = 0
        if not self.now:
            self.now = " " * (self.indent - len(self.mark)) + self.mark if self.mark else " " * self.indent
            self.mark, self.fresh = "", True

    def text(self, s: str):
        s = BLANKS.sub(" ", s)
        if not self.now:
            s = s.lstrip(" ")
            if not s:
                return
            self.begin()
            self.now += s
        else:
            self.now += s.lstrip(" ") if self.now[-1] == " " else s

    def line(self):
        if self.now:
            self.lines.append(self.now.rstrip(" "))
            self.now = ""

    def block(self, apart: int):
        self.line()
        self.apart = max(self.apart, apart)

    def rows(self, lines: list[str]):
        """Lines as they are, at the present indent."""
        for s in lines:
            self.line()
            if s.strip():
                self.begin()
                self.now += s.rstrip()
                self.lines.append(self.now)
                self.now = ""
            else:
                self.apart = 1 if self.lines else 0

    def done(self) -> list[str]:
        self.line()
        return self.lines


def span(node: Element, name: str) -> int:
    value = node.attributes.get(name, "1")
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() else 1


def table_lines(node: Element, sheet: dict, visible: bool) -> list[str]:
    """A table's captions, then its rows with cells in aligned columns."""
    captions, rows, stray = [], [], Flow()

    def collect(of: Element, shown: bool):
        for child in of.children:
            if isinstance(child, str):
                if child.strip():
                    lay(child, stray, sheet, shown, False, 0)
                continue
            style = styled(child, sheet)
            if child.tag in HIDDEN or "hidden" in child.attributes or style.get("display") == "none":
                continue
            see = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), shown)
            if child.tag == "caption":
                flow = Flow()
                lay(child, flow, sheet, see, False, 0)
                captions.extend(flow.done())
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                collect(child, see)
            elif child.tag == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, str) and not cell.strip():
                        continue
                    flow = Flow()
                    lay(cell, flow, sheet, see, False, 0)
                    got = flow.done()
                    if not isinstance(cell, str) and (cell.tag in HIDDEN or "hidden" in cell.attributes or styled(cell, sheet).get("display") == "none"):
                        continue
                    cells.append((got, *((span(cell, "colspan"), span(cell, "rowspan")) if not isinstance(cell, str) else (1, 1))))
                rows.append(cells)
            else:
                lay(child, stray, sheet, see, False, 0)

    collect(node, visible)
    taken: list[tuple[int, int, int]] = []  # columns (first, behind the last) that cells of rows above hold for so many rows more
    placed, widths = [], {}
    for cells in rows:
        at, row, k, own = 0, [], 0, []
        for lines, across, down in cells:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            row.append((at, lines))
            widths[at] = max(widths.get(at, 0), min(MAX_WIDTH, max(map(len, lines), default=0)) if across == 1 else 0)
            if down > 1:
                if own and own[-1][1:] == (at, down - 1):
                    own[-1] = (own[-1][0], at + across, down - 1)
                else:
                    own.append((at, at + across, down - 1))
            at += across
        taken = sorted([*((a, b, n - 1) for a, b, n in taken if n > 1), *own]) if taken or own else taken
        placed.append(row)
    starts, x = {}, 0
    for c in sorted(widths):
        starts[c] = x
        x += widths[c] + 2 if widths[c] else 0
    out = stray.done() + captions
    for row in placed:
        for k in range(max([len(lines) for _, lines in row], default=0)):
            text = ""
            for c, lines in row:
                if k < len(lines) and lines[k]:
                    text = text.ljust(starts[c])
                    text += ("  " if text and text[-1] != " " else "") + lines[k]
            out.append(text)
    return out


def draw(node: Element, flow: Flow, sheet: dict, visible: bool) -> None:
    """Lays the text elements of a drawing out, apart by blanks."""
    for child in node.children:
        if isinstance(child, str) or child.tag in UNDRAWN:
            continue
        style = {k: v for k, v in child.attributes.items() if k in ("display", "visibility")} | styled(child, sheet)
        if style.get("display") == "none":
            continue
        see = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), visible)
        if child.tag in ("text", "foreignobject"):
            flow.text(" ")
            lay(child, flow, sheet, see, False, 0)
            flow.text(" ")
        else:
            draw(child, flow, sheet, see)


def lay(node, flow: Flow, sheet: dict, visible: bool, preserved: bool, depth: int) -> None:
    """Lays a node out at the end of ``flow``."""
    if isinstance(node, str):
        if visible:
            if preserved:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                if first:
                    flow.begin() if not flow.now else None
                    flow.now += first
                for s in rest:
                    if not flow.now:
                        flow.begin()
                        flow.lines.append("")
                    flow.line()
                    if s:
                        flow.begin()
                        flow.now += s
            else:
                flow.text(node)
        return
    tag = node.tag
    if tag in HIDDEN or "hidden" in node.attributes or tag == "dialog" and "open" not in node.attributes:
        return
    style = styled(node, sheet) if sheet or "style" in node.attributes else {}
    display = style.get("display")
    if display == "none":
        return
    visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), visible)
    if tag == "br":
        if visible:
            if flow.now:
                flow.line()
            elif flow.lines:
                flow.apart = 1
        return
    if tag == "table":
        flow.block(1)
        flow.rows(table_lines(node, sheet, visible))
        flow.block(1)
        return
    if tag == "svg":
        draw(node, flow, sheet, visible)
        return
    block = (tag in BLOCK and display != "inline") or display in ("block", "flex", "grid", "list-item")
    if block:
        flow.block(1 if tag in SPACED and not (depth and tag in ("ul", "ol", "menu", "dir")) else 0)
    indent, inside = flow.indent, depth
    if tag in ("ul", "ol", "menu", "dir"):
        inside += 1
    elif tag in ("blockquote", "dd"):
        flow.indent += 2
    preserved = preserved or tag == "pre"
    number = int(node.attributes["start"]) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attributes.get("start", "")) else 1
    children = node.children
    if tag == "details" and "open" not in node.attributes:
        children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
    if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
        children = [children[0][1:], *children[1:]]
    for child in children:
        if isinstance(child, Element) and child.tag == "li":
            mark = f"{number}. " if tag == "ol" else "- "
            number += 1
            flow.block(0)
            flow.indent, flow.mark = indent + len(mark), mark
            lay(child, flow, sheet, visible, preserved, inside)
            flow.line()
            flow.indent, flow.mark = indent, ""
        else:
            lay(child, flow, sheet, visible, preserved, inside)
            if tag == "mfrac" or tag == "mtr":
                flow.text(" ")
            elif tag == "mtable":
                flow.line()
    flow.indent = indent
    if block:
        flow.block(1 if tag in SPACED and not (depth and tag in ("ul", "ol", "menu", "dir")) else 0)
    elif tag in ("option", "button", "select"):
        flow.text(" ")


def render(page: str) -> str:
    """All visible text of a page, laid out."""
    root, sheets = build(page)
    flow = Flow()
    lay(root, flow, rules(sheets), True, False, 0)
    return "\n".join(flow.done()).replace("\xa0", " ").strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of each page."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if (page := x.as_py()) is None else render(page) for x in batch.column(1)], pa.string())], names=["page_id", "text"])
    pages = first_columns(pages, page_id=id_col, html=html_col)
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
