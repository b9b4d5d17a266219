"""Layout-aware text of web pages.

A page is parsed to a tree with the implied tags of HTML (open paragraphs, list items,
rows, cells, options and headings are closed where a new one begins; a cell outside a row
gets one; text between rows goes before its table), and the tree is laid out as text: what
is not shown is left out, blocks keep their spacing, lists their markers and nesting, and
table cells their columns. Formulas and the text elements of drawings are words of their line.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import read

END_TAG = re.compile(r"/([a-zA-Z][^\s/>]*)[^>]*+>?")
NAME_START, NAME_END = re.compile("[a-zA-Z]"), re.compile(r"[\s/>]")
ATTRS = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"(?:[a-z][a-z0-9]*|[.#][\w-]+)\Z", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

#: The element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta title style script noscript template".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas annotation annotation-xml datalist colgroup".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
CLOSES_P = BLOCK - frozenset("body html legend option optgroup td th tr tbody thead tfoot caption".split())
#: A blank line stands before and after these.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
#: start tag -> what it closes, and where the search for that stops
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
}
#: An end tag does not look beyond these, unless it is one of the table's own.
BARRIER = frozenset("table td th caption".split())
TABLE_OWN = frozenset("table tbody thead tfoot tr td th caption body html".split())
BETWEEN_CELLS = frozenset("table tbody thead tfoot tr".split())
#: Elements nested deeper are blocks without a layout of their own (no lists, tables or indentation); what hides them counts.
DEPTH = 512
#: Of a drawing only the text elements are text, and nothing within these is shown where it stands.
UNDRAWN = frozenset("defs desc metadata symbol marker pattern clippath mask".split())
#: Elements of HTML end an open drawing or formula, unless they are within one of these.
FOREIGN = frozenset("svg math".split())
HTML_WITHIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, value in ATTR.findall(self.attrs):
            out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
        return out


class Deep(Node):
    """An element more than DEPTH deep."""

    __slots__ = ()


class Ends:
    """Where the markup that begins at a place of a page ends, in time linear in the page over all its places.

    A terminator that does not follow is looked for once, and where tags end is worked out
    from the end of the page for all places together, once a tag without an end is met.
    """

    def __init__(self, page: str):
        self.page, self.lacking, self.marks, self.ends, self.name_end = page, set(), None, [], 0

    def find(self, what: str, at: int) -> int:
        if what in self.lacking:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.lacking.add(what)
        return k

    def name(self, at: int) -> int:
        """Where the name of a tag ends that begins at `at`; places are asked for in order."""
        if self.name_end < at:
            m = NAME_END.search(self.page, at)
            self.name_end = m.start() if m else len(self.page)
        return self.name_end

    def tag(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at `at`, outside quotes; -1 if there is none."""
        if self.marks is None:
            if m := ATTRS.match(self.page, at):
                return m.end(1)
            self.marks = [m.start() for m in re.finditer("[>\"']", self.page)]
            self.ends = [-1] * (len(self.marks) + 1)
            after = {"'": -1, '"': -1}
            for k in range(len(self.marks) - 1, -1, -1):
                c = self.page[self.marks[k]]
                if c == ">":
                    self.ends[k] = self.marks[k]
                else:
                    # from behind the quote that closes this one
                    self.ends[k] = self.ends[after[c] + 1] if after[c] >= 0 else -1
                    after[c] = k
        return self.ends[bisect_left(self.marks, at)]


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style elements. A < that begins no markup, or none with an end, is text."""
    root = Node("html")
    stack, styles, ends, opened = [root], [], Ends(page), Counter()
    # elements over DEPTH: they are not searched through, so that a page of any depth takes linear time
    deep, deep_opened = [], Counter()

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]
        deep.clear()
        deep_opened.clear()

    def sink(node: Node) -> None:
        """Opens an element over DEPTH; one like the element it is in is that element."""
        if not (deep and deep[-1].tag == node.tag and not node.attrs):
            place(node)
            deep.append(node)
        else:
            deep.append(deep[-1])
        deep_opened[node.tag] += 1

    def rise(tag: str) -> None:
        """Closes what is open over DEPTH down to the last element of a tag."""
        while deep_opened[tag]:
            last = deep.pop().tag
            deep_opened[last] -= 1
            if last == tag:
                return

    def close_to(tags: frozenset, stop: frozenset) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                cut(k)
                return
            if stack[k].tag in stop:
                return

    def place(node) -> None:
        top = deep[-1] if deep else stack[-1]
        if not deep and top.tag in BETWEEN_CELLS and (isinstance(node, (str, Deep)) or node.tag not in TABLE_OWN and node.tag not in UNSEEN):
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table"), 0)
            if k:
                siblings = stack[k - 1].children
                siblings.insert(len(siblings) - 1, node)
                return
        top.children.append(node)

    def text(s: str) -> None:
        if s and (s.strip() or deep or stack[-1].tag not in BETWEEN_CELLS):
            if stack[-1].tag == "head" and s.strip():
                cut(len(stack) - 1)
            place(html.unescape(s) if "&" in s else s)

    def foreign() -> bool:
        return next((n.tag in FOREIGN for n in reversed(stack) if n.tag in FOREIGN or n.tag in HTML_WITHIN), False)

    def end(tag: str) -> None:
        if deep_opened[tag]:
            rise(tag)
        elif tag == "p" and not opened["p"]:
            place(Node("p"))
        elif tag == "br":
            place(Node("br"))
        elif tag in HEADINGS:
            close_to(HEADINGS, BARRIER)
        elif tag not in ("body", "html"):
            close_to(frozenset([tag]), frozenset(["table"]) - {tag} if tag in TABLE_OWN else BARRIER)

    def start(tag: str, attrs: str, at: int) -> int:
        """Opens an element; gives the place behind what belongs to its tag."""
        nonlocal drawn
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                cut(len(stack) - 1)
            if tag == "body" and attrs:
                root.attrs += attrs
            return at
        if stack[-1].tag == "head" and tag not in HEAD:
            cut(len(stack) - 1)
        drawn = drawn or tag in FOREIGN
        while drawn and tag in BREAKOUT and foreign():
            cut(len(stack) - 1)
        if deep:
            if tag in IMPLIED and deep[-1].tag in IMPLIED[tag][0] or tag in CLOSES_P and deep[-1].tag == "p":
                rise(deep[-1].tag)
        elif tag in IMPLIED:
            close_to(*IMPLIED[tag])
        if tag in CLOSES_P and not deep:
            close_to(frozenset(["p"]), BARRIER | {"button"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS and not deep:
            cut(len(stack) - 1)
        if not deep and tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        opens = tag not in RAW and tag not in VOID and not (drawn and attrs.endswith("/") and (tag in FOREIGN or foreign()))
        if opens and len(stack) >= DEPTH:
            sink(Deep(tag, attrs))
            return at
        node = Node(tag, attrs)
        place(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(page, at) if f"</{tag}" not in ends.lacking else None
            if not close:
                ends.lacking.add(f"</{tag}")
            inner = page[at : close.start() if close else len(page)]
            if tag == "style":
                styles.append(inner)
            node.children.append(html.unescape(inner) if tag == "textarea" else inner)
            return close.end() if close else len(page)
        if opens:
            push(node)
        return at

    at, told, drawn = 0, 0, False  # told: up to where all is in the tree
    while (at := page.find("<", at)) >= 0:
        what = page[at + 1 : at + 2]
        behind, act = -1, None
        if page.startswith("<!--", at):
            k = ends.find("-->", at + 4)
            behind = k + 3 if k >= 0 else len(page)
        elif page.startswith("<![CDATA[", at) and (k := ends.find("]]>", at + 9)) >= 0:
            behind, act = k + 3, lambda a=at + 9, k=k: text(page[a:k])
        elif what == "/" and (m := END_TAG.match(page, at + 1)):
            behind, act = m.end(), lambda m=m: end(m[1].lower())
        elif what and what in "!?/":
            k = ends.find(">", at)
            behind = k + 1 if k >= 0 else len(page)
        elif NAME_START.match(what):
            name_end = ends.name(at + 1)
            if (k := ends.tag(name_end)) >= 0:
                behind, act = k + 1, lambda a=at + 1, b=name_end, k=k: start(page[a:b].lower(), page[b:k], k + 1)
        if behind < 0:
            at += 1
            continue
        text(page[told:at])
        at = told = (act and act()) or behind
    text(page[told:])
    return root, styles


def declared(style: str) -> dict[str, str]:
    return {k.strip().lower(): v.replace("!important", "").strip().lower() for k, _, v in (d.partition(":") for d in style.split(";"))}


def hiding(styles: list[str]) -> dict[str, dict[str, str]]:
    """Of the style sheets' rules for a single tag, class or id, those about display and visibility."""
    out: dict[str, dict[str, str]] = {}
    for sheet in styles:
        if "display" in sheet or "visibility" in sheet:
            for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
                said = {k: v for k, v in declared(body).items() if k in ("display", "visibility")}
                for s in selectors.split(",") if said else ():
                    if SIMPLE.match(s := s.strip()):
                        out.setdefault(s if s[0] in ".#" else s.lower(), {}).update(said)
    return out


def wrapped(line: str, wide: int) -> list[str]:
    """A line as lines of at most `wide` characters, cut at spaces; a longer word is a line of its own."""
    if len(line) <= wide:
        return [line]
    indent = line[: len(line) - len(line.lstrip(" "))]
    out, now = [], indent
    for word in line.split(" "):
        if not word:
            continue
        if now != indent and len(now) + 1 + len(word) > wide:
            out.append(now)
            now = indent
        now += word if now == indent else " " + word
    return [*out, now]


class Layout:
    """Lines of text, with the indentation and the marker that the next line begins with."""

    def __init__(self, rules: dict[str, dict[str, str]]):
        self.rules, self.lines, self.line, self.gap = rules, [], [], 0
        self.indent, self.marker, self.space = "", None, False

    def end_line(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        if self.lines:
            self.gap = max(self.gap, gap)

    def begin(self) -> None:
        if not self.line:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.line.append(self.marker if self.marker is not None else self.indent)
            self.marker = None
            self.space = False

    def put(self, s: str) -> None:
        """Text of a line, with its white space collapsed."""
        s = SPACE.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s and self.line)
            return
        lead = (s[0] == " " or self.space) and bool(self.line)
        self.begin()
        if lead and len(self.line) > 1:
            self.line.append(" ")
        self.line.append(s.strip(" "))
        self.space = s[-1] == " "

    def put_lines(self, lines: list[str]) -> None:
        """Lines as they are."""
        for x in lines:
            self.begin()
            self.line.append(x)
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []

    def seen(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether the element is displayed, and whether its own text is visible."""
        attrs = node.attributes() if node.attrs else {}
        if node.tag in UNSEEN or "hidden" in attrs or node.tag == "input" or node.tag == "dialog" and "open" not in attrs:
            return False, visible
        said: dict[str, str] = {}
        if self.rules:
            for key in (node.tag, *(f".{c}" for c in attrs.get("class", "").split()), f"#{attrs.get('id', '')}"):
                said.update(self.rules.get(key, {}))
        if "style" in attrs:
            said.update(declared(attrs["style"]))
        visible = {"hidden": False, "collapse": False, "visible": True}.get(said.get("visibility"), visible)
        return said.get("display") != "none", visible

    def walk(self, node: Node, visible: bool = True, pre: bool = False) -> None:
        number = None
        if node.tag == "ol":
            start = node.attributes().get("start", "1")
            number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str):
                if visible and pre:
                    first, *more = child.expandtabs().split("\n")
                    if first:
                        self.begin()
                        self.line.append(first)
                    for x in more:
                        self.begin()
                        self.end_line()
                        if x:
                            self.begin()
                            self.line.append(x)
                elif visible:
                    self.put(child)
                continue
            shown, sees = self.seen(child, visible)
            if not shown:
                continue
            if isinstance(child, Deep):
                if child.tag in BLOCK:
                    self.end_line()
                self.walk(child, sees, pre)
                if child.tag in BLOCK:
                    self.end_line()
                continue
            tag = child.tag
            if tag == "br":
                if not self.line:
                    self.gap += bool(self.lines)
                self.end_line()
            elif tag == "svg":
                self.drawing(child, sees)
            elif tag == "table":
                self.end_line(1)
                self.put_lines(self.table(child, sees))
                self.end_line(1)
            elif tag == "li":
                marker = "- "
                if number is not None:
                    value = child.attributes().get("value", "") if child.attrs else ""
                    number = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else number
                    marker, number = f"{number}. ", number + 1
                self.end_line()
                before = self.indent
                # an item whose first child is a list keeps its own marker for that list's first line
                self.marker = (self.marker if self.marker is not None else before) + marker
                self.indent = before + " " * len(marker)
                self.walk(child, sees, pre)
                self.end_line()
                self.indent, self.marker = before, None
            elif tag in BLOCK:
                inside = tag in LISTS and node.tag == "li"
                gap = 1 if tag in SPACED and not inside else 0
                self.end_line(gap)
                before = self.indent
                if tag in ("blockquote", "dd"):
                    self.indent += "  "
                self.walk(child, sees, pre or tag in ("pre", "xmp"))
                self.end_line(gap)
                self.indent = before
            else:
                self.walk(child, sees, pre or tag == "textarea")

    def drawing(self, node: Node, visible: bool, text: bool = False) -> None:
        """The text elements of a drawing, as words of the line, and the HTML within it."""
        for child in node.children:
            if isinstance(child, str):
                if text and visible:
                    self.put(child)
                continue
            shown, sees = self.seen(child, visible)
            if not shown or child.tag in UNDRAWN:
                continue
            apart = child.tag in ("text", "foreignobject")
            if apart:
                self.put(" ")
            if child.tag == "foreignobject":
                self.walk(child, sees)
            else:
                self.drawing(child, sees, text or child.tag == "text")
            if apart:
                self.put(" ")

    def table(self, node: Node, visible: bool, wide: int = 60) -> list[str]:
        """The lines of a table; a column is as wide as its widest cell.

        A cell that others follow in its row is wrapped at `wide` characters, as it would be
        on a page; only a single word that is longer keeps what follows it from its column.
        """
        out, rows, todo = [], [], [(node, visible)]
        for part, sees in todo:
            for child in part.children:
                if isinstance(child, str):
                    continue
                shown, seen = self.seen(child, sees)
                if not shown:
                    continue
                if child.tag == "caption":
                    out += self.inner(child, seen)
                elif child.tag == "tr":
                    row: list[list[str]] = []
                    for cell in child.children:
                        if isinstance(cell, Node) and cell.tag in ("td", "th"):
                            ok, own = self.seen(cell, seen)
                            span = cell.attributes().get("colspan", "1") if cell.attrs else "1"
                            row.append(self.inner(cell, own) if ok else [])
                            row += [[]] * (min(int(span), 1000) - 1 if re.fullmatch(r"[0-9]{1,4}", span) else 0)
                    rows.append(row)
                elif child.tag in ("tbody", "thead", "tfoot"):
                    todo.append((child, seen))
        widths: list[int] = []
        for row in rows:
            last = max((k for k, cell in enumerate(row) if cell), default=-1)
            widths += [0] * (last + 1 - len(widths))
            for k in range(last + 1):
                row[k] = [y for x in row[k] for y in wrapped(x, wide)] if k < last else row[k]
                widths[k] = max([widths[k], *(len(x) for x in row[k] if len(x) <= wide)])
            del row[last + 1 :]
        for row in rows:
            for i in range(max(map(len, row), default=0)):
                line = [(cell[i] if i < len(cell) else "").ljust(widths[k] if k < len(row) - 1 else 0) for k, cell in enumerate(row)]
                out.append("  ".join(line).rstrip())
        return out

    def inner(self, node: Node, visible: bool) -> list[str]:
        own = Layout(self.rules)
        own.walk(node, visible)
        own.end_line()
        return own.lines


def render(page: str | None) -> str:
    """The visible text of a page; null and empty pages have none."""
    if not page:
        return ""
    root, styles = parse(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�"))
    layout = Layout(hiding(styles))
    shown, visible = layout.seen(root, True) if root.attrs else (True, True)
    usual = sys.getrecursionlimit()
    try:  # a call for each level of the tree at most, and its frames are on the heap
        sys.setrecursionlimit(usual + 4 * page.count("<"))
        if shown:
            layout.walk(root, visible)
    finally:
        sys.setrecursionlimit(usual)
    layout.end_line()
    return "\n".join(layout.lines).replace("\xa0", " ")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines of each row; a null or empty page has the empty text.

    Null ids stay null, repeated rows give repeated results, other columns are not read,
    an empty table gives no rows. Style rules count if they are inline or for one tag,
    class or id; scripts do not run. Elements nested over `DEPTH` deep are
    plain blocks, and hidden if they or what they are in is hidden.
    One narrow pass without a shuffle; pages of any length take time linear in their
    length, broken ones too, and a page is in memory with its tree.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [render(x) for x in b["html"]]
            yield pd.DataFrame({
                "page_id": b["page_id"].astype("Int64"),
                "text": texts,
                "n_chars": [len(x) for x in texts],
                "n_lines": [x.count("\n") + 1 if x else 0 for x in texts],
            })

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInPandas(extract, "page_id long, text string, n_chars long, n_lines long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
