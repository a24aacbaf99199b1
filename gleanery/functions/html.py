"""HTML repair: the one step Spark's XML functions cannot do for themselves.

Real pages are not well-formed, and Spark's ``xpath*`` functions only read XML.
``repair`` is an Arrow function that rewrites each page once into a small
well-formed document; every selector then runs on the JVM.

The rewrite is a single pass over the tags with a stack. It follows the parts of
the HTML parsing rules that change where an element ends up: implied end tags,
paragraphs closed by blocks, formatting elements reopened after such a close,
implied table rows, one html/head/body. Script and style text is left out unless asked
for, since it is never rendered. An element that is not rendered carries ``_hid="1"``.

A tag that never ends, up to the end of the page, is text, and so is every start tag after it.
Elements nest up to ``MAX_DEPTH``, as in browsers; deeper ones are closed early. Where the XML
parser's own limits are in force (see ``session.raise_xml_limits``), longer names and more
attributes than it takes are left out. Formatting that is reopened again and again may add a few
times the page's size, then no more of it is reopened. A document that something was left out of or
closed early carries ``_cut="1"`` on its root; see :func:`is_cut`.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict
from html import unescape
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleanery.session import bound_batches, raise_xml_limits

HIDDEN_MARK = "_hid"

CUT_MARK = "_cut"

# Browsers stop nesting at this depth; an XML parser with its default limits refuses longer names
# and more attributes on one element.
MAX_DEPTH, MAX_NAME, MAX_ATTRIBUTES = 512, 1000, 9000
# What reopened formatting elements may add: so many characters, and so many times those of the page.
REOPENED_FREE, REOPENED_TIMES = 1 << 16, 6

# Element groups of the HTML standard.
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_ESCAPABLE_RAW = frozenset("title textarea".split())
_NOT_RENDERED = frozenset("head title meta link base script style template noscript noframes".split())
_HEAD_ONLY = frozenset("title meta link base script style noscript template".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search"
    " section summary table ul xmp".split()
)
_SCOPE_END = frozenset("html body table td th caption button object marquee applet template".split())
_IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset("tr td th".split()), frozenset({"table"})),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset({"table"})),
}

# What a start tag does besides opening an element, by its name.
_CLOSING_P, _IMPLYING, _LINK, _EMPTY, _OF_HEAD, _UNSEEN, _OUTER, _TEXT_ONLY = (1 << n for n in range(8))
_KEEPS_WAITING = _CLOSING_P | _IMPLYING | _OF_HEAD
_GROUPS = {
    _CLOSING_P: _CLOSES_P, _IMPLYING: _IMPLIED, _LINK: {"a"}, _EMPTY: _VOID, _OF_HEAD: _HEAD_ONLY, _UNSEEN: _NOT_RENDERED,
    _OUTER: {"html", "head", "body", "frameset"}, _TEXT_ONLY: _RAW | _ESCAPABLE_RAW,
}
_ROLE = {
    name: sum(role for role, names in _GROUPS.items() if name in names)
    for name in frozenset({"span", "label"}).union(_FORMATTING, *_GROUPS.values())
}

# Text, in which is every "<" that begins nothing, and what comes behind it: a start tag, or an end tag or comment.
_START = r"<([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+'|[\"'])[^>\"']*+)*+)>"
_OTHER = r"</([a-zA-Z][^\s/>]*+)[^>]*+>?|<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+>?"
# the last group is a start tag that does not end before the page does
_TOKEN = re.compile(rf"([^<]*+(?:<(?![a-zA-Z!?]|/[a-zA-Z])[^<]*+)*+)(?:\Z|{_START}|{_OTHER}|(<))", re.S)
# the groups stay, but no start tag matches
_NO_START = re.compile(rf"([^<]*+(?:<(?![!?]|/[a-zA-Z])[^<]*+)*+)(?:\Z|(\Z.)(\Z.)|{_OTHER}|(\Z.))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/][^\s=>/]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.S)
# all of a tag's attributes, if there is but one and nothing in it has to be rewritten
_SIMPLE = re.compile(r"\s+([a-z][a-z0-9\-]{0,99}+)=(?:([^\s\"'<>&]++)|\"([^\"<>&]*+)\"|'([^'\"<>&]*+)')\s*+")
_NAME = re.compile(r"[a-z_][a-z0-9_.\-]*\Z")
_BAD_NAME_CHAR = re.compile(r"[^a-z0-9_.\-]")
_NOT_XML = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")
_HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _text(raw: str) -> str:
    if "&" in raw:
        raw = unescape(raw).replace("&", "&amp;")
    if "<" in raw:
        raw = raw.replace("<", "&lt;")
    if ">" in raw:
        raw = raw.replace(">", "&gt;")
    return raw


# Fixed value: how many like formatting elements the HTML standard keeps in its list.
_SAME_FORMATTING = 3
# marks a formatting element whose end tag came while a block inside it was still open
_ENDED = "!"

# formatting elements that no rule looks for among the open ones
_PLAIN = _FORMATTING - {"a"}
_NEVER = 1 << 60
# an open element, or one to open again: its name, its tags as written, and their size
_Element = tuple[str, str, str, int]
_start, _end, _size = (itemgetter(n) for n in (1, 2, 3))


def _element(name: str, attributes: str = "") -> _Element:
    start, end = f"<{name}{attributes}>", f"</{name}>"
    return name, start, end, len(start) + len(end)


_BARE = {name: _element(name) for name in _ROLE}


class _Page:
    """Open elements of one page while it is rewritten.

    Formatting may be closed and opened again by hundreds with every block, so it moves in slices; the positions
    of the other open elements are kept beside the stack, for what looks for one of them.
    """

    __slots__ = ("out", "stack", "marks", "opened", "hidden_from", "reopen", "links", "seen_head", "seen_body", "limited", "cut", "room", "raw")

    def __init__(self, limited: bool, size: int) -> None:
        self.limited, self.cut = limited, False
        self.room = REOPENED_FREE + REOPENED_TIMES * size
        self.raw: list[tuple[int, str]] = []  # script and style text, by its place in the output
        self.out: list[str] = ["<html>"]
        self.stack: list[_Element] = [("html", "<html>", "</html>", 0)]
        self.marks: list[int] = []  # where the stack has other elements than plain formatting
        self.opened: dict[str, int] = defaultdict(int)  # how many of them are open, by name
        self.hidden_from = _NEVER  # the lowest element that is not rendered; those in it are not either
        self.reopen: list[_Element] = []
        self.links = False  # whether links may be among them
        self.seen_head = False
        self.seen_body = False

    def push(self, name: str, attributes: str, hides: bool) -> None:
        self.put(_element(name, attributes), hides)

    def put(self, element: _Element, hides: bool) -> None:
        stack = self.stack
        position = len(stack)
        if position >= MAX_DEPTH:
            self.cut = True
            self.pop()
            position -= 1
        if hides and self.hidden_from > position:
            self.hidden_from = position
        self.out.append(element[1] if self.hidden_from > position else _hidden(element))
        stack.append(element)
        if element[0] not in _PLAIN:
            self.marks.append(position)
            self.opened[element[0]] += 1

    def pop(self) -> None:
        element = self.stack.pop()
        position = len(self.stack)
        if element[0] not in _PLAIN and position:
            self.marks.pop()
            self.opened[element[0]] -= 1
        if self.hidden_from >= position:
            self.hidden_from = _NEVER
        self.out.append(element[2])

    def pop_to(self, position: int, keep_formatting: bool) -> None:
        """Close everything from ``position`` up; formatting cut short is opened again later."""
        stack, marks = self.stack, self.marks
        if position + 1 == len(stack):
            self.pop()
            return
        closed = stack[position:]
        del stack[position:]
        others = marks and marks[-1] > position
        while marks and marks[-1] >= position:
            self.opened[closed[marks.pop() - position][0]] -= 1
        if self.hidden_from >= position:
            self.hidden_from = _NEVER
        self.out += map(_end, reversed(closed))
        if not keep_formatting or not closed:
            return
        del closed[0]
        if others:
            closed = [element for element in closed if element[0] in _FORMATTING]
            self.links = True
        self.reopen += closed
        # of elements that are alike, the last few are opened again
        if len(self.reopen) > _SAME_FORMATTING and len(self.reopen) - len(set(map(_start, self.reopen))) >= _SAME_FORMATTING:
            counts: dict[str, int] = {}
            kept = []
            for element in reversed(self.reopen):
                counts[element[1]] = counts.get(element[1], 0) + 1
                if counts[element[1]] <= _SAME_FORMATTING:
                    kept.append(element)
            self.reopen = kept[::-1]

    def end(self, position: int) -> None:
        """Mark a formatting element as ended: it closes with the block inside it."""
        name, *tags = self.stack[position]
        self.stack[position] = (_ENDED + name, *tags)
        self.opened[_ENDED + name] += 1
        if name in _PLAIN:
            insort(self.marks, position)
        else:
            self.opened[name] -= 1

    def find(self, name: str) -> int:
        """The position of the innermost open element of that name, or 0."""
        if name not in _PLAIN and not self.opened.get(name):
            return 0
        for position in range(len(self.stack) - 1, 0, -1) if name in _PLAIN else reversed(self.marks):
            if self.stack[position][0] == name:
                return position
        return 0

    def last(self, names: frozenset[str], barrier: frozenset[str]) -> int:
        if self.marks and self.stack[self.marks[-1]][0] in names:
            return self.marks[-1]
        if not any(map(self.opened.get, names)):
            return 0
        for position in reversed(self.marks):
            name = self.stack[position][0]
            if name in names:
                return position
            if name in barrier:
                return 0
        return 0

    def need_body(self) -> None:
        if not self.seen_body:
            self.pop_to(1, keep_formatting=False)
            self.seen_body = self.seen_head = True
            self.push("body", "", False)

    def resume_formatting(self) -> None:
        waiting, self.reopen = self.reopen, []
        needed = sum(map(_size, waiting))
        if needed > self.room:
            # the innermost ones that there is room for
            self.cut, first = True, 0
            while needed > self.room:
                needed -= waiting[first][3]
                first += 1
            del waiting[:first]
        self.room -= needed
        position = len(self.stack)
        if self.links or position + len(waiting) > MAX_DEPTH:
            self.links = False
            for element in waiting:
                self.put(element, False)
            return
        self.out += map(_start if self.hidden_from > position else _hidden, waiting)
        self.stack += waiting


def _hidden(element: _Element) -> str:
    return f'{element[1][:-1]} {HIDDEN_MARK}="1">'


_OWN_MARKS = frozenset({HIDDEN_MARK, CUT_MARK})
_HIDING = frozenset("hidden style type".split())
_P = frozenset({"p"})
_A = frozenset({"a"})
_TABLE = frozenset({"table"})
_ROW_PARENTS = frozenset({"tbody", "thead", "tfoot"})


def _attributes(page: _Page, raw: str, name: str) -> tuple[str, bool]:
    hides = name in _NOT_RENDERED
    simple = _SIMPLE.fullmatch(raw)
    if simple and (key := simple[1]) not in _HIDING:
        return f' {key}="{simple[simple.lastindex]}"', hides
    parts, seen = [], set()
    for key, double, single, bare in _ATTRIBUTE.findall(raw):
        key = key.lower()
        if key in seen or key in _OWN_MARKS or not _NAME.match(key):
            continue
        if page.limited and (len(key) > MAX_NAME or len(seen) >= MAX_ATTRIBUTES):
            page.cut = True
            continue
        seen.add(key)
        value = double or single or bare
        if key in _HIDING:
            if key == "hidden" or (key == "style" and _HIDING_STYLE.search(value)):
                hides = True
            elif key == "type" and name == "input" and value.lower() == "hidden":
                hides = True
        parts.append(f' {key}="{_text(value).replace(chr(34), "&quot;")}"')
    return "".join(parts), hides


def _open(page: _Page, name: str, role: int, raw: str) -> None:
    attributes, hides = _attributes(page, raw, name) if raw else ("", role & _UNSEEN > 0)
    if role & _OUTER:
        _open_outer(page, name, attributes, hides)
        return
    if not page.seen_body:
        if not role & _OF_HEAD:
            page.need_body()
        elif not page.seen_head:
            page.seen_head = True
            page.push("head", "", True)
    if role:
        _make_way(page, name, role)
    if page.reopen and not role & _KEEPS_WAITING:
        page.resume_formatting()
    page.put(_element(name, attributes) if attributes else _BARE.get(name) or _element(name), hides)
    if role & _EMPTY:
        page.pop()


def _make_way(page: _Page, name: str, role: int) -> None:
    """Close what a start tag closes, and open what has to be around its element."""
    if role & _CLOSING_P and page.opened["p"] and (at := page.last(_P, _SCOPE_END)):
        page.pop_to(at, keep_formatting=True)
    if role & _IMPLYING:
        rule = _IMPLIED[name]
        while at := page.last(*rule):
            page.pop_to(at, keep_formatting=name not in ("td", "th", "tr", "tbody", "thead", "tfoot"))
        if name in ("tr", "td", "th"):
            top = page.stack[-1][0]
            if top == "table":
                page.push("tbody", "", False)
                top = "tbody"
            if name != "tr" and top in _ROW_PARENTS:
                page.push("tr", "", False)
    if role & _LINK:
        if at := page.last(_A, _SCOPE_END):
            page.pop_to(at, keep_formatting=True)
        page.reopen = [kept for kept in page.reopen if kept[0] != "a"]


def _open_outer(page: _Page, name: str, attributes: str, hides: bool) -> None:
    if name == "html":
        if attributes and len(page.out) == 1:
            page.out[0] = f"<html{attributes}>"
    elif name == "head":
        if not page.seen_head:
            page.seen_head = True
            page.push("head", attributes, True)
    elif not page.seen_body:
        page.pop_to(1, keep_formatting=False)
        page.seen_body = page.seen_head = True
        page.push(name, attributes, hides)


def _close(page: _Page, name: str) -> None:
    if name in ("html", "body") or name in _VOID:
        return
    if name in _FORMATTING:
        for position in range(len(page.reopen) - 1, -1, -1):
            if page.reopen[position][0] == name:
                del page.reopen[position]
                return
    position = page.find(name)
    if not position:
        if name == "p" and page.seen_body:
            page.push("p", "", False)
            page.pop()
        return
    inner = [page.stack[mark][0] for mark in page.marks[bisect_right(page.marks, position) :]]
    if name in _FORMATTING:
        if any(open_name != "a" and open_name != "span" for open_name in inner):
            # a block was opened inside: end it with that block's own end tag
            page.end(position)
            return
    elif name not in _TABLE and any(open_name in _SCOPE_END for open_name in inner):
        return
    page.pop_to(position, keep_formatting=True)
    while len(page.stack) > 1 and page.stack[-1][0].startswith(_ENDED):
        page.pop()


def _element_name(page: _Page, raw: str) -> str:
    if page.limited and len(raw) > MAX_NAME:
        page.cut, raw = True, raw[:MAX_NAME]
    name = raw.lower()
    return name if name.isascii() and name.isalnum() else _BAD_NAME_CHAR.sub("_", name)


def _rewritten(html: str, keep_raw_text: bool, limited: bool) -> _Page:
    """The page's output without script and style text, which is kept aside if wanted."""
    html = _NOT_XML.sub("", html)
    at, size = 0, len(html)
    page, token = _Page(limited, size), _TOKEN
    while at < size:
        for found in token.finditer(html, at):
            text, name, raw, closes, endless = found.groups()
            if endless:
                # it is looked at once, as text: after it, no start tag is sought
                at, token = found.start(), _NO_START
                break
            if text:
                if not text.isspace():
                    page.need_body()
                    if page.reopen:
                        page.resume_formatting()
                    page.out.append(_text(text))
                elif page.seen_body:
                    page.out.append(text)
            if name:
                if (role := _ROLE.get(name)) is None:
                    name = _element_name(page, name)
                    role = _ROLE.get(name, 0)
                _open(page, name, role, raw)
                if role & _TEXT_ONLY:
                    at = found.end()
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
                    body = html[at : end.start() if end else size]
                    if name in _ESCAPABLE_RAW:
                        page.out.append(_text(body))
                    elif keep_raw_text:
                        page.raw.append((len(page.out), body.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")))
                        page.out.append("")
                    page.pop()
                    at = end.end() if end else size
                    break
            elif closes:
                _close(page, _element_name(page, closes))
        else:
            break
    if not page.seen_body:
        page.need_body()
    page.pop_to(0, keep_formatting=False)
    if page.cut:
        page.out[0] = f'{page.out[0][:-1]} {CUT_MARK}="1">'
    return page


def repair_page(html: str | None, keep_raw_text: bool = False, limited: bool = True) -> str | None:
    """One page as well-formed XML with a single html root; null stays null."""
    return repair_both(html, limited)[1] if keep_raw_text else None if html is None else "".join(_rewritten(html, False, limited).out)


def repair_both(html: str | None, limited: bool = True) -> tuple[str | None, str | None]:
    """The page without and with its script and style text, read once."""
    if html is None:
        return None, None
    page = _rewritten(html, True, limited)
    plain = "".join(page.out)
    for place, text in page.raw:
        page.out[place] = text
    return plain, "".join(page.out)


@F.arrow_udf(StringType())
def _repair(pages: pa.Array, raw: pa.Array, limited: pa.Array) -> pa.Array:
    settings = zip(pages.to_pylist(), raw.to_pylist(), limited.to_pylist(), strict=True)
    return pa.array([repair_page(*row) for row in settings], pa.string())


_BOTH = StructType([StructField("document", StringType()), StructField("raw_document", StringType())])


@F.arrow_udf(_BOTH)
def _repair_both(pages: pa.Array, limited: pa.Array) -> pa.Array:
    made = [repair_both(*row) for row in zip(pages.to_pylist(), limited.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([m[n] for m in made], pa.string()) for n in (0, 1)], ["document", "raw_document"])


def with_document(rows: DataFrame, raw: bool, html: str = "html") -> DataFrame:
    """Adds ``document``, with ``raw`` also ``raw_document``, and ``cut``; every row's page is read once."""
    if not raw:
        made = rows.withColumn("document", repair(html))
    else:
        bound_batches(rows.sparkSession)
        limited = not raise_xml_limits(rows.sparkSession)
        made = rows.withColumn("_both", _repair_both(html, F.lit(limited))).select(*rows.columns, "_both.*")
    return made.withColumn("cut", is_cut("document"))


def repair(html: Column | str, keep_raw_text: bool = False) -> Column:
    """Well-formed document for Spark's ``xpath*`` functions."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        bound_batches(spark)
    limited = spark is None or not raise_xml_limits(spark)
    return _repair(html, F.lit(keep_raw_text), F.lit(limited))


def is_cut(document: Column | str) -> Column:
    """Whether something of the page is missing from its repaired document."""
    document = F.col(document) if isinstance(document, str) else document
    return F.regexp_extract(document, "^<html[^>]*>", 0).contains(f' {CUT_MARK}="1">')


def register(spark: SparkSession) -> None:
    """For SQL, to be combined with ``xpath_string`` and its relatives: ``repair_html(html)``, and the table function
    ``repaired(html)``, used with LATERAL, which also says what was cut and how many elements the document has."""
    bound_batches(spark)
    limited = str(not raise_xml_limits(spark)).lower()
    spark.udf.register("repair_html_as", _repair)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION repair_html(html STRING) RETURNS STRING RETURN repair_html_as(html, false, {limited})"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION repaired(html STRING) RETURNS TABLE(document STRING, cut BOOLEAN, n_elements INT)"
        f" RETURN SELECT d, contains(regexp_extract(d, '^<html[^>]*>', 0), ' {CUT_MARK}=\"1\">'), regexp_count(d, '<[a-z_]')"
        f" FROM (SELECT repair_html_as(html, false, {limited}) AS d)"
    )
