"""Selectors: validity probes, frame selectors, and packs of XPath 1.0 probes.

Spark's ``xpath*`` functions want a constant path and parse the document on every
call. A *pack* therefore asks for several fields in one ``concat(...)`` path, so
a document is parsed once per pack instead of three times per field.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.functions.html import HIDDEN_MARK
from gleanery.functions.urls import join_reference

# A control character cannot occur in well-formed XML, so it separates answers safely.
_SEP = "\x1f"
_PROBE_DOCUMENT = "<a/>"
_PACK_START = 5

# Names read from the element rather than from an attribute, link
# attributes reported as absolute URLs, and attributes reported as "true".
TEXT_PROPERTIES = ("textContent", "innerText")
LINK_ATTRIBUTES = ("href", "src")
BOOLEAN_ATTRIBUTES = (
    "async autofocus autoplay checked controls default defer disabled formnovalidate hidden ismap loop"
    " multiple muted nomodule novalidate open playsinline readonly required reversed selected"
).split()


_verdicts: dict[tuple[str, ...], bool] = {}


def forget_verdicts() -> None:
    """Probe every path anew, as a fresh process would."""
    _verdicts.clear()


class Probe(NamedTuple):
    """One selector and what to read from its first match (``''`` = rendered text)."""

    xpath: str
    attribute: str


def _accepts(spark: SparkSession, paths: Iterable[str]) -> bool:
    """Whether all paths compile."""
    key = tuple(paths)
    if key not in _verdicts:
        _verdicts[key] = all(_compiles(spark, path) for path in key)
    return _verdicts[key]


def _compiles(spark: SparkSession, path: str) -> bool:
    """Ask the driver's XPath engine, which is the one behind Spark's ``xpath*`` functions; no query runs."""
    java = spark._jvm
    engine = java.javax.xml.xpath.XPathFactory.newInstance().newXPath()
    document = java.org.xml.sax.InputSource(java.java.io.StringReader(_PROBE_DOCUMENT))
    try:
        engine.evaluate(path, document)
        return True
    except Py4JJavaError as error:
        if "XPath" in str(error.java_exception) or "XML" in str(error.java_exception):
            return False
        raise


def rejected(spark: SparkSession, paths: list[str]) -> list[str]:
    """The members of ``paths`` that do not compile, found by halving."""
    if not paths or _accepts(spark, [f"string({path})" if path.strip() else "!" for path in paths]):
        return []
    if len(paths) == 1:
        return paths
    half = len(paths) // 2
    return rejected(spark, paths[:half]) + rejected(spark, paths[half:])


def invalid_paths(paths: DataFrame, batch: int = 200) -> list[str]:
    """Non-compiling values of the single string column, streamed to the driver in batches.

    Only the rejected paths are kept; specs are configuration, so both lists are small.
    """
    spark = paths.sparkSession
    column = paths.columns[0]
    rows: Iterator = paths.where(F.col(column).isNotNull()).distinct().toLocalIterator()
    bad: list[str] = []
    while chunk := [row[0] for row in islice(rows, batch)]:
        bad += rejected(spark, chunk)
    return bad


def not_elements(spark: SparkSession, paths: list[str]) -> set[str]:
    """Paths that cannot be asked for a first element: invalid, too long for the engine's
    limits, or numbers/strings/booleans."""

    def failing(part: list[str]) -> list[str]:
        asked = [f"concat(string(({path})[1]/@{HIDDEN_MARK}), '')" for path in part]
        if not part or _accepts(spark, asked):
            return []
        if len(part) == 1:
            return part
        half = len(part) // 2
        return failing(part[:half]) + failing(part[half:])

    return set(failing([path for path in paths if path.strip()])) | {path for path in paths if not path.strip()}


def _answers(probe: Probe) -> list[str]:
    """found, hidden mark, value, disabled — in this order."""
    path, attribute = probe
    if attribute == "":
        value = f"normalize-space({path})"
    elif attribute in TEXT_PROPERTIES:
        value = f"string({path})"
    elif attribute.lower() in BOOLEAN_ATTRIBUTES:
        value = f"substring('true', 1, 4 * count(({path})[1]/@{attribute.lower()}))"
    else:
        value = f"string(({path})[1]/@{attribute})"
    # only a path whose last step leaves the element axis needs the grouped form
    found = f"boolean(({path})[1]/self::*)" if _LEAVES_ELEMENTS.search(path) else f"boolean({path})"
    return [found, f"string(({path})[1]/@{HIDDEN_MARK})", value]


ANSWERS_PER_PROBE = 3
_LEAVES_ELEMENTS = re.compile(r"(?:@|attribute::|namespace::|text\(|comment\(|node\(|processing-instruction\()[^/]*\Z")


def _pack_path(probes: list[Probe]) -> str:
    parts = [answer for probe in probes for answer in _answers(probe)]
    return "concat(" + f",'{_SEP}',".join(parts) + ", '')"


def packs(spark: SparkSession, probes: list[Probe]) -> list[str]:
    """Few large constant paths covering all probes, each within the XPath engine's size limits."""
    out: list[str] = []
    at, width = 0, _PACK_START
    while at < len(probes):
        path = _pack_path(probes[at : at + width])
        if _accepts(spark, [path]):
            out.append(path)
        elif width == 1:
            out += _answers(probes[at])  # a long path: one call per answer
        else:
            width -= 1
            continue
        at += width
        width = min(width + 1, _PACK_START)
    return out


def _reads_raw_text(probe: Probe) -> bool:
    return probe.attribute == "textContent"


def evaluate(
    spark: SparkSession,
    document: Column,
    answers: Column,
    page_url: Column,
    probes: list[Probe],
    raw_document: Column | None = None,
) -> tuple[Column, Column]:
    """Two columns for one list of probes: the raw answers read from ``document``, and
    ``array<struct<status, value>>`` aligned with ``probes``, built from the ``answers`` column.

    status: ``found`` (first match rendered), ``hidden`` (first match not rendered), ``missing``,
    ``invalid`` (path is not an element selector). Text content is read from ``raw_document``,
    where there is one.
    """
    unusable = not_elements(spark, sorted({probe.xpath for probe in probes}))
    bad_names = {p for p in probes if p.attribute and not re.fullmatch(r"[A-Za-z_][\w.\-]*", p.attribute)}
    asked = [probe for probe in probes if probe.xpath not in unusable]
    if raw_document is not None:
        asked.sort(key=_reads_raw_text)
    parts = [(document, asked)]
    if raw_document is not None:
        parts = [(d, [p for p in asked if _reads_raw_text(p) == raw]) for d, raw in ((document, False), (raw_document, True))]
    texts = [
        F.xpath_string(source, F.lit(path))
        for source, mine in parts
        for path in packs(spark, [Probe(p.xpath, "" if p in bad_names else p.attribute) for p in mine])
    ]
    read = F.split(F.concat_ws(_SEP, *texts), _SEP, -1) if texts else F.array().cast("array<string>")
    position = {probe: n for n, probe in enumerate(asked)}
    structs = []
    for probe in probes:
        if probe not in position:
            structs.append(F.struct(F.lit("invalid").alias("status"), F.lit("").alias("value")))
            continue
        at = position[probe] * ANSWERS_PER_PROBE
        found, hidden, value = (F.get(answers, F.lit(at + n)) for n in range(ANSWERS_PER_PROBE))
        if probe in bad_names:
            value = F.lit("")
        elif probe.attribute in LINK_ATTRIBUTES:
            value = F.when(value == "", "").otherwise(join_reference(page_url, value))
        status = F.when(found != "true", "missing").when(hidden == "1", "hidden").otherwise("found")
        structs.append(
            F.struct(
                status.alias("status"),
                F.when(found == "true", F.coalesce(value, F.lit(""))).otherwise("").alias("value"),
            )
        )
    return read, F.array(*structs)


def of_frame(kind: str, value: str) -> str | None:
    """Path of a frame selector's element; null when a CSS selector is outside the simple subset."""
    frames = "//*[self::iframe or self::frame]"
    if kind == "index":
        return f"({frames})[{int(value) + 1}]"
    if kind == "name":
        return f"({frames}[@id={_literal(value)} or @name={_literal(value)}])[1]"
    path = value if kind == "xpath" else css_to_xpath(value)
    return None if path is None else f"({path})[1][self::iframe or self::frame]"


def _literal(text: str) -> str:
    if "'" not in text:
        return f"'{text}'"
    if '"' not in text:
        return f'"{text}"'
    pieces = ", \"'\", ".join(f"'{piece}'" for piece in text.split("'"))
    return f"concat({pieces})"


_CSS_PART = re.compile(
    r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]"
)


def _css_test(part: re.Match) -> str:
    mark, name, key, sign, *quoted = part.groups()
    if mark == "#":
        return f"@id={_literal(name)}"
    if mark == ".":
        return f"contains(concat(' ', normalize-space(@class), ' '), {_literal(' ' + name + ' ')})"
    if sign is None:
        return f"@{key}"
    text = next(value for value in quoted if value is not None)
    value = _literal(text)
    return {
        "=": f"@{key}={value}",
        "~=": f"contains(concat(' ', normalize-space(@{key}), ' '), {_literal(' ' + text + ' ')})",
        "|=": f"(@{key}={value} or starts-with(@{key}, {_literal(text + '-')}))",
        "^=": f"starts-with(@{key}, {value})",
        "*=": f"contains(@{key}, {value})",
        "$=": f"substring(@{key}, string-length(@{key}) - {len(text) - 1})={value}",
    }[sign]


# a bracket runs to the one that closes it; quotes inside may hold commas, blanks and brackets
_CSS_BRACKET = r"""\[(?:[^\]"']|"[^"]*"|'[^']*')*\]"""
_CSS_LIST = re.compile(rf"((?:{_CSS_BRACKET}|[^,\[])*),")
_CSS_TOKEN = re.compile(rf">|(?:{_CSS_BRACKET}|[^\s>\[])+")


def css_to_xpath(css: str) -> str | None:
    """Simple CSS selectors (tag, ``.class``, ``#id``, ``[attr]``, descendant, ``>``, lists) as XPath."""
    alternatives = []
    selectors = _CSS_LIST.findall(css + ",")
    if sum(len(selector) + 1 for selector in selectors) != len(css) + 1:
        return None  # a bracket that does not close
    for selector in selectors:
        tokens = _CSS_TOKEN.findall(selector.strip())
        path, axis = "", "//"
        for token in tokens:
            if token == ">":
                axis = "/"
                continue
            found = re.match(r"\*|[\w-]*", token)
            rest = token[found.end() :]
            if _CSS_PART.sub("", rest) or not token:
                return None
            tests = [_css_test(part) for part in _CSS_PART.finditer(rest)]
            path += axis + (found[0].lower() or "*") + "".join(f"[{test}]" for test in tests)
            axis = "//"
        if not path or axis == "/":
            return None
        alternatives.append(path)
    return " | ".join(alternatives) or None
