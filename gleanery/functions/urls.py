"""URL column expressions: absolute check, join, canonical form, validity, rejection reason.

Everything here is built from JVM functions, so it stays inside whole-stage
code generation and can be pushed next to the scan.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What a Unicode-aware strip removes, and the ASCII control range.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_STRIP = rf"^{_SPACE}+|{_SPACE}+\z"
_CONTROL = r"[\x00-\x1f]"
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(_c(x), _STRIP, "")


def cleaned(url: Column | str) -> Column:
    """Drop ASCII control characters, then trim."""
    return strip(F.regexp_replace(_c(url), _CONTROL, ""))


# --- absolute / relative -----------------------------------------------------------------


def is_absolute(url: Column | str) -> Column:
    """True when the trimmed value starts with a lower-case http:// or https:// prefix."""
    u = strip(url)
    return F.coalesce(u.startswith("http://") | u.startswith("https://"), F.lit(False))


def make_absolute(url: Column | str, base: Column | str) -> Column:
    """Prefix a relative URL with its base (plain concatenation); null where that is an error."""
    u, b = strip(url), _c(base)
    tail = F.when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), u))
    return (
        F.when(F.coalesce(u, F.lit("")) == "", F.lit(None).cast("string"))
        .when(is_absolute(url), u)
        .when(is_absolute(b), F.concat(F.rtrim(b, F.lit("/")), tail))
    )


# --- canonical form ----------------------------------------------------------------------


def _recode(part: Column) -> Column:
    decoded = F.url_decode(F.regexp_replace(part, _BAD_ESCAPE, "%25"))
    # url_encode differs from query-string quoting on exactly these two characters
    return F.replace(F.replace(F.url_encode(decoded), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _canonical_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    coded = F.transform(
        pairs,
        lambda p: F.concat(
            _recode(F.substring_index(p, "=", 1)),
            F.lit("="),
            _recode(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")),
        ),
    )
    return F.when(query == "", F.lit("")).otherwise(F.array_join(coded, "&"))


def normalize(url: Column | str) -> Column:
    """Canonical http(s) URL, or null where ``url_error`` names a reason."""
    u = cleaned(url)
    before = F.regexp_extract(u, r"^[^?#]*", 0)
    query = _canonical_query(F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1))
    fragment = F.regexp_extract(u, r"(?s)^[^#]*#(.*)\z", 1)
    scheme = F.lower(F.regexp_extract(before, _SCHEME, 1))
    rest = F.regexp_replace(before, _SCHEME, "")
    rest = F.when((rest == "") | rest.rlike(r"^/(?!/)"), F.concat(F.lit("//"), rest)).otherwise(rest)
    joined = F.concat(
        scheme,
        F.lit(":"),
        rest,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when(_reason(u, url).isNull(), joined)


def resolve(url: Column | str, base: Column | str) -> Column:
    """Canonical form of an absolute URL, or of a relative one joined to its base."""
    return normalize(F.when(is_absolute(url), _c(url)).otherwise(make_absolute(url, base)))


# --- validity and reasons ----------------------------------------------------------------


@cache
def _ipv6() -> str:
    """IPv6 literal grammar (RFC 3986), assembled by rule."""
    byte = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    h = "[0-9A-Fa-f]{1,4}"
    low = rf"(?:{h}:{h}|{byte}(?:\.{byte}){{3}})"
    forms = [rf"(?:{h}:){{6}}{low}"]
    for left in range(0, 8):
        head = rf"(?:(?:{h}:){{0,{left - 1}}}{h})?" if left else ""
        right = 5 - left
        if right >= 0:
            forms.append(rf"{head}::(?:{h}:){{{right}}}{low}")
        elif right == -1:
            forms.append(rf"{head}::{h}")
        else:
            forms.append(rf"{head}::")
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


@cache
def _confusable() -> str:
    """Characters whose compatibility form smuggles a URL delimiter into the host."""
    found = [
        cp
        for cp in range(0x80, 0x30000)
        if not 0xD800 <= cp < 0xE000
        and any(ch in "/?#@:" for ch in unicodedata.normalize("NFKC", chr(cp)))
    ]
    return "[" + "".join(rf"\x{{{cp:x}}}" for cp in found) + "]"


def _netloc(u: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(u, _SCHEME, ""), r"^//([^/?#]*)", 1)


def host(url: Column | str) -> Column:
    """Host part (no user info, no port), lower-cased; empty when there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_netloc(cleaned(url)), r"^.*@", ""), r":\d*\z", ""))


def origin(url: Column | str) -> Column:
    """``scheme://netloc`` of an absolute URL."""
    return F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", 0)


_LITERAL = r"^[^\[]*\[([^\]]*)"
# what splitting a URL ignores: leading control characters and spaces, and tab, CR, LF anywhere
_LEADING, _BREAKS = r"^[\x00-\x20]+", r"[\t\r\n]"


@cache
def _ip_literal() -> str:
    return rf"^(?:{_ipv6()}|v[0-9A-Fa-f]+\..+)\z"


def _bad_host(netloc: Column) -> Column:
    opened, closed = netloc.contains("["), netloc.contains("]")
    literal = F.regexp_extract(netloc, _LITERAL, 1)
    bad_literal = ~literal.rlike(_ip_literal())
    return (opened != closed) | (opened & bad_literal) | netloc.rlike(_confusable())


def _reason(u: Column, raw: Column | str) -> Column:
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    return (
        F.when(_c(raw).isNull() | (_c(raw) == ""), "empty")
        .when(u == "", "blank")
        .when(_bad_host(_netloc(u)), "invalid_host")
        .when(scheme == "", "no_scheme")
        .when(~scheme.isin("http", "https"), "bad_scheme")
    )


def url_error(url: Column | str, base: Column | str | None = None) -> Column:
    """Why canonicalisation rejects the value; null when it does not.

    With a base, the reason also covers joining (``bad_base``).
    """
    if base is None:
        return _reason(cleaned(url), url)
    u = strip(url)
    joined = make_absolute(url, base)
    return (
        F.when(F.coalesce(u, F.lit("")) == "", "empty")
        .when(joined.isNull(), "bad_base")
        .otherwise(_reason(cleaned(joined), joined))
    )


def normalize_strict(url: Column | str) -> Column:
    """As ``normalize``, but a rejected value fails the query."""
    reason = url_error(url)
    return F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("URL rejected: "), reason))).otherwise(
        normalize(url)
    )


def is_valid(url: Column | str) -> Column:
    """http/https scheme (any case) and a non-empty, well-formed network location."""
    u = F.regexp_replace(F.regexp_replace(_c(url), _LEADING, ""), _BREAKS, "")
    return F.coalesce(u.rlike(r"(?i)^https?://[^/?#]+") & ~_bad_host(_netloc(u)), F.lit(False))


def url_contains(url: Column | str, part: Column | str) -> Column:
    return _c(url).contains(part)


# --- reference resolution for href / src -------------------------------------------------


def _remove_dots(path: Column) -> Column:
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    slash = F.when(path.rlike(r"(?:^|/)\.{1,2}\z"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|\z)"), F.concat(F.array_join(kept, "/"), slash)).otherwise(path)


def join_reference(base: Column | str, ref: Column | str) -> Column:
    """RFC 3986 resolution of a link found on a page, as a browser reports ``href``/``src``."""
    b, r = _c(base), strip(ref)
    site = origin(b)
    path = F.regexp_extract(F.substr(b, F.length(site) + 1), r"^[^?#]*", 0)
    bare = F.concat(site, path)
    query = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)
    ref_path = F.regexp_extract(r, r"^[^?#]*", 0)
    ref_tail = F.substr(r, F.length(ref_path) + 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(?:.*/)?", 0))
    return (
        F.when(r.rlike(_SCHEME), r)
        .when(r.startswith("//"), F.concat(F.regexp_extract(b, _SCHEME, 0), r))
        .when(r == "", F.concat(bare, query))
        .when(r.startswith("?"), F.concat(bare, r))
        .when(r.startswith("#"), F.concat(bare, query, r))
        .when(r.startswith("/"), F.concat(site, _remove_dots(ref_path), ref_tail))
        .otherwise(F.concat(site, _remove_dots(F.concat(folder, ref_path)), ref_tail))
    )


# --- DataFrame level ---------------------------------------------------------------------


def with_normalized(df: DataFrame, column: str = "url", into: str = "norm_url") -> DataFrame:
    return df.withColumn(into, normalize(column))


def with_resolved(df: DataFrame, url: str, base: str, into: str, error_into: str | None = None) -> DataFrame:
    """``resolve`` in two projections: the joined URL is computed once and then read many times."""
    joined = f"_{into}_joined"
    out = df.withColumn(
        joined, F.when(is_absolute(url), F.col(url)).otherwise(make_absolute(url, base))
    ).withColumn(into, normalize(joined))
    if error_into:
        out = out.withColumn(
            error_into,
            F.when(F.coalesce(strip(url), F.lit("")) == "", "empty")
            .when(F.col(joined).isNull(), "bad_base")
            .otherwise(url_error(joined)),
        )
    return out.drop(joined)


def duplicates(df: DataFrame, column: str = "url") -> DataFrame:
    """Canonical URLs that occur more than once; counts combine map-side."""
    return (
        df.select(normalize(column).alias("norm_url"))
        .where(F.col("norm_url").isNotNull())
        .groupBy("norm_url")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def dedup(df: DataFrame, column: str = "url", order: str = "page_id") -> DataFrame:
    """One row per canonical URL: the smallest ``order``. Rejected URLs are dropped.

    Only URL and ``order``, which identifies a row, take part in choosing; a URL with very many
    copies is reduced inside each map task before the shuffle.
    """
    rows = with_normalized(df, column).where(F.col("norm_url").isNotNull())
    first = rows.groupBy(F.col("norm_url").alias("_url")).agg(F.min(order).alias("_first"))
    kept = rows.join(first, (F.col("norm_url") == F.col("_url")) & (F.col(order) == F.col("_first")), "left_semi")
    return kept.select("norm_url", *df.columns)


def register(spark: SparkSession) -> None:
    """The same operators as SQL functions; they are inlined by the analyzer."""
    lit = _sql_text

    def stripped(name: str) -> str:
        return f"regexp_replace({name}, {lit(_STRIP)}, '')"

    def absolute(text: str) -> str:
        return f"coalesce({text} like 'http://%' or {text} like 'https://%', false)"

    u, b = stripped("url"), stripped("base")
    functions = {
        "is_absolute_url(url STRING) RETURNS BOOLEAN": absolute(u),
        "make_absolute_url(url STRING, base STRING) RETURNS STRING": (
            f"case when coalesce({u}, '') = '' then null"
            f" when {absolute(u)} then {u}"
            f" when {absolute(b)} then"
            f" concat(rtrim('/', base), if({u} like '/%', '', '/'), {u}) end"
        ),
        "url_host(url STRING) RETURNS STRING": (
            f"lower(regexp_replace(regexp_replace({_netloc_sql(_cleaned_sql('url'))}, '^.*@', ''), {lit(r':[0-9]*\z')}, ''))"
        ),
        "validate_url(url STRING) RETURNS BOOLEAN": (
            f"coalesce(regexp_like({_split_sql('url')}, '(?i)^https?://[^/?#]+')"
            f" and not {_bad_host_sql(_netloc_sql(_split_sql('url')))}, false)"
        ),
        "normalize_url(url STRING) RETURNS STRING": _normalize_sql(),
    }
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cleaned_sql(url: str) -> str:
    """``cleaned`` as SQL."""
    return f"regexp_replace(regexp_replace({url}, {_sql_text(_CONTROL)}, ''), {_sql_text(_STRIP)}, '')"


def _split_sql(url: str) -> str:
    """What ``is_valid`` reads, as SQL."""
    return f"regexp_replace(regexp_replace({url}, {_sql_text(_LEADING)}, ''), {_sql_text(_BREAKS)}, '')"


def _netloc_sql(u: str) -> str:
    return f"regexp_extract(regexp_replace({u}, {_sql_text(_SCHEME)}, ''), '^//([^/?#]*)', 1)"


def _bad_host_sql(netloc: str) -> str:
    """``_bad_host`` as SQL, from the same patterns."""
    literal = f"regexp_extract({netloc}, {_sql_text(_LITERAL)}, 1)"
    return (
        f"((contains({netloc}, '[') <> contains({netloc}, ']'))"
        f" or (contains({netloc}, '[') and not regexp_like({literal}, {_sql_text(_ip_literal())}))"
        f" or regexp_like({netloc}, {_sql_text(_confusable())}))"
    )


def _normalize_sql() -> str:
    lit = _sql_text
    clean = _cleaned_sql("url")
    before = f"regexp_extract({clean}, '^[^?#]*', 0)"
    rest = f"regexp_replace({before}, {lit(_SCHEME)}, '')"

    def recode(part: str) -> str:
        decoded = f"url_decode(regexp_replace({part}, {lit(_BAD_ESCAPE)}, '%25'))"
        return f"replace(replace(url_encode({decoded}), '%7E', '~'), '*', '%2A')"

    name = recode("substring_index(p, '=', 1)")
    value = recode("if(instr(p, '=') > 0, regexp_replace(p, '(?s)^[^=]*=', ''), '')")
    query = (
        "array_join(transform(filter(split(regexp_extract("
        f"{clean}, {lit(r'(?s)^[^?#]*\?([^#]*)')}, 1), '&'), p -> p <> ''),"
        f" p -> concat({name}, '=', {value})), '&')"
    )
    fragment = f"regexp_extract({clean}, {lit(r'(?s)^[^#]*#(.*)\z')}, 1)"
    return (
        f"case when regexp_like({clean}, '(?i)^https?:') and not {_bad_host_sql(_netloc_sql(clean))} then concat("
        f"lower(regexp_extract({before}, {lit(_SCHEME)}, 1)), ':',"
        f" if({rest} = '' or regexp_like({rest}, '^/(?!/)'), '//', ''), {rest},"
        f" if({query} = '', '', concat('?', {query})),"
        f" if({fragment} = '', '', concat('#', {fragment}))) end"
    )
