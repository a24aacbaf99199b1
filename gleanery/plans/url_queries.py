"""URL and name operators over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.functions import names, urls
from gleanery.plans import views as V

# the page URL rewritten so that canonicalisation has something to do
_RAW = (
    "concat(' ', regexp_replace(substring_index(url, '#', 1), '^http', 'HTTP'),"
    " if(contains(url, '?'), '&', '?'), 'q=a b+c%20d*~&e&&n=', page_id, '%zz',"
    " if(contains(url, '#'), concat('#', substring_index(url, '#', -1)), ''), char(9))"
)
RAW_SQL = (
    "' ' || regexp_replace(split_part(url, '#', 1), '^http', 'HTTP')"
    " || case when contains(url, '?') then '&' else '?' end || 'q=a b+c%20d*~&e&&n=' || page_id || '%zz'"
    " || case when contains(url, '#') then '#' || split_part(url, '#', 2) else '' end || chr(9)"
)

# eight kinds of URL value, good and bad
_KINDS = (
    "case pmod(page_id, 8) when 0 then url when 1 then regexp_replace(url, '^https?', 'ftp')"
    " when 2 then regexp_replace(url, '^https?:', '') when 3 then regexp_replace(url, '^http', 'HTTP')"
    " when 4 then regexp_replace(url, '^https?://[^/]*', 'http://') when 5 then concat(char(9), '  ')"
    " when 6 then regexp_replace(url, '^(https?://)[^/]*', '$1[::g]') else '' end"
)
KINDS_SQL = (
    "case page_id % 8 when 0 then url when 1 then regexp_replace(url, '^https?', 'ftp')"
    " when 2 then regexp_replace(url, '^https?:', '') when 3 then regexp_replace(url, '^http', 'HTTP')"
    " when 4 then regexp_replace(url, '^https?://[^/]*', 'http://') when 5 then chr(9) || '  '"
    r" when 6 then regexp_replace(url, '^(https?://)[^/]*', '\1[::g]') else '' end"
)
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

_RECODED = "replace(url_encode(url_decode(replace(replace({x}, '%zz', '%25zz'), '+', ' '))), '%20', '+')"


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.table(spark, sf_dir, "pages").select("page_id", F.expr(_RAW).alias("raw"))
    return urls.with_normalized(raw, "raw").select("page_id", "norm_url")


URL_NORMALIZE = f"""
with raw as (select page_id, trim({RAW_SQL}, ' ' || chr(9)) u from pages),
parts as (select page_id, u, split_part(split_part(u, '#', 1), '?', 1) pre,
  split_part(split_part(u, '#', 1), '?', 2) q, case when contains(u, '#') then split_part(u, '#', 2) else '' end f from raw),
pairs as (select page_id, list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''),
  lambda p: {_RECODED.format(x="split_part(p, '=', 1)")} || '=' || {_RECODED.format(x="split_part(p, '=', 2)")}) l from parts)
select page_id, regexp_replace(pre, '^HTTP', 'http') || '?' || array_to_string(l, '&')
  || case when f = '' then '' else '#' || f end as norm_url
from parts join pairs using (page_id)
"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_KINDS).alias("u"))


def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select("page_id", urls.is_valid("u").alias("valid"))


URL_VALIDATE = f"""
select page_id, regexp_matches(u, '^(?i:https?)://[^/?#]+') and not contains(u, '[') as valid
from (select page_id, {KINDS_SQL} u from pages)
"""


def url_is_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select("page_id", urls.is_absolute("u").alias("absolute"))


URL_IS_ABSOLUTE = f"""
select page_id, starts_with(u, 'http://') or starts_with(u, 'https://') as absolute
from (select page_id, {KINDS_SQL} u from pages)
"""


def _relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select(
        "page_id",
        F.expr(
            f"case pmod(page_id, 5) when 0 then url when 1 then {_PATH} when 2 then ltrim('/', {_PATH})"
            " when 3 then '  ' else concat(' ', substring_index(url, '#', 1), ' ') end"
        ).alias("u"),
        F.expr(
            "if(pmod(page_id, 3) = 0, '/no/base', concat(regexp_extract(url, '^[a-z]+://[^/?#]+', 0), repeat('/', cast(page_id % 4 as int))))"
        ).alias("base"),
    )


_RELATIVE_SQL = f"""
select page_id,
  case page_id % 5 when 0 then url when 1 then {_PATH} when 2 then ltrim({_PATH}, '/') when 3 then '  '
    else ' ' || split_part(url, '#', 1) || ' ' end u,
  case when page_id % 3 = 0 then '/no/base' else regexp_extract(url, '^[a-z]+://[^/?#]+') || repeat('/', page_id % 4) end base
from pages
"""
_JOINED_SQL = """
case when trim(u) = '' then null when regexp_matches(trim(u), '^https?://') then trim(u)
  when not regexp_matches(base, '^https?://') then null
  else rtrim(base, '/') || case when starts_with(trim(u), '/') then '' else '/' end || trim(u) end
"""


def url_make_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relative(spark, sf_dir).select("page_id", urls.make_absolute("u", "base").alias("absolute_url"))


URL_MAKE_ABSOLUTE = f"select page_id, {_JOINED_SQL} as absolute_url from ({_RELATIVE_SQL})"


def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = urls.with_resolved(_relative(spark, sf_dir), "u", "base", "resolved", "reason")
    return resolved.select("page_id", "resolved", "reason")


# the given query strings are already canonical
URL_RESOLVE = f"""
select page_id, {_JOINED_SQL} as resolved,
  case when trim(u) = '' then 'empty'
    when not regexp_matches(trim(u), '^https?://') and not regexp_matches(base, '^https?://') then 'bad_base' end as reason
from ({_RELATIVE_SQL})
"""


def url_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = _kinds(spark, sf_dir).select(F.coalesce(urls.url_error("u"), F.lit("none")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


URL_ERROR_COUNTS = f"""
select case when u = '' then 'empty' when trim(u, ' ' || chr(9)) = '' then 'blank' when contains(u, '[') then 'invalid_host'
  when starts_with(u, '//') then 'no_scheme' when starts_with(u, 'ftp') then 'bad_scheme' else 'none' end as reason,
  count(*) as n
from (select {KINDS_SQL} u from pages) group by 1
"""


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = V.snapshots(spark, sf_dir).drop("html")
    return urls.dedup(copies).select("norm_url", "page_id", F.unix_seconds("fetched_at").alias("fetched_sec"))


URL_DEDUP = """
select url as norm_url, min(page_id) * 3 as page_id,
  1700000000 + arg_min((page_id * 7) % 13, page_id) * 60 as fetched_sec
from pages group by url
"""


def url_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.duplicates(V.snapshots(spark, sf_dir).drop("html"))


URL_DUPLICATES = "select url as norm_url, 3 * count(*) as copies from pages group by url"


def url_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        V.table(spark, sf_dir, "pages")
        .where(urls.url_contains("url", "utm_source"))
        .groupBy(urls.host("url").alias("host"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


URL_CONTAINS = r"""
select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, count(*) as n
from pages where contains(url, 'utm_source') group by 1
"""


def url_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function forms, on the same values."""
    urls.register(spark)
    names.register(spark)
    V.table(spark, sf_dir, "pages").createOrReplaceTempView("pages_for_functions")
    return spark.sql(
        f"select page_id, normalize_url({_RAW}) as norm_url, is_absolute_url({_RAW}) as absolute,"
        f" validate_url({_RAW}) as valid, url_host(url) as host, safe_context(url) as safe"
        " from pages_for_functions"
    )


URL_SQL_FUNCTIONS = f"""
select n.page_id, n.norm_url, false as absolute, true as valid,
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_replace(url, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') as safe
from ({URL_NORMALIZE}) n join pages using (page_id)
"""


def context_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    rows = V.table(spark, sf_dir, "pages").select("page_id", F.concat(urls.host("url"), F.lit("_"), title).alias("c"), at.alias("at"))
    return rows.select(
        "page_id",
        names.safe_context("c").alias("safe"),
        names.sanitize_context("c").alias("sanitized"),
        names.artifact_file("c", "at").alias("file"),
    )


CONTEXT_NAMES = r"""
with c as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '_' || regexp_extract(html, '<title>(.*?)</title>', 1) c from pages)
select page_id, regexp_replace(c, '[^\p{L}\p{N}_-]', '_', 'g') as safe,
  left(regexp_replace(c, '[^a-zA-Z0-9_\-]', '_', 'g'), 100) as sanitized,
  regexp_replace(c, '[^\p{L}\p{N}_-]', '_', 'g') || '_' || strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y%m%d_%H%M%S') || '.html' as file
from c
"""

QUERIES = {
    "url_normalize": (url_normalize, URL_NORMALIZE),
    "url_validate": (url_validate, URL_VALIDATE),
    "url_is_absolute": (url_is_absolute, URL_IS_ABSOLUTE),
    "url_make_absolute": (url_make_absolute, URL_MAKE_ABSOLUTE),
    "url_resolve": (url_resolve, URL_RESOLVE),
    "url_error_counts": (url_error_counts, URL_ERROR_COUNTS),
    "url_dedup": (url_dedup, URL_DEDUP),
    "url_duplicates": (url_duplicates, URL_DUPLICATES),
    "url_contains": (url_contains, URL_CONTAINS),
    "url_sql_functions": (url_sql_functions, URL_SQL_FUNCTIONS),
    "context_names": (context_names, CONTEXT_NAMES),
}
