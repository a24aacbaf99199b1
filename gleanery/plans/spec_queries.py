"""Spec reading and validation over specs derived from the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import extract, validation
from gleanery.plans import views as V
from gleanery.sources import specs as S

_TEXT = ("rule", "spec_id", "step", "field", "detail")

# every rule as arithmetic over the page number, in reading order
_P = """
p as (select page_id n, page_id // 5 g, page_id % 5 + 1 ord, 'spec_' || lpad((page_id // 5)::varchar, 6, '0') spec_id,
  case when page_id % 29 = 0 then '  ' when page_id % 5 = 4 and page_id % 3 = 0 then 'step_' || (page_id - 1)
    else 'step_' || page_id end step,
  case when page_id % 19 = 5 then 'h1' when page_id % 43 = 6 then '' else 'ad' end f2 from pages),
s as (select distinct g, spec_id from p),
"""
_V = _P + """
v(rule, spec_id, step, field, detail, a, b, c, d, e) as (
  select 'V14', spec_id, null, null, 'ftp://x', 0, 0, 0, 0, 1 from s where g % 9 = 1
  union all select 'V14', spec_id, null, null, 'nope', 0, 0, 0, 0, 2 from s where g % 12 = 0
  union all select 'V17', spec_id, null, null, 'password_env', 0, 0, 0, 0, 3 from s where g % 24 = 0
  union all select 'V4', spec_id, null, null, 'login.username_env,login.password_env', 0, 0, 0, 0, 5 from s where g % 6 = 0 and (g % 18 = 0 or g % 24 = 0)
  union all select 'V13', spec_id, step, null, 'no-slash', 1, ord, 0, 0, 1 from p where n % 23 = 1
  union all select 'V15', spec_id, step, null, '//a[', 1, ord, 0, 0, 3 from p where n % 37 = 2
  union all select 'V15', spec_id, step, 'h1', '   ', 1, ord, 1, 1, 2 from p where n % 41 = 3
  union all select 'V2', spec_id, step, 'h1', 'field.xpath', 1, ord, 1, 1, 4 from p where n % 41 = 3
  union all select 'V15', spec_id, step, f2, '//p[[', 1, ord, 1, 2, 2 from p where n % 17 = 7
  union all select 'V1', spec_id, step, f2, 'field.name', 1, ord, 1, 2, 3 from p where f2 = ''
  union all select 'V6', spec_id, step, null, '2', 1, ord, 2, 1, 1 from p where n % 13 = 8
  union all select 'V7', spec_id, step, null, '-1', 1, ord, 2, 1, 2 from p where n % 13 <> 8 and n % 11 = 9
  union all select 'C1', spec_id, step, null, 'div:hover > iframe', 1, ord, 2, 1, 3 from p where n % 13 <> 8 and n % 11 <> 9 and n % 7 = 3
  union all select 'V8', spec_id, step, null, 'step.name', 1, ord, 3, 0, 0 from p where step = '  '
  union all select 'V9', spec_id, step, null, 'sideways', 1, ord, 3, 0, 1 from p where n % 31 = 10
  union all select 'V10', spec_id, step, 'h1', '2', 1, ord, 4, 0, 0 from p where f2 = 'h1'
  union all select 'V11', spec_id, null, null, 'name', 2, 0, 0, 0, 2 from s where g % 12 = 0
  union all select 'V11', spec_id, null, null, '0', 2, 0, 0, 0, 3 from s where g % 8 = 2
  union all select 'V11', spec_id, null, null, '-5', 2, 0, 0, 0, 4 from s where g % 10 = 3
  union all select 'V12', spec_id, step, null, count(*)::varchar, 2, 1, 0, 0, 0 from p group by spec_id, step having count(*) > 1
  union all select 'V16', spec_id, null, null, case when g % 7 = 4 then 'a/b' else '' end, 2, 2, 0, 0, 0 from s where g % 7 = 4 or g % 15 = 5
  union all select 'V12', spec_id, null, null, copies::varchar, 3, 0, 0, 0, 0 from (
    select spec_id, count(*) over (partition by case when g % 12 = 0 then ' ' else 'site_' || (g % 40) end) as copies from s) where copies > 1
)
"""


def spec_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.violations(V.derived_specs(spark, sf_dir)).select(*_TEXT)


SPEC_VIOLATIONS = f"with {_V} select rule, spec_id, step, field, detail from v"


def spec_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.violations(V.derived_specs(spark, sf_dir))
    return validation.first_violations(found).select(*_TEXT)


SPEC_FIRST_VIOLATION = f"""
with {_V} select rule, spec_id, step, field, detail from
(select *, row_number() over (partition by spec_id order by a, b, c, d, e, detail) k from v) where k = 1
"""


_NO = "cast(null as string)"
_GATE_LOGIN = f"""case when page_id % 4 = 0 then named_struct('url', '', 'username_xpath', '//u', 'password_xpath', '//p', 'submit_xpath', '//s',
  'username_env', 'U', 'password_env', 'P', 'post_login_wait_xpath', {_NO}, 'post_login_url_contains', {_NO}) end"""
_GATE_STEP = f"""array(named_struct('name', 'one', 'goto_url', url, 'click_xpath', case when page_id % 5 = 1 then '//b[' when page_id % 5 = 2 then '//b' end,
  'wait_xpath', {_NO}, 'wait_url_contains', {_NO}, 'execute_js', {_NO},
  'fields', array(named_struct('name', 'h1', 'xpath', '//h1', 'attribute', {_NO})),
  'frames', if(page_id % 6 = 2, array(named_struct('xpath', {_NO}, 'css', {_NO}, 'index', cast(null as int), 'name', {_NO})),
    cast(array() as array<struct<xpath:string,css:string,index:int,name:string>>)),
  'frame_exit', 'parent'))"""


def spec_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec per page: logins without a URL, frames without a selector, click paths that do not compile."""
    made = V.table(spark, sf_dir, "pages").select(
        F.format_string("spec_%d", "page_id").alias("spec_id"), F.format_string("site_%d", "page_id").alias("name"), F.lit("").alias("base_url"),
        F.expr(_GATE_LOGIN).alias("login"), F.expr(_GATE_STEP).alias("steps"), F.lit(20).alias("wait_timeout_sec"),
        F.lit(30).alias("page_load_timeout_sec"), F.lit(None).cast("string").alias("artifact_dir"), F.lit(None).cast("boolean").alias("capture_enabled"),
    )
    return validation.violations(made).select("rule", "spec_id", "step", "detail")


SPEC_GATE_VIOLATIONS = """
select 'V3' as rule, 'spec_' || page_id as spec_id, null as step, 'login.url' as detail from pages where page_id % 4 = 0
union all select 'V14', 'spec_' || page_id, null, '' from pages where page_id % 4 = 0
union all select 'V15', 'spec_' || page_id, 'one', '//b[' from pages where page_id % 5 = 1
union all select 'V5', 'spec_' || page_id, 'one', 'no selector' from pages where page_id % 6 = 2
"""


def spec_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.violations(V.derived_specs(spark, sf_dir))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SPEC_RULE_COUNTS = f"with {_V} select rule, count(*) as n from v group by rule"


def spec_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = V.derived_specs(spark, sf_dir).persist()
    return validation.clean(specs).select("spec_id", F.col("name").alias("site"))


SPEC_CLEAN = f"""
with {_V} select spec_id, 'site_' || (g % 40) as site from s where spec_id not in (select spec_id from v)
"""


def spec_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rollup(V.derived_specs(spark, sf_dir)).drop("site")


SPEC_ROLLUP = f"""
with {_P.strip().rstrip(',')}
select spec_id, count(*) as total_steps, 2 * count(*) as total_fields, any_value(g % 6 = 0) as has_login,
  bool_or(n % 13 = 8 or n % 11 = 9 or n % 7 = 3 or n % 10 = 0) as has_frames
from p group by spec_id
"""


def spec_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = S.flatten(V.derived_specs(spark, sf_dir))
    at = ["spec_id", "step_ord"]
    frames = tables.frames.select(*at, "kind", "value")
    return (
        tables.fields.join(tables.steps.select(*at, "frame_exit", "goto_url"), at)
        .join(frames, at, "left")
        .join(tables.sites.select("spec_id", "artifact_dir", "capture_enabled"), "spec_id")
        .select(*at, "field_ord", "field", "xpath", "frame_exit", "goto_url", "kind", "value", "artifact_dir", "capture_enabled")
    )


SPEC_FLATTEN = f"""
with {_P.strip().rstrip(',')},
f as (select *, 1 as field_ord, 'h1' as field, case when n % 41 = 3 then '   ' else '//h1' end as xpath from p
  union all select *, 2, f2, case when n % 17 = 7 then '//p[[' else '//div[@class="ad"]' end from p)
select spec_id, ord::int as step_ord, field_ord, field, xpath,
  case when n % 31 = 10 then 'sideways' when n % 6 = 0 then 'parent' else 'default' end as frame_exit,
  case when n % 23 = 1 then 'no-slash' when n % 3 = 1 then regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) else url end as goto_url,
  case when n % 13 = 8 then 'xpath' when n % 11 = 9 then 'index' when n % 7 = 3 then 'css' when n % 10 = 0 then 'index' end as kind,
  case when n % 13 = 8 then '//iframe' when n % 11 = 9 then '-1' when n % 7 = 3 then 'div:hover > iframe' when n % 10 = 0 then '0' end as value,
  case when g % 7 = 4 then 'a/b' when g % 15 = 5 then '' else 'artifacts' end as artifact_dir, true as capture_enabled
from f join pages on page_id = n
"""


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = S.parse_documents(V.spec_documents(spark, sf_dir))
    sites = S.flatten(S.sites_of(documents)).sites
    return sites.select("spec_id", "site", "base_url", "wait_timeout_sec", "page_load_timeout_sec")


SPEC_DOCUMENTS = r"""
select 'doc_' || lpad((page_id // 10)::varchar, 6, '0') || '#' || lpad((page_id % 10)::varchar, 9, '0') as spec_id,
  'page_' || page_id as site, regexp_extract(url, '^[a-z]+://[^/?#]+') as base_url,
  (case page_id % 7 when 0 then 15 when 1 then 3 when 2 then 12 when 4 then 1 when 5 then 8 end)::int as wait_timeout_sec,
  30 as page_load_timeout_sec
from pages where (page_id // 10) % 6 in (0, 4, 5)
"""


def spec_document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = S.parse_documents(V.spec_documents(spark, sf_dir))
    timeouts = validation.violations(S.sites_of(documents)).where("rule = 'V18'")
    return validation.document_violations(documents).unionByName(
        timeouts.select("rule", F.col("spec_id").alias("source"), "detail")
    )


SPEC_DOCUMENT_VIOLATIONS = r"""
select distinct 'V19' as rule, 'doc_' || lpad((page_id // 10)::varchar, 6, '0') as source,
  case (page_id // 10) % 6 when 1 then 'missing' when 2 then 'other' else 'unreadable' end as detail
from pages where (page_id // 10) % 6 in (1, 2, 3)
union all
select 'V18', 'doc_' || lpad((page_id // 10)::varchar, 6, '0') || '#' || lpad((page_id % 10)::varchar, 9, '0'), 'wait_timeout_sec'
from pages where (page_id // 10) % 6 in (0, 4, 5) and page_id % 7 in (3, 6)
"""


def _spec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ten lines: a document a line, some of them broken or blank, or one document with something behind it."""
    site = F.format_string('{"sites": [{"name": "page_%d", "base_url": ""}]}', F.col("page_id"))
    line = F.when(F.col("page_id") % 7 == 3, F.lit('{"sites": [')).when(F.col("page_id") % 10 == 8, F.lit("  ")).otherwise(site)
    g = F.floor(F.col("page_id") / 10)
    line = F.when((g % 3 == 2) & (F.col("page_id") % 10 > 0), F.lit("}")).otherwise(line)
    line = F.when(F.col("page_id") % 10 == 0, site).otherwise(line)
    kept = V.table(spark, sf_dir, "pages").where(~((g % 3 == 2) & (F.col("page_id") % 10 > 1)))
    texts = kept.groupBy(g.alias("g")).agg(F.array_sort(F.collect_list(F.struct("page_id", line.alias("line")))).alias("l"))
    joined = F.expr(r"array_join(transform(l, x -> x.line), if(g % 3 = 2, ' ', '\n'))")
    return texts.select(F.concat(F.lit("doc_"), F.col("g").cast("string")).alias("source"), joined.alias("value"))


def spec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the texts, and what is wrong with it."""
    documents = S.parse_documents(_spec_lines(spark, sf_dir))
    return documents.select("source", "kind", F.get("sites", F.lit(0))["name"].alias("site"))


SPEC_LINES = """
with p as (select page_id n, page_id // 10 g, page_id % 10 d from pages)
select 'doc_' || g || ':' || (d + 1) as source, case when n % 7 = 3 and d > 0 then 'unreadable' else 'list' end as kind,
  case when n % 7 <> 3 or d = 0 then 'page_' || n end as site
from p where g % 3 <> 2 and not (d = 8 and n % 7 <> 3)
  and g in (select g from p group by g having count(*) > 1)
union all
select 'doc_' || g, case when count(*) > 1 then 'unreadable' else 'list' end, case when count(*) = 1 then 'page_' || min(n) end
from p where g % 3 = 2 and d <= 1 group by g
union all
select 'doc_' || g, 'list', 'page_' || min(n) from p where g % 3 <> 2 group by g having count(*) = 1
"""


def step_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.step_targets(V.target_specs(spark, sf_dir)).select(
        "spec_id", "step_ord", "step", "target", "target_error"
    )


TARGETS = r"""
t0 as (select page_id // 5 g, page_id n, page_id % 5 + 1 ord, url,
  case when page_id % 5 = 3 then null when page_id % 15 = 4 then '/missing/page' else url end goto_url from pages),
b as (select g, case when g % 4 = 0 then regexp_extract(arg_min(url, n), '^[a-z]+://[^/?#]+') when g % 4 = 1 then regexp_extract(arg_min(url, n), '^[^?#]*') else '' end base
  from t0 group by g),
t1 as (select t0.*, base, last_value(goto_url ignore nulls) over (partition by g order by n rows between unbounded preceding and current row) last_goto
  from t0 join b using (g)),
targets as (
  select 'spec_' || lpad(g::varchar, 6, '0') spec_id, ord::int step_ord, 'step_' || n step, n,
    case when last_goto is null then nullif(base, '') when last_goto <> '/missing/page' then last_goto
      when base = '' then null else rtrim(base, '/') || last_goto end target,
    case when last_goto = '/missing/page' and base = '' then 'Cannot make absolute URL: relative URL ''/missing/page'' but invalid base_url ''''' end target_error
  from t1
  union all
  select 'spec_' || lpad(g::varchar, 6, '0'), 0, null, null, base, null from b where base <> '')
"""
STEP_TARGETS = f"with {TARGETS} select spec_id, step_ord, step, target, target_error from targets"


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.lookup(extract.step_targets(V.target_specs(spark, sf_dir)), V.table(spark, sf_dir, "pages"))
    return found.select("spec_id", "step_ord", "page_id", "lookup")


PAGE_LOOKUP = f"""
with {TARGETS}
select spec_id, step_ord, page_id, case when target_error is not null then 'url_error' when target is null then 'blank'
  when page_id is null then 'not_captured' else 'ok' end as lookup
from targets left join (select url, max(page_id) page_id from pages group by url) u on url = target
"""

QUERIES = {
    "spec_violations": (spec_violations, SPEC_VIOLATIONS),
    "spec_first_violation": (spec_first_violation, SPEC_FIRST_VIOLATION),
    "spec_gate_violations": (spec_gate_violations, SPEC_GATE_VIOLATIONS),
    "spec_rule_counts": (spec_rule_counts, SPEC_RULE_COUNTS),
    "spec_clean": (spec_clean, SPEC_CLEAN),
    "spec_rollup": (spec_rollup, SPEC_ROLLUP),
    "spec_flatten": (spec_flatten, SPEC_FLATTEN),
    "spec_documents": (spec_documents, SPEC_DOCUMENTS),
    "spec_lines": (spec_lines, SPEC_LINES),
    "spec_document_violations": (spec_document_violations, SPEC_DOCUMENT_VIOLATIONS),
    "step_targets": (step_targets, STEP_TARGETS),
    "page_lookup": (page_lookup, PAGE_LOOKUP),
}
