"""Load-log operators over the event log seen as requests, and JSON shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import extract, loadlog as L, serialization as J
from gleanery.plans import views as V
from gleanery.plans.extract_queries import BASE

_REQUESTS = """
raw as (select *, regexp_extract(props, '([0-9]+)', 1)::int as k from events),
req as (select event_id as id, ts, epoch_us(ts) // 1000000 as s, event_type as kind, k, value * 100 as response_ms,
  case when event_type = 'error' then 500 when k % 10 = 0 then 404 else 200 end as status, (k * 20)::bigint as length,
  case event_type when 'view' then 'GET /healthz' when 'click' then 'REAL /metrics' when 'signup' then 'POST /api/Scrape'
    when 'purchase' then 'GET /browser/resources' else 'CIRCUIT_TEST /error' end as name from raw)
"""


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.summary(V.requests(spark, sf_dir), 3600)
    return found.select(
        "total_requests", "total_failures", F.round("avg_response_time", 6).alias("avg_response_time"),
        F.round("max_response_time", 6).alias("max_response_time"),
        F.round("requests_per_second", 8).alias("requests_per_second"), F.round("failure_rate", 8).alias("failure_rate"),
    )


LOAD_SUMMARY = f"""
with {_REQUESTS}
select count(*) as total_requests, count(*) filter (status >= 400) as total_failures, round(sum(response_ms) / count(*), 6) as avg_response_time,
  round(max(response_ms), 6) as max_response_time,
  round(count(*) filter (s > (select max(s) from req) - 3600) / 3600, 8) as requests_per_second,
  round(count(*) filter (status >= 400) / count(*), 8) as failure_rate from req
"""


def slow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = V.requests(spark, sf_dir)
    every = L.slow(requests).select("id", F.lit("slow").alias("limit"))
    real = L.slow(requests, L.SLOW_REAL_MS, "REAL").select("id", F.lit("slow_real").alias("limit"))
    return every.unionByName(real)


SLOW_REQUESTS = f"""
with {_REQUESTS} select id, 'slow' as "limit" from req where response_ms > 5000
union all select id, 'slow_real' from req where response_ms > 10000 and contains(name, 'REAL')
"""


def endpoint_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.categories(V.requests(spark, sf_dir))


ENDPOINT_CATEGORIES = f"""
with {_REQUESTS}, d as (select distinct lower(name) as name, name as raw from req)
select count(*) filter (contains(name, 'scrape')) as scraping_requests,
  count(*) filter (contains(name, 'health') or contains(name, 'ready') or contains(name, 'metrics')) as monitoring_requests,
  count(*) filter (contains(name, 'browser')) as browser_requests from d
"""

_STATUS = "when status <> 200 then 'status ' || status when k % 7 = 0 then 'invalid format'"


def response_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON status, required text and line count checks on health answers."""
    requests = V.requests(spark, sf_dir).where("kind = 'view'")
    return requests.select(
        "id",
        L.status_verdict().alias("healthy"),
        L.status_verdict(("healthy", "ready")).alias("ready"),
        L.text_verdict(("status", "healthy")).alias("texts"),
        L.line_count_verdict().alias("lines"),
    )


RESPONSE_VERDICTS = f"""
with {_REQUESTS}
select id, case {_STATUS} when k % 3 = 0 then 'unhealthy status' else 'pass' end as healthy,
  case {_STATUS} else 'pass' end as ready,
  case when status <> 200 then 'status ' || status when k % 7 = 0 then 'missing status,healthy'
    when k % 3 = 0 then 'missing healthy' else 'pass' end as texts,
  case when status <> 200 then 'status ' || status else 'insufficient data' end as lines
from req where kind = 'view'
"""


def threshold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    rules = [
        (kind == "signup", L.threshold_verdict("quality")),
        (kind == "click", L.threshold_verdict("jobs")),
        (kind == "purchase", L.threshold_verdict("resources")),
        (kind == "view", L.threshold_verdict("results")),
    ]
    return L.verdicts(V.requests(spark, sf_dir).where("kind <> 'error'"), rules).select("id", "verdict")


THRESHOLD_CHECKS = f"""
with {_REQUESTS}
select id, case {_STATUS} when kind = 'signup' and k < 80 then 'quality too low' when kind = 'click' and k * 2 > 100 then 'too many active jobs'
  when kind = 'purchase' and k > 90 then 'high cpu' when kind = 'purchase' and 99 - k > 85 then 'high memory'
  when kind = 'view' then 'no results' else 'pass' end as verdict
from req where kind <> 'error'
"""


def expected_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.requests(spark, sf_dir).select(
        "id",
        L.expected_failure_verdict().alias("expected"),
        L.accepted_verdict(200, 404).alias("external"),
        L.content_verdict().alias("content"),
    )


EXPECTED_FAILURES = f"""
with {_REQUESTS}
select id, case when status >= 400 then 'pass' else 'expected failure' end as expected,
  case when status in (200, 404) then 'pass' else 'status ' || status end as external,
  case when status <> 200 then 'status ' || status when length > 1000 then 'pass' else 'content too small' end as content from req
"""


def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.outcomes_by_page(V.pages(spark, sf_dir), V.page_specs(spark, sf_dir), page_site=V.page_group())
    scored = L.quality(extract.long(found))
    return scored.select("site", F.round("quality_score", 8).alias("quality_score"), "low")


EXTRACTION_QUALITY = f"""
with {BASE}, q as (select site, count(*) filter (status = 'found' and value <> '') / count(*) as score from fields group by site)
select site, round(score, 8) as quality_score, score < 0.8 as low from q
"""

# --- JSON shapes -------------------------------------------------------------------------


def to_jsonable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    whole = rows.withColumn("second", F.date_trunc("second", "ts"))
    return J.lines(J.to_jsonable(whole))


TO_JSONABLE = r"""
select '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end
  || '","event_type":"' || event_type || '","value":' || value || ',"second":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' as value
from events
"""


def json_map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").select(
        "event_id", F.create_map(F.col("user_id"), F.create_map(F.col("event_id"), F.col("event_type"))).alias("m")
    )
    return J.to_jsonable(rows).select("event_id", J.dumps(F.col("m")).alias("json"))


def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times inside arrays, structs and maps."""
    ts = F.col("ts").cast("timestamp")
    inner = F.struct(ts.alias("at"), F.create_map(ts.cast("date"), F.date_trunc("second", ts)).alias("by_day"))
    rows = V.table(spark, sf_dir, "events").select("event_id", F.array(inner).alias("seen"))
    return J.to_jsonable(rows).select("event_id", J.dumps(F.col("seen")).alias("json"))


JSON_NESTED = r"""
select event_id, '[{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || '","by_day":{"' || strftime(ts, '%Y-%m-%d') || '":"'
  || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}}]' as json
from events
"""


JSON_MAP_KEYS = """
select event_id, '{"' || user_id || '":{"' || event_id || '":"' || event_type || '"}}' as json from events
"""


def json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.col("event_type").alias("kind"), F.lit('a "b" : c').alias("note"))
    value = F.struct("event_id", inner.alias("of"), F.lit(None).cast("string").alias("absent"))
    return V.table(spark, sf_dir, "events").select("event_id", J.dumps(value, pretty=True).alias("json"))


JSON_PRETTY = r"""
select event_id, '{' || chr(10) || '  "event_id": ' || event_id || ',' || chr(10) || '  "of": {' || chr(10) || '    "kind": "' || event_type
  || '",' || chr(10) || '    "note": "a \"b\" : c"' || chr(10) || '  }' || chr(10) || '}' as json from events
"""

QUERIES = {
    "load_summary": (load_summary, LOAD_SUMMARY),
    "slow_requests": (slow_requests, SLOW_REQUESTS),
    "endpoint_categories": (endpoint_categories, ENDPOINT_CATEGORIES),
    "response_verdicts": (response_verdicts, RESPONSE_VERDICTS),
    "threshold_checks": (threshold_checks, THRESHOLD_CHECKS),
    "expected_failures": (expected_failures, EXPECTED_FAILURES),
    "extraction_quality": (extraction_quality, EXTRACTION_QUALITY),
    "to_jsonable": (to_jsonable, TO_JSONABLE),
    "json_nested": (json_nested, JSON_NESTED),
    "json_map_keys": (json_map_keys, JSON_MAP_KEYS),
    "json_pretty": (json_pretty, JSON_PRETTY),
}
