"""Counters, histograms, gauges and their exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import extract, metrics as M, reliability as R
from gleanery.plans import reliability_queries as Q, views as V
from gleanery.plans.extract_queries import BASE

_ATT = Q.attempts_sql()


def scrapes_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scrapes_total(V.attempts(spark, sf_dir))


SCRAPES_TOTAL = f"""
with {_ATT} select site, case when ok then 'success' else 'failure' end as status, count(*) as value from att group by all
"""


def login_attempts_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = V.attempts(spark, sf_dir, ("error",)).where("step in ('signup', 'error')")
    return M.login_attempts_total(logins)


LOGIN_ATTEMPTS_TOTAL = f"""
with {_ATT} select site, case when ok then 'success' else 'failed' end as status, count(*) as value
from att where step in ('signup', 'error') group by all
"""


def steps_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.steps_executed_total(V.attempts(spark, sf_dir, ("error", "view")))


STEPS_TOTAL = f"""
with {Q.attempts_sql(('error', 'view'))} select site, step, case when ok then 'success' else 'failure' end as status, count(*) as value
from att group by all
"""


def fields_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.outcomes_by_page(V.pages(spark, sf_dir), V.page_specs(spark, sf_dir), page_site=V.page_group())
    return M.fields_extracted_total(extract.long(found))


FIELDS_TOTAL = f"with {BASE} select site, step, field, count(*) as value from fields where status = 'found' group by all"


def fields_total_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.outcomes_by_page(V.pages(spark, sf_dir), V.page_specs(spark, sf_dir), page_site=V.page_group())
    return M.fields_extracted_total(extract.long(found), legacy_step_label=True)


FIELDS_TOTAL_LEGACY = f"""
with {BASE} select site, 'current' as step, field, count(*) as value from fields where status = 'found' group by all
"""


def retries_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = R.retry_plan(V.attempts(spark, sf_dir, ("error", "view", "click")))
    return M.retries_total(R.retries(plan))


RETRIES_TOTAL = f"{Q._RETRY} select site, exception_type, count(*) as value from plan where eligible group by all"


def _histogram_sql(source: str, labels: str, value: str, edges: tuple[float, ...]) -> str:
    rows = " union all ".join(
        [f"select {float(e)}::double as edge, '{float(e)}' as le" for e in edges]
        + ["select 'infinity'::double as edge, '+Inf' as le"]
    )
    return f"""
with {source}, edges as ({rows})
select {labels}, le, count(*) filter ({value} <= edge) as value, round(sum({value}), 4) as sum, count({value}) as count
from att, edges group by {labels}, le"""


def _histogram(df: DataFrame, name: str, value: str = "duration_sec") -> DataFrame:
    labels, edges = M.HISTOGRAMS[name]
    return M.histogram(df, labels, value, edges).withColumn("sum", F.round("sum", 4))


def scrape_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(V.attempts(spark, sf_dir), "scrape_duration_seconds")


SCRAPE_HISTOGRAM = _histogram_sql(_ATT, "site", "duration_sec", M.HISTOGRAMS["scrape_duration_seconds"][1])


def step_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(V.attempts(spark, sf_dir), "step_duration_seconds")


STEP_HISTOGRAM = _histogram_sql(_ATT, "site, step", "duration_sec", M.HISTOGRAMS["step_duration_seconds"][1])

_WAIT_TYPES = dict(zip(("error", "view", "click", "signup", "purchase"), M.WAIT_TYPES, strict=True))


def wait_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits by type; successful and failed ones alike."""
    kinds = F.create_map(*[F.lit(x) for pair in _WAIT_TYPES.items() for x in pair])
    waits = V.attempts(spark, sf_dir).select(kinds[F.col("step")].alias("wait_type"), (F.col("duration_sec") / 4).alias("duration_sec"))
    return _histogram(waits, "wait_duration_seconds")


_WAIT_CASE = "case step " + " ".join(f"when '{k}' then '{v}'" for k, v in _WAIT_TYPES.items()) + " end"
WAIT_HISTOGRAM = _histogram_sql(
    f"{_ATT.replace('att as', 'raw as', 1)}, att as (select {_WAIT_CASE} as wait_type, duration_sec / 4 as duration_sec from raw)",
    "wait_type", "duration_sec", M.HISTOGRAMS["wait_duration_seconds"][1],
)


def page_load_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(V.attempts(spark, sf_dir).where("step = 'view'"), "page_load_duration_seconds")


PAGE_LOAD_HISTOGRAM = _histogram_sql(
    f"{_ATT.replace('att as', 'raw as', 1)}, att as (select * from raw where step = 'view')",
    "site", "duration_sec", M.HISTOGRAMS["page_load_duration_seconds"][1],
)

# sessions last their event's value in minutes, so that many overlap
_SESSION_US = 60_000_000


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros("ts")
    return V.attempts(spark, sf_dir).select(
        start.alias("start_us"), (start + F.round(F.col("duration_sec") * _SESSION_US).cast("long")).alias("end_us")
    )


ACTIVE = f"""
with {_ATT},
d as (select us as at_us, 1 as delta from att union all select us + round(duration_sec * {_SESSION_US})::bigint, -1 from att),
i as (select at_us, sum(delta) as delta from d group by at_us),
gauge as (select at_us, (sum(delta) over (order by at_us))::bigint as active from i)
"""


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.active(_sessions(spark, sf_dir))


ACTIVE_SESSIONS = f"{ACTIVE} select at_us, active from gauge"


def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.peak(M.active(_sessions(spark, sf_dir)))


PEAK_CONCURRENCY = f"{ACTIVE} select active as peak, at_us from gauge order by active desc, at_us limit 1"


def failure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.failure_ratio(V.attempts(spark, sf_dir)).withColumn("failure_ratio", F.round("failure_ratio", 8))


FAILURE_RATIO = f"""
with {_ATT} select site, count(*) as attempts, count(*) filter (not ok) as failures,
  round(count(*) filter (not ok) / count(*), 8) as failure_ratio from att group by site
"""


def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = M.duration_stats(V.attempts(spark, sf_dir), ("site", "step"))
    return stats.select("site", "step", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "longest")


DURATION_STATS = f"""
with {_ATT} select site, step, count(*) as n, round(sum(duration_sec), 4) as total, round(sum(duration_sec) / count(*), 6) as mean,
  max(duration_sec) as longest from att group by all
"""


def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample lines of a counter and a histogram; the sum is rounded like a stored sample."""
    attempts = V.attempts(spark, sf_dir)
    labels, edges = M.HISTOGRAMS["scrape_duration_seconds"]
    hist = M.histogram(attempts, labels, "duration_sec", edges).withColumn("sum", F.round("sum", 2))
    return M.exposition(
        [
            M.counter_lines(M.scrapes_total(attempts), "scrapes_total", M.COUNTERS["scrapes_total"]),
            M.histogram_lines(hist, "scrape_duration_seconds", labels),
        ]
    )


METRICS_EXPOSITION = f"""
with h as ({SCRAPE_HISTOGRAM}), c as ({SCRAPES_TOTAL}),
t as (select *, 'selenium_scrape_duration_seconds' as metric from h)
select 'selenium_scrapes_total' as metric, 'selenium_scrapes_total{{site="' || site || '",status="' || status || '"}} ' || value || '.0' as value from c
union all select metric, metric || '_bucket{{site="' || site || '",le="' || le || '"}} ' || value || '.0' from t
union all select metric, metric || '_count{{site="' || site || '"}} ' || count || '.0' from t where le = '+Inf'
union all select metric, metric || '_sum{{site="' || site || '"}} ' || round(sum, 2)::double from t where le = '+Inf'
"""

def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gauge that follows the events: their value in kilobytes."""
    return V.attempts(spark, sf_dir).select(F.unix_micros("ts").alias("us"), "id", (F.col("duration_sec") * 1000).alias("value"))


def metrics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters, histograms and gauges as one page of text; sums and shares are rounded like stored samples."""
    rounded = lambda df, digits, *names: df.withColumns({c: F.round(c, digits) for c in names})
    failures = R.failure_rate_gauge(Q._replayed(spark, sf_dir)).withColumnRenamed("failure_rate", "value")
    active = M.current(M.active(_sessions(spark, sf_dir)), (), "active", "at_us")
    return M.page({
        "scrapes_total": scrapes_total(spark, sf_dir),
        "login_attempts_total": login_attempts_total(spark, sf_dir),
        "steps_executed_total": steps_total(spark, sf_dir),
        "fields_extracted_total": fields_total(spark, sf_dir),
        "retries_total": retries_total(spark, sf_dir),
        "circuit_breaker_state_changes_total": Q.transition_counts(spark, sf_dir).withColumnRenamed("transitions", "value"),
        "scrape_duration_seconds": rounded(scrape_histogram(spark, sf_dir), 2, "sum"),
        "step_duration_seconds": rounded(step_histogram(spark, sf_dir), 2, "sum"),
        "wait_duration_seconds": rounded(wait_histogram(spark, sf_dir), 2, "sum"),
        "page_load_duration_seconds": rounded(page_load_histogram(spark, sf_dir), 2, "sum"),
        "active_sessions": active,
        "circuit_breaker_failure_rate": rounded(failures, 4, "value"),
        "memory_usage_bytes": rounded(M.current(_memory(spark, sf_dir), (), "value", "us", "id"), 2, "value"),
    })


def _label_sql(labels: tuple[str, ...], le: bool = False) -> str:
    parts = [f"""'{c}="' || {c} || '"'""" for c in labels] + (["""'le="' || le || '"'"""] if le else [])
    return "'{' || " + " || ',' || ".join(parts) + " || '}'" if parts else "''"


def _family_sql(name: str, sql: str, value: str = "value || '.0'") -> str:
    """Lines of one family from the SQL of its rows."""
    full, kind = M.PREFIX + name, "histogram" if name in M.HISTOGRAMS else "counter" if name in M.COUNTERS else "gauge"
    head = f"select '{full}' as metric, 0 as part, '# HELP {full} {M.HELP[name]}' as value union all select '{full}', 1, '# TYPE {full} {kind}'"
    if kind != "histogram":
        labels = M.COUNTERS.get(name, M.GAUGES.get(name))
        return f"{head} union all select '{full}', 2, '{full}' || {_label_sql(labels)} || ' ' || {value} from ({sql})"
    labels = M.HISTOGRAMS[name][0]
    last = "where le = '+Inf'"
    return f"""{head}
      union all select '{full}', 2, '{full}_bucket' || {_label_sql(labels, True)} || ' ' || value || '.0' from ({sql})
      union all select '{full}', 2, '{full}_count' || {_label_sql(labels)} || ' ' || count || '.0' from ({sql}) {last}
      union all select '{full}', 2, '{full}_sum' || {_label_sql(labels)} || ' ' || round(sum, 2)::double from ({sql}) {last}"""


_MEMORY = f"with {_ATT} select round(arg_max(duration_sec * 1000, (us, id)), 2)::double as value from att"
METRICS_PAGE = " union all ".join([
    _family_sql("scrapes_total", SCRAPES_TOTAL),
    _family_sql("login_attempts_total", LOGIN_ATTEMPTS_TOTAL),
    _family_sql("steps_executed_total", STEPS_TOTAL),
    _family_sql("fields_extracted_total", FIELDS_TOTAL),
    _family_sql("retries_total", RETRIES_TOTAL),
    _family_sql("circuit_breaker_state_changes_total", Q.TRANSITION_COUNTS, "transitions || '.0'"),
    _family_sql("scrape_duration_seconds", SCRAPE_HISTOGRAM),
    _family_sql("step_duration_seconds", STEP_HISTOGRAM),
    _family_sql("wait_duration_seconds", WAIT_HISTOGRAM),
    _family_sql("page_load_duration_seconds", PAGE_LOAD_HISTOGRAM),
    _family_sql("active_sessions", f"{ACTIVE} select arg_max(active, at_us) as value from gauge"),
    _family_sql("circuit_breaker_failure_rate", Q.BREAKER_FAILURE_RATE, "round(failure_rate, 4)::double"),
    _family_sql("memory_usage_bytes", _MEMORY, "value"),
])

QUERIES = {
    "scrapes_total": (scrapes_total, SCRAPES_TOTAL),
    "login_attempts_total": (login_attempts_total, LOGIN_ATTEMPTS_TOTAL),
    "steps_total": (steps_total, STEPS_TOTAL),
    "fields_total": (fields_total, FIELDS_TOTAL),
    "fields_total_legacy": (fields_total_legacy, FIELDS_TOTAL_LEGACY),
    "retries_total": (retries_total, RETRIES_TOTAL),
    "scrape_histogram": (scrape_histogram, SCRAPE_HISTOGRAM),
    "step_histogram": (step_histogram, STEP_HISTOGRAM),
    "wait_histogram": (wait_histogram, WAIT_HISTOGRAM),
    "page_load_histogram": (page_load_histogram, PAGE_LOAD_HISTOGRAM),
    "active_sessions": (active_sessions, ACTIVE_SESSIONS),
    "peak_concurrency": (peak_concurrency, PEAK_CONCURRENCY),
    "failure_ratio": (failure_ratio, FAILURE_RATIO),
    "duration_stats": (duration_stats, DURATION_STATS),
    "metrics_page": (metrics_page, METRICS_PAGE),
    "metrics_exposition": (metrics_exposition, METRICS_EXPOSITION),
}
