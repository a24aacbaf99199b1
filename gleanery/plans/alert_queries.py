"""Windowed series, alert rules, grouping and annotations over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import alerts as A, metrics as M, reliability as R
from gleanery.plans import metric_queries as MQ, reliability_queries as Q, views as V

DAY, SLIDE = 86_400, 21_600
_LABELS = ("site",)
_ATT = Q.attempts_sql()


def _grid(window: int = DAY, slide: int = SLIDE) -> str:
    """Every event once per grid point whose window covers it."""
    return f"""
w as (select att.*, (us // 1000000) // {slide} * {slide} + {slide} + j * {slide} as t
  from att, (select unnest(range({window // slide})) as j))"""


def _hold_sql(hold: int, slide: int = SLIDE, labels: str = "site") -> str:
    """Gaps and islands over rated(labels, t, value, active)."""
    fires = -(-hold // slide) * slide
    part = f"partition by {labels} " if labels else ""
    keys = f"{labels}, " if labels else ""
    return f"""
runs as (select *, t - row_number() over ({part}order by t) * {slide} as run from rated where active),
held as (select {keys}min(t)::bigint as pending_at, (max(t) + {slide})::bigint as resolved_at,
    case when max(t) >= min(t) + {fires} then (min(t) + {fires})::bigint end as firing_at,
    case when max(t) >= min(t) + {fires} then 'fired' else 'pending' end as outcome, arg_max(value, t) as value
  from runs group by {keys}run)"""


_HELD = ["pending_at", "firing_at", "resolved_at", "outcome"]


def success_rate_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = A.ratio(V.attempts(spark, sf_dir), _LABELS, F.col("ok"), DAY, SLIDE)
    return rated.select("site", "t", "n", F.round("value", 8).alias("success_rate"))


SUCCESS_RATE_WINDOWED = f"""
with {_ATT}, {_grid()} select site, t, count(*) as n, round(count(*) filter (ok) / count(*), 8) as success_rate from w group by site, t
"""

_BAD_RATE = 0.2
_HOLD = 2 * SLIDE


def _failure_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = A.ratio(V.attempts(spark, sf_dir), _LABELS, ~F.col("ok"), DAY, SLIDE)
    return A.evaluate(rated, _LABELS, "HighScrapeFailureRate", _BAD_RATE, _HOLD, SLIDE)


_FAILURE = f"""
{_ATT}, {_grid()},
rated as (select site, t, count(*) filter (not ok) / count(*) as value, count(*) filter (not ok) / count(*) > {_BAD_RATE} as active from w group by site, t),
{_hold_sql(_HOLD)}
"""


def alert_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failure_alerts(spark, sf_dir).select("site", *_HELD, F.round("value", 8).alias("value"))


ALERT_FAILURE_RATE = f"with {_FAILURE} select site, pending_at, firing_at, resolved_at, outcome, round(value, 8) as value from held"

_EDGES = M.HISTOGRAMS["scrape_duration_seconds"][1]


def _p95_sql() -> str:
    counts = ", ".join(f"count(*) filter (duration_sec <= {e}) as c{n}" for n, e in enumerate(_EDGES))
    cases = []
    for n, edge in enumerate(_EDGES):
        low, below = (0, "0") if n == 0 else (_EDGES[n - 1], f"c{n - 1}")
        cases.append(
            f"when c{n} >= 0.95::double * n then {low}::double + {edge - low} * coalesce((0.95::double * n - {below}) / nullif(c{n} - {below}, 0), 0)"
        )
    return f"""
h as (select site, t, count(*) as n, {counts} from w group by site, t),
p95 as (select site, t, n, case {' '.join(cases)} else {float(_EDGES[-1])} end as value from h)"""


def p95_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p95 = A.quantile_windows(V.attempts(spark, sf_dir), _LABELS, "duration_sec", _EDGES, 0.95, DAY, SLIDE)
    return p95.select("site", "t", "n", F.round("value", 6).alias("p95"))


P95_WINDOWED = f"with {_ATT}, {_grid()}, {_p95_sql()} select site, t, n, round(value, 6) as p95 from p95"

_SLOW_SEC = 120.0


def alert_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p95 = A.quantile_windows(V.attempts(spark, sf_dir), _LABELS, "duration_sec", _EDGES, 0.95, DAY, SLIDE)
    found = A.evaluate(p95, _LABELS, "SlowScrapeLatency", _SLOW_SEC, SLIDE, SLIDE)
    return found.select("site", *_HELD, F.round("value", 6).alias("value"))


ALERT_LATENCY = f"""
with {_ATT}, {_grid()}, {_p95_sql()}, rated as (select site, t, value, value > {_SLOW_SEC} as active from p95), {_hold_sql(SLIDE)}
select site, pending_at, firing_at, resolved_at, outcome, round(value, 6) as value from held
"""


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = R.transitions(Q._replayed(spark, sf_dir)).where("to_state = 'OPEN'")
    return changes.groupBy("site", F.unix_seconds("ts").alias("at_sec")).agg(F.count(F.lit(1)).alias("n"))


def alert_breaker_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literally a counter above zero: once a breaker has opened, the alert stays."""
    from pyspark.sql import Window

    opened = _opened(spark, sf_dir)
    cell = (F.ceil(F.col("at_sec") / SLIDE) * SLIDE).alias("at_sec")
    per_cell = opened.groupBy("site", cell).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("site").orderBy("at_sec")).cast("double")
    series = A.on_grid(per_cell.select("site", "at_sec", total.alias("value")), _LABELS, SLIDE)
    return A.evaluate(series, _LABELS, "CircuitBreakerOpen", hold_sec=SLIDE, slide_sec=SLIDE).select("site", *_HELD, "value")


ALERT_BREAKER_OPEN = f"""
{Q.BREAKER}, {Q._CHANGES},
o as (select site, epoch_us(ts) // 1000000 as s, count(*) n from changes where to_state = 'OPEN' group by all),
c as (select site, -(-s // {SLIDE}) * {SLIDE} + case when s % {SLIDE} > 0 and -(-s // {SLIDE}) * {SLIDE} < s then {SLIDE} else 0 end as t, sum(n) n from o group by 1, 2),
rng as (select site, min(t) lo, max(t) hi from c group by site),
g as (select site, unnest(range(lo, hi + 1, {SLIDE})) as t from rng),
rated as (select g.site, g.t, (select sum(n) from c where c.site = g.site and c.t <= g.t)::double as value, true as active from g),
{_hold_sql(SLIDE)}
select site, pending_at, firing_at, resolved_at, outcome, value from held
"""

# a synthetic memory gauge: the event value scaled to bytes, per site
_BYTES = 3.0e7


def alert_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = V.attempts(spark, sf_dir).select("site", F.unix_seconds("ts").alias("at_sec"), (F.col("duration_sec") * _BYTES).alias("value"))
    per_second = samples.groupBy("site", "at_sec").agg(F.max("value").alias("value"))
    series = A.on_grid(per_second, _LABELS, SLIDE)
    return A.evaluate(series, _LABELS, "HighMemoryUsage", hold_sec=SLIDE, slide_sec=SLIDE).select(
        "site", *_HELD, F.round("value", 2).alias("value")
    )


_POINT = f"(s + {SLIDE - 1}) // {SLIDE} * {SLIDE}"
ALERT_MEMORY = f"""
with {_ATT}, q as (select site, us // 1000000 as s, max(duration_sec * {_BYTES}) as v from att group by all),
l as (select site, {_POINT} as t, arg_max(v, s) as value from q group by 1, 2),
rng as (select site, min(t) lo, max(t) hi from l group by site),
g as (select site, unnest(range(lo, hi + 1, {SLIDE})) as t from rng),
filled as (select g.site, g.t, last_value(value ignore nulls) over (partition by g.site order by g.t rows unbounded preceding) as value
  from g left join l using (site, t)),
rated as (select *, value > 1.5e9 as active from filled), {_hold_sql(SLIDE)}
select site, pending_at, firing_at, resolved_at, outcome, round(value, 2) as value from held
"""

_SESSION_SLIDE = 3600


def alert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gauge = M.active(MQ._sessions(spark, sf_dir))
    per_second = gauge.groupBy(F.floor(F.col("at_us") / 1_000_000).alias("at_sec")).agg(
        F.max_by("active", "at_us").cast("double").alias("value")
    )
    series = A.on_grid(per_second.withColumn("job", F.lit("crawl")), ("job",), _SESSION_SLIDE)
    found = A.evaluate(series, ("job",), "TooManyActiveSessions", 4.0, _SESSION_SLIDE, _SESSION_SLIDE)
    return found.select(*_HELD, "value")


ALERT_SESSIONS = f"""
{MQ.ACTIVE},
q as (select at_us // 1000000 as s, arg_max(active, at_us)::double as v from gauge group by 1),
l as (select (s + {_SESSION_SLIDE - 1}) // {_SESSION_SLIDE} * {_SESSION_SLIDE} as t, arg_max(v, s) as value from q group by 1),
g as (select unnest(range((select min(t) from l), (select max(t) from l) + 1, {_SESSION_SLIDE})) as t),
filled as (select g.t, last_value(value ignore nulls) over (order by g.t rows unbounded preceding) as value from g left join l using (t)),
rated as (select *, value > 4 as active from filled), {_hold_sql(_SESSION_SLIDE, _SESSION_SLIDE, "")}
select pending_at, firing_at, resolved_at, outcome, value from held
"""


def alert_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold on its own, per site and step: fails in the six hours before, held for a day."""
    rated = A.ratio(V.attempts(spark, sf_dir, ("error", "view")), ("site", "step"), ~F.col("ok"), SLIDE, SLIDE)
    judged = rated.withColumn("active", F.col("value") > 0)
    return A.hold(judged, ("site", "step"), DAY, SLIDE).select("site", "step", *_HELD)


ALERT_HOLD = f"""
with {Q.attempts_sql(('error', 'view'))}, {_grid(SLIDE, SLIDE)},
rated as (select site, step, t, 0 as value, bool_or(not ok) as active from w group by site, step, t), {_hold_sql(DAY, SLIDE, "site, step")}
select site, step, pending_at, firing_at, resolved_at, outcome from held
"""

_WAIT, _INTERVAL, _REPEAT = 3600, 10_800, 43_200


def alert_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _failure_alerts(spark, sf_dir).withColumn("job", F.lit("crawl"))
    return A.group(held, ("alertname", "job"), _WAIT, _INTERVAL, _REPEAT).select(
        "alertname", "job", "notified_at", "firing", "resolved", "reason"
    )


# the same by comparing every tick with the alerts around it
ALERT_GROUPS = f"""
with recursive {_FAILURE},
f as (select firing_at as a, resolved_at as b from held where firing_at is not null),
o as (select distinct a from f where not exists (select 1 from f g where g.a < f.a and g.b >= f.a)),
i as (select o.a as opened, max(f.b) as closed from o join f on f.a >= o.a and not exists (select 1 from o p where p.a > o.a and p.a <= f.a) group by o.a),
tk as (select opened, closed, opened + {_WAIT} + k * {_INTERVAL} as tick, k
  from (select opened, closed, unnest(range(0, (greatest(closed - opened - {_WAIT}, 0) + {_INTERVAL - 1}) // {_INTERVAL} + 1)) as k from i)),
st as (select tk.*, (select count(*) from f where f.a >= tk.opened and f.a <= tick and f.b > tick and f.b <= tk.closed) as firing,
  (select count(*) from f where f.a >= tk.opened and f.b <= tk.closed and f.a <= tick and f.b > tick and (k = 0 or f.a > tick - {_INTERVAL})) as started,
  (select count(*) from f where f.a >= tk.opened and f.b <= tk.closed and k > 0 and f.a <= tick - {_INTERVAL} and f.b > tick - {_INTERVAL} and f.b <= tick) as ended from tk),
ch as (select *, started + ended > 0 as changed, max(case when started + ended > 0 then k end) over (partition by opened order by k) as lc from st)
select 'HighScrapeFailureRate' as alertname, 'crawl' as job, tick::bigint as notified_at, firing, ended as resolved,
  case when firing = 0 then 'resolved' when changed then 'changed' else 'repeat' end as reason
from ch where lc is not null and (changed or (firing > 0 and k > lc and ((k - lc) * {_INTERVAL}) % {_REPEAT} < {_INTERVAL}))
"""


def retry_rate_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    retried = R.retries(R.retry_plan(V.attempts(spark, sf_dir, ("error", "view", "click"))))
    rated = A.rate(retried, ("exception_type",), None, DAY, SLIDE)
    return rated.select("exception_type", "t", "n", F.round("rate", 10).alias("rate"))


RETRY_RATE_WINDOWED = f"""
with {Q.attempts_sql(('error', 'view', 'click')).replace('att as', 'raw as', 1)}, {Q._PLAN.replace('from att', 'from raw')},
att as (select exception_type, us from plan where eligible), {_grid()}
select exception_type, t, count(*) as n, round(count(*) / {DAY}.0::double, 10) as rate from w group by exception_type, t
"""


def transition_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = R.transition_counts(R.transitions(Q._replayed(spark, sf_dir)))
    return counted.select(
        F.format_string("%s: %s → %s", "site", "from_state", "to_state").alias("legend"), F.col("transitions").alias("value")
    )


TRANSITION_PANEL = f"""
{Q.BREAKER}, {Q._CHANGES} select site || ': ' || from_state || ' → ' || to_state as legend, count(*) as value from changes group by 1
"""


def alert_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = A.annotate(_failure_alerts(spark, sf_dir).where("outcome = 'fired'"))
    return noted.select("site", "firing_at", "alertname", "severity", "component", "summary", "description")


_PERCENT = "value * 100"
_FOUR = f"round({_PERCENT}, (3 - floor(log10({_PERCENT})))::int)"
ALERT_ANNOTATIONS = f"""
with {_FAILURE}
select site, firing_at, 'HighScrapeFailureRate' as alertname, 'warning' as severity, 'scraper' as component,
  'High scrape failure rate for ' || site as summary,
  'Failure rate is ' || regexp_replace({_FOUR}::varchar, '\\.?0*$', '') || '% for site ' || site as description
from held where outcome = 'fired'
"""


def alert_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule says about the alerts that fired under it."""
    parts = [(rule, run(spark, sf_dir)) for rule, run in _RULE_QUERIES.items()]
    fired = None
    for rule, found in parts:
        site = F.col("site") if "site" in found.columns else F.lit("")
        part = found.where("outcome = 'fired'").select(F.lit(rule).alias("alertname"), site.alias("site"), "firing_at", F.col("value").cast("double"))
        fired = part if fired is None else fired.unionByName(part)
    return A.annotate(fired).select("alertname", "site", "firing_at", "severity", "component", "summary", "description")


_RULE_QUERIES = {
    "HighScrapeFailureRate": alert_failure_rate,
    "CircuitBreakerOpen": alert_breaker_open,
    "SlowScrapeLatency": alert_latency,
    "HighMemoryUsage": alert_memory,
    "TooManyActiveSessions": alert_sessions,
}


def _digits_sql(value: str) -> str:
    """Four significant digits without trailing zeros."""
    return f"regexp_replace(round({value}, (3 - floor(log10({value})))::int)::varchar, '\\.?0*$', '')"


_PLAIN = "regexp_replace(value::varchar, '\\.0$', '')"
ALERT_NOTES = f"""
select 'HighScrapeFailureRate' as alertname, site, firing_at, 'warning' as severity, 'scraper' as component,
  'High scrape failure rate for ' || site as summary, 'Failure rate is ' || {_digits_sql('value * 100')} || '% for site ' || site as description
from ({ALERT_FAILURE_RATE}) where outcome = 'fired'
union all
select 'CircuitBreakerOpen', site, firing_at, 'critical', 'circuit-breaker', 'Circuit breaker opened for ' || site,
  'Circuit breaker has opened for site ' || site || ', indicating persistent failures' from ({ALERT_BREAKER_OPEN}) where outcome = 'fired'
union all
select 'SlowScrapeLatency', site, firing_at, 'warning', 'performance', 'Slow scrape latency for ' || site,
  '95th percentile scrape duration is ' || {_PLAIN} || 's for site ' || site from ({ALERT_LATENCY}) where outcome = 'fired'
union all
select 'HighMemoryUsage', site, firing_at, 'warning', 'resources', 'High memory usage detected',
  'Memory usage is ' || {_digits_sql('value / 1e9')} || 'GB' from ({ALERT_MEMORY}) where outcome = 'fired'
union all
select 'TooManyActiveSessions', '', firing_at, 'warning', 'resources', 'Too many active WebDriver sessions',
  {_PLAIN} || ' active sessions detected' from ({ALERT_SESSIONS}) where outcome = 'fired'
"""


def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled counter per site: the event number, starting over every thousand."""
    samples = V.attempts(spark, sf_dir).select("id", "site", "ts", F.pmod("id", F.lit(1000)).cast("double").alias("value"))
    rated = A.counter_rate(samples, _LABELS, DAY, SLIDE, ("ts", "id"))
    return rated.select("site", "t", "increase", F.round("rate", 10).alias("rate"))


COUNTER_RATE = f"""
with {_ATT.replace('att as', 'raw as', 1)},
s as (select site, us, (id % 1000)::double as v, lag((id % 1000)::double) over (partition by site order by us, id) as p from raw),
att as (select site, us, case when p is null then 0 when v < p then v else v - p end as increase from s), {_grid()}
select site, t, sum(increase) as increase, round(sum(increase) / {DAY}.0::double, 10) as rate from w group by site, t
"""

QUERIES = {
    "success_rate_windowed": (success_rate_windowed, SUCCESS_RATE_WINDOWED),
    "alert_failure_rate": (alert_failure_rate, ALERT_FAILURE_RATE),
    "p95_windowed": (p95_windowed, P95_WINDOWED),
    "alert_latency": (alert_latency, ALERT_LATENCY),
    "alert_breaker_open": (alert_breaker_open, ALERT_BREAKER_OPEN),
    "alert_memory": (alert_memory, ALERT_MEMORY),
    "alert_sessions": (alert_sessions, ALERT_SESSIONS),
    "alert_hold": (alert_hold, ALERT_HOLD),
    "alert_groups": (alert_groups, ALERT_GROUPS),
    "retry_rate_windowed": (retry_rate_windowed, RETRY_RATE_WINDOWED),
    "transition_panel": (transition_panel, TRANSITION_PANEL),
    "alert_annotations": (alert_annotations, ALERT_ANNOTATIONS),
    "alert_notes": (alert_notes, ALERT_NOTES),
    "counter_rate": (counter_rate, COUNTER_RATE),
}
