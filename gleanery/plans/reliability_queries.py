"""Limiter, breaker and retry operators over the event log seen as attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import errors, overlap, reliability as R
from gleanery.plans import views as V

CAPACITY, RATE = 5, 1 / 3600
RECOVERY_SEC = 6 * 3600
_BROKEN = ("error", "view")

_KINDS = ", ".join(f"'{name}'" for name in V.EXCEPTIONS)


def attempts_sql(failing: tuple[str, ...] = ("error",)) -> str:
    bad = ", ".join(f"'{name}'" for name in failing)
    kind = f"([{_KINDS}])[regexp_extract(props, '([0-9]+)', 1)::int % {len(V.EXCEPTIONS)} + 1]"
    return f"""
att as (select event_id as id, 'site_' || (user_id % 10) as site, event_type as step, ts, epoch_us(ts) as us, value as duration_sec,
  event_type not in ({bad}) as ok, case when event_type in ({bad}) then {kind} end as exception_type,
  user_id || '-' || strftime(ts, '%Y%m%d') as job_id from events)"""


# --- token bucket ------------------------------------------------------------------------


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = R.token_bucket(V.attempts(spark, sf_dir).select("id", "site", "ts"), CAPACITY, RATE)
    return replayed.select("id", "site", "admitted", F.round("tokens_after", 6).alias("tokens_after"))


# levels in whole quanta: a token is 3.6e9 of them and a microsecond adds one
_UNIT = 3_600_000_000
_SEQUENCE = "seq as (select *, row_number() over (partition by site order by us, id) k from att)"
_BUCKET = f"""
with recursive {attempts_sql()}, {_SEQUENCE},
run as (
  select id, site, k, us, true as admitted, ({CAPACITY}::bigint - 1) * {_UNIT} as level from seq where k = 1
  union all
  select s.id, s.site, s.k, s.us, least({CAPACITY} * {_UNIT}, r.level + s.us - r.us) >= {_UNIT},
    least({CAPACITY} * {_UNIT}, r.level + s.us - r.us)
      - case when least({CAPACITY} * {_UNIT}, r.level + s.us - r.us) >= {_UNIT} then {_UNIT} else 0 end
  from run r join seq s on s.site = r.site and s.k = r.k + 1)
"""
TOKEN_BUCKET = f"{_BUCKET} select id, site, admitted, round(level / {_UNIT}, 6) as tokens_after from run"


def token_bucket_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site by its own limits: even ones as above, odd ones with three tokens and half the rate."""
    log = V.attempts(spark, sf_dir).select("id", "site", "ts")
    odd = F.col("site").substr(6, 9).cast("int") % 2 == 1
    limits = log.select("site").distinct().select(
        "site", F.when(odd, RATE / 2).otherwise(RATE).alias("fill_rate"), F.when(odd, 3).otherwise(CAPACITY).alias("capacity")
    )
    replayed = R.token_bucket(log, limits=limits)
    return replayed.select("id", "site", "admitted", F.round("tokens_after", 6).alias("tokens_after"))


# a token is 7.2e9 quanta; a microsecond adds one or two
_SITES = f"""
with recursive {attempts_sql()},
own as (
  select *, split_part(site, '_', 2)::int % 2 = 1 as odd, row_number() over (partition by site order by us, id) k from att),
seq as (
  select *, (case when odd then 3 else {CAPACITY} end)::bigint * {2 * _UNIT} as room, case when odd then 1 else 2 end as gain from own),
run as (
  select id, site, k, us, true as admitted, room - {2 * _UNIT} as level from seq where k = 1
  union all
  select s.id, s.site, s.k, s.us, least(s.room, r.level + (s.us - r.us) * s.gain) >= {2 * _UNIT},
    least(s.room, r.level + (s.us - r.us) * s.gain)
      - case when least(s.room, r.level + (s.us - r.us) * s.gain) >= {2 * _UNIT} then {2 * _UNIT} else 0 end
  from run r join seq s on s.site = r.site and s.k = r.k + 1)
"""
TOKEN_BUCKET_SITES = f"{_SITES} select id, site, admitted, round(level / {2 * _UNIT}, 6) as tokens_after from run"


def rate_limit_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    admissions = R.token_bucket(V.attempts(spark, sf_dir).select("id", "site", "step", "ts"), CAPACITY, RATE)
    return errors.rate_limited(admissions).select(
        "id", "site", "error.type", "error.message", F.col("error.context.step").alias("step")
    )


RATE_LIMIT_REFUSALS = f"""
{_BUCKET} select id, att.site, 'ExtractionError' as type, 'Rate limit timeout for step ' || chr(39) || step || chr(39) as message, step
from run join att using (id) where not admitted
"""


def slow_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token a month: a site's bucket gives its first tokens and refills all the same."""
    replayed = R.token_bucket(V.attempts(spark, sf_dir).select("id", "site", "ts"), 2, 1 / (30 * 86_400))
    return replayed.select("id", "site", "admitted", F.round("tokens_after", 9).alias("tokens_after"))


_MONTH = 30 * 86_400 * 1_000_000
SLOW_BUCKET = f"""
with recursive {attempts_sql()}, {_SEQUENCE},
run as (
  select id, site, k, us, true as admitted, {_MONTH}::bigint as level from seq where k = 1
  union all
  select s.id, s.site, s.k, s.us, least({2 * _MONTH}, r.level + s.us - r.us) >= {_MONTH},
    least({2 * _MONTH}, r.level + s.us - r.us) - case when least({2 * _MONTH}, r.level + s.us - r.us) >= {_MONTH} then {_MONTH} else 0 end
  from run r join seq s on s.site = r.site and s.k = r.k + 1)
select id, site, admitted, round(level / {_MONTH}, 9) as tokens_after from run
"""


def limiter_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    sites = events.groupBy(F.concat(F.lit("site_"), F.col("user_id")).alias("site")).agg(
        (F.max("event_id") % 7 / 10.0).alias("rps"), F.count(F.lit(1)).alias("n")
    )
    rate = F.when(F.col("n") % 3 > 0, F.col("rps"))
    return R.limiter_defaults(sites, rate).select("site", "fill_rate", "capacity")


LIMITER_DEFAULTS = """
with s as (select 'site_' || user_id as site, max(event_id) % 7 / 10 as rps, count(*) n from events group by user_id)
select site, case when n % 3 > 0 then rps else 2.0::double end as fill_rate,
  greatest(1, trunc(case when n % 3 > 0 then rps else 2.0::double end * 10))::int as capacity from s
"""

# --- circuit breaker ---------------------------------------------------------------------


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breaker(V.attempts(spark, sf_dir, _BROKEN).select("id", "site", "ts", "ok"), recovery_sec=RECOVERY_SEC)


_RECOVERY_US = RECOVERY_SEC * 1_000_000
# one row: (was, state at the check, successes at the check) -> (state, failures, successes, last failure, rate)
BREAKER = f"""
with recursive {attempts_sql(_BROKEN)}, {_SEQUENCE},
run as (
  select id, site, ts, k, 'CLOSED' as was, 'CLOSED' as st0, 'CLOSED' as st, case when ok then 0 else 1 end::bigint as f, 0::bigint as s,
    case when ok then null else us end as last, case when ok then null else 1.0::double end as rate from seq where k = 1
  union all
  select id, site, ts, k, st, st0,
    case when st0 = 'OPEN' then 'OPEN' when ok and st0 = 'HALF_OPEN' and s0 + 1 >= 2 then 'CLOSED' when ok then st0
      when st0 = 'HALF_OPEN' or f + 1 >= 5 then 'OPEN' else st0 end,
    case when st0 = 'OPEN' then f when ok and (st0 = 'CLOSED' or s0 + 1 >= 2) then 0 when ok then f else f + 1 end,
    case when st0 = 'HALF_OPEN' and ok then s0 + 1 else s0 end,
    case when st0 <> 'OPEN' and not ok then us else last end,
    case when st0 <> 'OPEN' and not ok then (f + 1)::double / greatest(f + 1 + s0, 1) end
  from (select q.id, q.site, q.ts, q.k, q.us, q.ok, r.st, r.f, r.last,
      case when r.st = 'OPEN' and q.us - r.last >= {_RECOVERY_US} then 'HALF_OPEN' else r.st end as st0,
      case when r.st = 'OPEN' and q.us - r.last >= {_RECOVERY_US} then 0 else r.s end as s0
    from run r join seq q on q.site = r.site and q.k = r.k + 1))
"""


def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).select(
        "id", "site", "state_before", "permitted", "state_after", "failures", "successes",
        F.round("failure_rate", 6).alias("failure_rate"), "woke",
    )


BREAKER_REPLAY = f"""
{BREAKER} select id, site, st0 as state_before, st0 <> 'OPEN' as permitted, st as state_after, f as failures, s as successes,
  round(rate, 6) as failure_rate, was = 'OPEN' and st0 = 'HALF_OPEN' as woke from run
"""

_CHANGES = """
changes as (select site, id, ts, 0 as part, 'OPEN' as from_state, 'HALF_OPEN' as to_state from run where was = 'OPEN' and st0 = 'HALF_OPEN'
  union all select site, id, ts, 1, st0, st from run where st0 <> st)
"""


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that take minutes for every second, so that they overlap."""
    log = V.attempts(spark, sf_dir, _BROKEN).select("id", "site", "ts", "ok", (F.col("duration_sec") * 60).alias("duration_sec"))
    return overlap.breaker_events(log, recovery_sec=RECOVERY_SEC)


# one row per event: a check (kind 0), or the record (kind 1) of an attempt that is not refused
_ENDS = f"""
with recursive {attempts_sql(_BROKEN)},
ev as (
  select id, site, ok, us as t, 1 as later, 0 as kind from att
  union all
  select id, site, ok, us + round(duration_sec * 60 * 1000000)::bigint, case when round(duration_sec * 60 * 1000000) > 0 then 0 else 1 end, 1 from att),
seq as (select *, row_number() over (partition by site order by t, later, id, kind) k from ev),
run as (
  select id, site, t, k, kind, true as act, false as woke, 'CLOSED' as st0, 'CLOSED' as st, 0::bigint as f, 0::bigint as s,
    null::bigint as last, null::double as rate, []::bigint[] as refused from seq where k = 1
  union all
  select id, site, t, k, kind, act, woke, st0,
    case when kind = 0 or not act then st0 when ok and st0 = 'HALF_OPEN' and s0 + 1 >= 2 then 'CLOSED' when ok then st0
      when st0 = 'HALF_OPEN' or f + 1 >= 5 then 'OPEN' else st0 end,
    case when kind = 0 or not act then f when ok and (st0 = 'CLOSED' or (st0 = 'HALF_OPEN' and s0 + 1 >= 2)) then 0 when ok then f else f + 1 end,
    case when kind = 1 and act and ok and st0 = 'HALF_OPEN' then s0 + 1 else s0 end,
    case when kind = 1 and act and not ok then t else last end,
    case when kind = 1 and act and not ok then (f + 1)::double / greatest(f + 1 + s0, 1) end,
    case when kind = 0 and st0 = 'OPEN' then list_append(refused, id) else refused end
  from (select *, case when woke then 'HALF_OPEN' else st end as st0, case when woke then 0 else s end as s0
    from (select q.id, q.site, q.t, q.k, q.kind, q.ok, r.st, r.f, r.s, r.last, r.refused,
        q.kind = 0 and r.st = 'OPEN' and q.t - r.last >= {_RECOVERY_US} as woke, q.kind = 0 or not list_contains(r.refused, q.id) as act
      from run r join seq q on q.site = r.site and q.k = r.k + 1)))
"""


def breaker_replay_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.per_attempt(_overlapping(spark, sf_dir))
    return found.select(
        "id", "site", "state_before", "permitted", "woke", "state_after", "failures", "successes", F.round("failure_rate", 6).alias("failure_rate"),
        F.unix_micros("decided_at").alias("decided_us"),
    )


BREAKER_REPLAY_ENDS = f"""
{_ENDS} select c.id, c.site, c.st0 as state_before, c.st0 <> 'OPEN' as permitted, c.woke, coalesce(e.st, c.st) as state_after,
  coalesce(e.f, c.f) as failures, coalesce(e.s, c.s) as successes, round(e.rate, 6) as failure_rate, coalesce(e.t, c.t) as decided_us
from (select * from run where kind = 0) c left join (select * from run where kind = 1 and act) e using (site, id)
"""


def breaker_end_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.transitions(_overlapping(spark, sf_dir)).select("site", "id", F.unix_micros("ts").alias("us"), "from_state", "to_state")


BREAKER_END_TRANSITIONS = f"""
{_ENDS} select site, id, t as us, case when woke then 'OPEN' else st0 end as from_state, st as to_state from run where woke or (act and st0 <> st)
"""


def breaker_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transitions(_replayed(spark, sf_dir)).select("site", "id", "part", "from_state", "to_state")


BREAKER_TRANSITIONS = f"{BREAKER}, {_CHANGES} select site, id, part, from_state, to_state from changes"


def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transition_counts(R.transitions(_replayed(spark, sf_dir)))


TRANSITION_COUNTS = f"{BREAKER}, {_CHANGES} select site, from_state, to_state, count(*) as transitions from changes group by all"

_AT = "2024-01-20 00:00:00"


def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breaker_state(_replayed(spark, sf_dir), F.lit(_AT).cast("timestamp"), RECOVERY_SEC)


BREAKER_STATE = f"""
{BREAKER} select site, case when st = 'OPEN' and epoch_us(timestamp '{_AT}') - last >= {_RECOVERY_US} then 'HALF_OPEN' else st end as state
from run where ts <= timestamp '{_AT}' qualify row_number() over (partition by site order by k desc) = 1
"""


def circuit_open_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.circuit_open(_replayed(spark, sf_dir)).select("id", "site", "error.type", "error.message")


CIRCUIT_OPEN_RECORDS = f"""
{BREAKER} select id, site, 'CircuitBreakerOpen' as type, 'Circuit breaker is OPEN' as message from run where st0 = 'OPEN'
"""


def breaker_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gauge = R.failure_rate_gauge(_replayed(spark, sf_dir))
    return gauge.select("site", F.round("failure_rate", 6).alias("failure_rate"))


BREAKER_FAILURE_RATE = f"""
{BREAKER} select site, round(rate, 6) as failure_rate from run where rate is not null
qualify row_number() over (partition by site order by k desc) = 1
"""

# --- retries -----------------------------------------------------------------------------

_RETRYABLE = "('TimeoutException', 'StaleElementReferenceException', 'NoSuchElementException', 'NoSuchFrameException')"


def retry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        V.attempts(spark, sf_dir)
        .where(~F.col("ok"))
        .groupBy("exception_type", R.is_retryable("exception_type").alias("retryable"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


RETRY_CLASSES = f"""
with {attempts_sql()} select exception_type, exception_type in {_RETRYABLE} as retryable, count(*) as n from att where not ok group by all
"""


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies' waits, without jitter, for failed attempts numbered by their id."""
    attempt = F.pmod("id", F.lit(6)).cast("int")
    waits = [F.round(R.backoff(attempt, *R.POLICIES[name][1:]), 6).alias(name) for name in R.POLICIES]
    return V.attempts(spark, sf_dir).where(~F.col("ok")).select("id", attempt.alias("attempt"), *waits)


BACKOFF_SCHEDULE = f"""
with {attempts_sql()}, t as (select id, ok, (id % 6)::int as attempt from att)
select id, attempt, round(greatest(0.5::double, least(4.0::double, 0.5::double * power(2.0::double, attempt))), 6) as standard,
  round(greatest(0.3::double, least(8.0::double, 0.3::double * power(2.0::double, attempt))), 6) as aggressive
from t where not ok
"""


def retry_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jittered waits stay within a quarter of the plain wait and above the floor."""
    failed = V.attempts(spark, sf_dir).where(~F.col("ok"))
    attempt = (F.pmod("id", F.lit(5)) + 1).cast("int")
    plain = R.backoff(attempt, *R.POLICIES["standard"][1:])
    jittered = R.backoff(attempt, *R.POLICIES["standard"][1:], R.spread_of(F.col("id")))
    return failed.select(
        "id", ((jittered >= plain * 0.75) & (jittered <= plain * 1.25) & (jittered >= 0.1)).alias("in_range")
    )


RETRY_JITTER = f"with {attempts_sql()} select id, true as in_range from att where not ok"

_PLAN = f"""
numbered as (select *, (row_number() over (partition by site, step, job_id order by us, id))::int as attempt from att),
plan as (select *, not ok and exception_type in {_RETRYABLE} and attempt < 3 as eligible,
  not ok and exception_type in {_RETRYABLE} and attempt >= 3 as exhausted,
  case when not ok and exception_type in {_RETRYABLE} and attempt < 3 then least(4.0::double, 0.5::double * power(2.0::double, attempt)) end as wait_sec from numbered)
"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retry_plan(V.attempts(spark, sf_dir, ("error", "view", "click")))


_RETRY = f"with {attempts_sql(('error', 'view', 'click'))}, {_PLAN}"


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select(
        "id", "site", "attempt", "eligible", "exhausted", "wait_sec", F.unix_micros("next_attempt_at").alias("next_us")
    )


RETRY_PLAN = f"""
{_RETRY} select id, site, attempt, eligible, exhausted, wait_sec, us + (wait_sec * 1000000)::bigint as next_us from plan
"""


def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retry_outcome(_planned(spark, sf_dir))


RETRY_OUTCOME = f"""
{_RETRY} select site, step, job_id, attempt as attempts, ok as succeeded, exhausted, case when not ok then exception_type end as raised
from plan qualify row_number() over (partition by site, step, job_id order by attempt desc) = 1
"""

QUERIES = {
    "token_bucket": (token_bucket, TOKEN_BUCKET),
    "token_bucket_sites": (token_bucket_sites, TOKEN_BUCKET_SITES),
    "slow_bucket": (slow_bucket, SLOW_BUCKET),
    "rate_limit_refusals": (rate_limit_refusals, RATE_LIMIT_REFUSALS),
    "limiter_defaults": (limiter_defaults, LIMITER_DEFAULTS),
    "breaker_replay": (breaker_replay, BREAKER_REPLAY),
    "breaker_replay_ends": (breaker_replay_ends, BREAKER_REPLAY_ENDS),
    "breaker_end_transitions": (breaker_end_transitions, BREAKER_END_TRANSITIONS),
    "breaker_transitions": (breaker_transitions, BREAKER_TRANSITIONS),
    "transition_counts": (transition_counts, TRANSITION_COUNTS),
    "breaker_state": (breaker_state, BREAKER_STATE),
    "circuit_open_records": (circuit_open_records, CIRCUIT_OPEN_RECORDS),
    "breaker_failure_rate": (breaker_failure_rate, BREAKER_FAILURE_RATE),
    "retry_classes": (retry_classes, RETRY_CLASSES),
    "backoff_schedule": (backoff_schedule, BACKOFF_SCHEDULE),
    "retry_jitter": (retry_jitter, RETRY_JITTER),
    "retry_plan": (retry_plan, RETRY_PLAN),
    "retry_outcome": (retry_outcome, RETRY_OUTCOME),
}
