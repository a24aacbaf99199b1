"""Streaming operators run over the tables as file streams, written out and read back.

The event log is one file, so everything arrives in one micro-batch; the batch that follows
closes what the watermark has passed. Rows of the last watermark delay stay open, in the
stream and in the SQL counterparts alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import metrics as M, reliability as R
from gleanery.plans import alert_queries as A, extract_queries as X, reliability_queries as Q, views as V
from gleanery.session import shared_dir, state_partitions
from gleanery.sources.pages import PAGE_SCHEMA, read_page_stream
from gleanery.streaming import cells as C, late, retries, stateful as S, windows as W

_EVENT_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
_OPEN = "us // 1000 * 1000 <= (select max(us) // 1000 * 1000 from att) - 600 * 1000000"


def _drained(df: DataFrame) -> DataFrame:
    """Run the stream to its end into a table of its own in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = (
        df.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with state_partitions(spark):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def _attempts(spark: SparkSession, sf_dir: str, failing: tuple[str, ...] = ("error",)) -> DataFrame:
    events = (
        spark.readStream.schema(_EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return V.attempts_of(events, failing)


def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_page_stream(spark, sf_dir, schema=PAGE_SCHEMA, files="pages.parquet")
    done = W.extract_stream(pages, V.page_specs(spark, sf_dir), page_site=V.page_group())
    return _drained(done.select("site", "page_id", "step_ord", "step", F.to_json("data").alias("data")))


def stream_unique_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_page_stream(spark, sf_dir, schema=PAGE_SCHEMA, files="pages.parquet")
    forms = F.array(F.col("url"), F.regexp_replace("url", "^http", "HTTP"), F.concat(F.lit(" "), F.col("url")))
    copies = pages.select("page_id", F.explode(forms).alias("url"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("fetched_at"))
    return _drained(W.dedup_stream(copies, "fetched_at").select("norm_url"))


def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = R.token_bucket(_attempts(spark, sf_dir), Q.CAPACITY, Q.RATE)
    return _drained(admitted).select("id", "site", "admitted", F.round("tokens_after", 6).alias("tokens_after"))


STREAM_TOKEN_BUCKET = f"""
{Q._BUCKET} select id, site, admitted, round(level / {Q._UNIT}, 6) as tokens_after from run where {_OPEN}
"""


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = R.breaker(_attempts(spark, sf_dir, Q._BROKEN), recovery_sec=Q.RECOVERY_SEC)
    return _drained(replayed).select("id", "site", "state_before", "permitted", "state_after", "failures")


STREAM_BREAKER = f"""
{Q.BREAKER} select id, site, st0 as state_before, st0 <> 'OPEN' as permitted, st as state_after, f as failures
from run join att using (id, site) where {_OPEN}
"""

_CLOSED = "t * 1000000 <= (select max(us) from att) - 600 * 1000000"


def stream_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = W.ratio_stream(_attempts(spark, sf_dir), ("site",), F.col("ok"), A.DAY, A.SLIDE)
    return _drained(rated).select("site", "t", "n", F.round("value", 8).alias("success_rate"))


STREAM_SUCCESS_RATE = f"select * from ({A.SUCCESS_RATE_WINDOWED}) where t * 1000000 <= (select max(epoch_us(ts)) from events) - 600 * 1000000"


def stream_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = M.HISTOGRAMS["scrape_duration_seconds"][1]
    p95 = W.quantile_stream(_attempts(spark, sf_dir), ("site",), "duration_sec", edges, 0.95, A.DAY, A.SLIDE)
    return _drained(p95).select("site", "t", "n", F.round("value", 6).alias("p95"))


STREAM_P95 = f"select * from ({A.P95_WINDOWED}) where t * 1000000 <= (select max(epoch_us(ts)) from events) - 600 * 1000000"


def stream_failure_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert intervals that ended before the stream did."""
    rated = W.ratio_stream(_attempts(spark, sf_dir), ("site",), ~F.col("ok"), A.DAY, A.SLIDE)
    found = W.alert_stream(rated, ("site",), "HighScrapeFailureRate", A._BAD_RATE, A._HOLD, A.SLIDE)
    return _drained(found).select("site", "pending_at", "firing_at", "resolved_at", "outcome", F.round("value", 8).alias("value"))


# a run has ended once a later, closed evaluation shows it
STREAM_FAILURE_ALERTS = f"""
select * from ({A.ALERT_FAILURE_RATE}) where resolved_at * 1000000 <= (select max(epoch_us(ts)) from events) - 600 * 1000000
"""

_WEEKS = ["day(ts) <= 7", "day(ts) between 8 and 14", "day(ts) between 15 and 21", "day(ts) > 21"]


def _in_parts(spark: SparkSession, sf_dir: str, parts: list[str], failing: tuple[str, ...] = ("error",)) -> DataFrame:
    """The event log as files that arrive one after the other, each a micro-batch."""
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    events = V.table(spark, sf_dir, "events")
    for part in parts:  # one file each: the source takes files by their age
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return V.attempts_of(source, failing)


_CELL = 3600 * 1_000_000
_CELL_CLOSED = f"(us // {_CELL} + 1) * {_CELL} <= (select max(us) // 1000 * 1000 from att) - 600 * 1000000"


def stream_bucket_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = C.token_bucket_cells(_in_parts(spark, sf_dir, _WEEKS), Q.CAPACITY, Q.RATE, cell_sec=3600)
    return _drained(admitted).select("id", "site", "admitted", F.round("tokens_after", 6).alias("tokens_after"))


STREAM_BUCKET_CELLS = f"""
{Q._BUCKET} select id, site, admitted, round(level / {Q._UNIT}, 6) as tokens_after from run where {_CELL_CLOSED}
"""


def stream_breaker_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = C.breaker_cells(_in_parts(spark, sf_dir, _WEEKS, Q._BROKEN), recovery_sec=Q.RECOVERY_SEC, cell_sec=3600)
    return _drained(replayed).select("id", "site", "state_before", "permitted", "state_after", "failures", "woke")


STREAM_BREAKER_CELLS = f"""
{Q.BREAKER} select id, site, st0 as state_before, st0 <> 'OPEN' as permitted, st as state_after, f as failures,
  was = 'OPEN' and st0 = 'HALF_OPEN' as woke
from run join att using (id, site) where {_CELL_CLOSED}
"""


def stream_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments at which breakers wake up, whether or not an attempt follows."""
    rules = R.BreakerRules(recovery_us=Q.RECOVERY_SEC * R.MICROS)
    told = S.breaker_stream(_in_parts(spark, sf_dir, _WEEKS, Q._BROKEN), rules, timers=True)
    return _drained(told).where("id is null").select("site", F.unix_micros("ts").alias("us"), "state_before", "state_after")


STREAM_RECOVERIES = f"""
{Q.BREAKER} select distinct site, last + {Q._RECOVERY_US} as us, 'OPEN' as state_before, 'HALF_OPEN' as state_after
from run where st = 'OPEN' and last + {Q._RECOVERY_US} <= (select max(us) // 1000 * 1000 from att) - 600 * 1000000
"""


def stream_late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come too late, per site: one event in seven of the first ten days comes last."""
    held = "event_id % 7 = 0 and day(ts) <= 10"
    log = _in_parts(spark, sf_dir, [f"day(ts) <= 10 and not ({held})", "day(ts) > 10", held])
    folder = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    late.split_late(log, folder).awaitTermination()
    return late.late_counts(late.late_rows(spark, folder), "site")


STREAM_LATE_COUNTS = f"""
with {Q.attempts_sql()} select site, count(*) as late from att
where id % 7 = 0 and day(ts) <= 10 and us <= (select max(us) // 1000 * 1000 from att where day(ts) > 10) - 600 * 1000000 group by site
"""

_TRIES = ("error", "view", "click")


def stream_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = R.retry_plan(_in_parts(spark, sf_dir, _WEEKS, _TRIES))
    return _drained(planned).select(
        "id", "site", "attempt", "eligible", "exhausted", "wait_sec", F.unix_micros("next_attempt_at").alias("next_us")
    )


STREAM_RETRY_PLAN = f"select p.* from ({Q.RETRY_PLAN}) p join events e on e.event_id = p.id where epoch_us(e.ts) <= (select max(epoch_us(ts)) // 1000 * 1000 from events) - 600 * 1000000"


def stream_retry_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = retries.retry_rate_stream(R.retry_plan(_in_parts(spark, sf_dir, _WEEKS, _TRIES)), A.DAY, A.SLIDE)
    return _drained(rated).select("exception_type", "t", "n", F.round("rate", 10).alias("rate"))


STREAM_RETRY_RATE = f"select * from ({A.RETRY_RATE_WINDOWED}) where t * 1000000 <= (select max(epoch_us(ts)) from events) - 600 * 1000000"

QUERIES = {
    "stream_extract": (stream_extract, X.STREAM_MODE_STEPS),
    "stream_unique_pages": (stream_unique_pages, "select distinct url as norm_url from pages"),
    "stream_token_bucket": (stream_token_bucket, STREAM_TOKEN_BUCKET),
    "stream_breaker": (stream_breaker, STREAM_BREAKER),
    "stream_success_rate": (stream_success_rate, STREAM_SUCCESS_RATE),
    "stream_p95": (stream_p95, STREAM_P95),
    "stream_bucket_cells": (stream_bucket_cells, STREAM_BUCKET_CELLS),
    "stream_breaker_cells": (stream_breaker_cells, STREAM_BREAKER_CELLS),
    "stream_recoveries": (stream_recoveries, STREAM_RECOVERIES),
    "stream_late_counts": (stream_late_counts, STREAM_LATE_COUNTS),
    "stream_retry_plan": (stream_retry_plan, STREAM_RETRY_PLAN),
    "stream_retry_rate": (stream_retry_rate, STREAM_RETRY_RATE),
    "stream_failure_alerts": (stream_failure_alerts, STREAM_FAILURE_ALERTS),
}
