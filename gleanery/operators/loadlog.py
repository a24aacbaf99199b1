"""Load-test logs: summary, slow requests, endpoint categories and response verdicts.

``requests(id, ts, name, method, status, response_ms, length, body, failed)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Thresholds, endpoint words and verdict texts.
SLOW_MS, SLOW_REAL_MS = 5_000, 10_000
CATEGORIES = {
    "scraping_requests": ("scrape",),
    "monitoring_requests": ("health", "ready", "metrics"),
    "browser_requests": ("browser",),
}
MIN_QUALITY, MAX_ACTIVE_JOBS, MAX_CPU, MAX_MEMORY = 0.8, 100, 90, 85
MIN_CONTENT_BYTES = 1000
RECENT_SEC = 10


def summary(requests: DataFrame, recent_sec: int = RECENT_SEC) -> DataFrame:
    """Totals, latency and the request rate over the trailing ``recent_sec``.

    Requests are first reduced per second, so the trailing rate needs no second scan of the log.
    """
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).alias("second")
    per_second = requests.groupBy(second).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("failed").alias("failures"),
        F.sum("response_ms").alias("ms"),
        F.max("response_ms").alias("slowest"),
    )
    end = per_second.agg(F.max("second")).scalar()
    return per_second.withColumn("end", end).agg(
        F.sum("n").alias("total_requests"),
        F.sum("failures").alias("total_failures"),
        (F.sum("ms") / F.sum("n")).alias("avg_response_time"),
        F.max("slowest").alias("max_response_time"),
        (F.sum(F.when(F.col("second") > F.col("end") - recent_sec, F.col("n")).otherwise(0)) / F.lit(float(recent_sec))).alias(
            "requests_per_second"
        ),
        (F.sum("failures") / F.sum("n")).alias("failure_rate"),
    )


def slow(requests: DataFrame, ms: float = SLOW_MS, name_contains: str | None = None) -> DataFrame:
    """Requests over the limit, optionally only for endpoints whose name contains a text."""
    found = requests.where(F.col("response_ms") > ms)
    return found if name_contains is None else found.where(F.col("name").contains(name_contains))


def categories(requests: DataFrame) -> DataFrame:
    """How many distinct endpoint names mention each word, ignoring case."""
    names = requests.select(F.lower("name").alias("name"), F.col("name").alias("raw")).distinct()
    return names.agg(
        *[
            F.count_if(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("name"), w))).alias(label)
            for label, words in CATEGORIES.items()
        ]
    )


def _json(path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json("body"), path, kind)


def status_verdict(allowed: tuple[str, ...] = ("healthy",)) -> Column:
    """A 200 answer whose JSON status is one of the allowed ones passes; else the reason it fails."""
    parsed = F.try_parse_json("body")
    state = F.try_variant_get(parsed, "$.status", "string")
    empty = F.coalesce(F.col("body"), F.lit("")) == ""
    return (
        F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(~empty & parsed.isNull(), "invalid format")
        .when(~F.coalesce(state.isin(*allowed), F.lit(False)), "unhealthy status")
        .otherwise("pass")
    )


def text_verdict(required: tuple[str, ...]) -> Column:
    """A 200 answer that contains every required text passes."""
    missing = F.filter(F.array(*[F.lit(t) for t in required]), lambda t: ~F.contains(F.coalesce("body", F.lit("")), t))
    return (
        F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
        .otherwise("pass")
    )


def line_count_verdict(minimum: int = 10) -> Column:
    lines = F.length("body") - F.length(F.replace(F.col("body"), F.lit("\n"), F.lit("")))
    return (
        F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(F.coalesce(lines, F.lit(0)) < minimum, "insufficient data")
        .otherwise("pass")
    )


def accepted_verdict(*accepted: int) -> Column:
    """Passes on one of the given status codes."""
    return F.when(F.col("status").isin(*accepted), "pass").otherwise(
        F.concat(F.lit("status "), F.col("status").cast("string"))
    )


def expected_failure_verdict() -> Column:
    """Endpoints that exist to fail pass when they do."""
    return F.when(F.col("status") >= 400, "pass").otherwise("expected failure")


def content_verdict(minimum: int = MIN_CONTENT_BYTES) -> Column:
    return (
        F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(F.col("length") > minimum, "pass")
        .otherwise("content too small")
    )


def threshold_verdict(kind: str) -> Column:
    """Checks on numbers in the JSON body; a missing number counts as zero."""
    parsed = F.try_parse_json("body")

    def number(path: str) -> Column:
        return F.coalesce(_json(path, "double"), F.lit(0.0))

    results = F.coalesce(F.size(F.try_variant_get(parsed, "$.results", "array<variant>")), F.lit(0))
    checks = {
        "quality": F.when(number("$.quality_score") < MIN_QUALITY, "quality too low"),
        "jobs": F.when(number("$.active_jobs") > MAX_ACTIVE_JOBS, "too many active jobs"),
        "resources": F.when(number("$.cpu_percent") > MAX_CPU, "high cpu").when(
            number("$.memory_percent") > MAX_MEMORY, "high memory"
        ),
        "results": F.when(results <= 0, "no results"),
    }
    return (
        F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(parsed.isNull(), "invalid format")
        .otherwise(F.coalesce(checks[kind], F.lit("pass")))
    )


def verdicts(requests: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """Adds ``verdict``: the first rule whose condition holds judges the request."""
    out = None
    for condition, verdict in rules:
        out = F.when(condition, verdict) if out is None else out.when(condition, verdict)
    return requests.withColumn("verdict", out)


def quality(fields: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Share of requested fields that came back non-empty, and whether it is enough."""
    score = F.count_if((F.col("status") == "found") & (F.col("value") != "")) / F.count(F.lit(1))
    return fields.groupBy(*keys).agg(score.alias("quality_score")).withColumn(
        "low", F.col("quality_score") < MIN_QUALITY
    )
