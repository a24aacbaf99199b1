"""Counters, histograms and gauges over attempt logs, and their text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Metric names, their labels in declaration order, and bucket edges in seconds.
PREFIX = "selenium_"
COUNTERS = {
    "scrapes_total": ("site", "status"),
    "login_attempts_total": ("site", "status"),
    "steps_executed_total": ("site", "step", "status"),
    "fields_extracted_total": ("site", "step", "field"),
    "retries_total": ("site", "exception_type"),
    "circuit_breaker_state_changes_total": ("site", "from_state", "to_state"),
}
HISTOGRAMS = {
    "scrape_duration_seconds": (("site",), (1, 5, 10, 30, 60, 120, 300)),
    "step_duration_seconds": (("site", "step"), (0.1, 0.5, 1, 2, 5, 10, 30)),
    "wait_duration_seconds": (("wait_type",), (0.1, 0.5, 1, 2, 5, 10, 20)),
    "page_load_duration_seconds": (("site",), (0.5, 1, 2, 5, 10, 30)),
}
GAUGES = {"active_sessions": (), "circuit_breaker_failure_rate": ("site",), "memory_usage_bytes": ()}
HELP = {
    "scrapes_total": "Total number of scrape attempts",
    "login_attempts_total": "Total login attempts",
    "steps_executed_total": "Total steps executed",
    "fields_extracted_total": "Total fields extracted",
    "retries_total": "Total retry attempts",
    "circuit_breaker_state_changes_total": "Circuit breaker state transitions",
    "scrape_duration_seconds": "Time spent scraping site",
    "step_duration_seconds": "Time spent on step",
    "wait_duration_seconds": "Explicit wait durations",
    "page_load_duration_seconds": "Page load times",
    "active_sessions": "Current active WebDriver sessions",
    "circuit_breaker_failure_rate": "Current failure rate for circuit breaker",
    "memory_usage_bytes": "Current memory usage",
}
WAIT_TYPES = ("frame_switch", "presence", "visibility", "clickable", "url_contains")
LEGACY_STEP = "current"


def status(ok: Column | str, passed: str = "success", failed: str = "failure") -> Column:
    return F.when(F.col(ok) if isinstance(ok, str) else ok, passed).otherwise(failed)


def counters(df: DataFrame, name: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """One row per label set with its count; counts combine map-side."""
    keys = COUNTERS[name] if labels is None else labels
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


def scrapes_total(attempts: DataFrame) -> DataFrame:
    return counters(attempts.select("site", status("ok").alias("status")), "scrapes_total")


def login_attempts_total(logins: DataFrame) -> DataFrame:
    return counters(logins.select("site", status("ok", failed="failed").alias("status")), "login_attempts_total")


def steps_executed_total(steps: DataFrame) -> DataFrame:
    return counters(steps.select("site", "step", status("ok").alias("status")), "steps_executed_total")


def fields_extracted_total(fields: DataFrame, legacy_step_label: bool = False) -> DataFrame:
    """Successful reads only. ``legacy_step_label`` counts every step under one constant name."""
    step = F.lit(LEGACY_STEP) if legacy_step_label else F.col("step")
    found = fields.where(F.col("status") == "found").select("site", step.alias("step"), "field")
    return counters(found, "fields_extracted_total")


def retries_total(retried: DataFrame) -> DataFrame:
    return counters(retried, "retries_total")


def bucket_counts(value: Column, buckets: tuple[float, ...]) -> list[Column]:
    """Cumulative counts, upper edges inclusive, one conditional aggregate per bucket."""
    return [F.count_if(value <= F.lit(float(edge))).alias(f"le_{n}") for n, edge in enumerate(buckets)]


def histogram(
    df: DataFrame,
    labels: tuple[str, ...],
    value: str,
    buckets: tuple[float, ...],
) -> DataFrame:
    """Long histogram ``(labels…, le, value, sum, count)``: one aggregation, then unpivoted.

    ``le`` is text with ``+Inf`` last.
    """
    wide = df.groupBy(*labels).agg(
        *bucket_counts(F.col(value), buckets),
        F.sum(value).alias("sum"),
        F.count(value).alias("count"),
    )
    rows = [
        F.struct(F.lit(str(float(edge))).alias("le"), F.col(f"le_{n}").alias("value")) for n, edge in enumerate(buckets)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("value"))]
    return wide.select(*labels, F.inline(F.array(*rows)), "sum", "count")


def failure_ratio(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("site").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.avg((~F.col("ok")).cast("int")).alias("failure_ratio"),
    )


def duration_stats(df: DataFrame, labels: tuple[str, ...], value: str = "duration_sec") -> DataFrame:
    return df.groupBy(*labels).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("longest")
    )


DAY_US = 86_400_000_000


# --- active sessions ---------------------------------------------------------------------


def active(intervals: DataFrame, cell: int = 10_000_000) -> DataFrame:
    """Gauge of open intervals after every instant at which it may change.

    ``intervals(start_us, end_us)`` in microseconds; an open end is null. The global running
    sum is split in three: days (one row each) are accumulated first, then the cells of every
    day, then the instants of every cell, so no task sees the whole log.
    """
    changes = intervals.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.col("start_us").alias("at_us"), F.lit(1).alias("delta")),
                    F.when(F.col("end_us").isNotNull(), F.struct(F.col("end_us").alias("at_us"), F.lit(-1).alias("delta"))),
                )
            )
        )
    )
    instants = (
        changes.groupBy("at_us")
        .agg(F.sum("delta").alias("delta"))
        .withColumn("cell", F.floor(F.col("at_us") / F.lit(cell)))
        .withColumn("day", F.floor(F.col("at_us") / F.lit(DAY_US)))
    )
    totals = instants.groupBy("day", "cell").agg(F.sum("delta").alias("total"))
    # one row per day reaches this window
    days = totals.groupBy("day").agg(F.sum("total").alias("total"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before_day"))
    within = Window.partitionBy("day").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.join(days, "day").select(
        F.col("cell").alias("cell"),
        F.col("day").alias("day"),
        (F.col("before_day") + F.coalesce(F.sum("total").over(within), F.lit(0))).alias("before"),
    )
    inside = Window.partitionBy("day", "cell").orderBy("at_us").rowsBetween(Window.unboundedPreceding, 0)
    return instants.join(earlier, ["day", "cell"]).select(
        "at_us", (F.col("before") + F.sum("delta").over(inside)).alias("active")
    )


def peak(gauge: DataFrame) -> DataFrame:
    """Highest value and the first instant it was reached."""
    best = F.max(F.struct("active", (-F.col("at_us")).alias("neg"))).alias("best")
    return gauge.agg(best).select(F.col("best.active").alias("peak"), (-F.col("best.neg")).alias("at_us"))


# --- text exposition ---------------------------------------------------------------------


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def label_text(labels: tuple[str, ...], le: Column | None = None) -> Column:
    """``{a="x",b="y"}`` in declaration order; empty without labels."""
    parts = [F.concat(F.lit(f'{name}="'), _escaped(F.col(name)), F.lit('"')) for name in labels]
    if le is not None:
        parts.append(F.concat(F.lit('le="'), le, F.lit('"')))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("")


def _number(value: Column) -> Column:
    """Float text of the exposition format: an exponent from seven integer digits on."""
    text = value.cast("double").cast("string")
    scientific = text.contains("E")
    digits = F.replace(text, F.lit("."), F.lit(""))
    mantissa = F.when(scientific, F.substring_index(text, "E", 1)).otherwise(
        F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))
    )
    exponent = F.when(scientific, F.substring_index(text, "E", -1)).otherwise(
        (F.instr(text, ".") - 2).cast("string")
    )
    return F.when(
        value >= 1e6, F.concat(F.regexp_replace(mantissa, r"[0.]+\z", ""), F.lit("e+0"), exponent)
    ).otherwise(text)


def counter_lines(df: DataFrame, name: str, labels: tuple[str, ...], prefix: str = PREFIX) -> DataFrame:
    """Sample lines of a counter or gauge with columns ``labels…, value``."""
    return df.select(
        F.lit(prefix + name).alias("metric"),
        F.concat(F.lit(prefix + name), label_text(labels), F.lit(" "), _number(F.col("value"))).alias("value"),
    )


def histogram_lines(df: DataFrame, name: str, labels: tuple[str, ...], prefix: str = PREFIX) -> DataFrame:
    """Bucket, count and sum lines of ``histogram`` output."""
    full = prefix + name
    bucket = F.concat(F.lit(f"{full}_bucket"), label_text(labels, F.col("le")), F.lit(" "), _number(F.col("value")))
    total = F.col("le") == "+Inf"
    extra = F.array_compact(
        F.array(
            bucket,
            F.when(total, F.concat(F.lit(f"{full}_count"), label_text(labels), F.lit(" "), _number(F.col("count")))),
            F.when(total, F.concat(F.lit(f"{full}_sum"), label_text(labels), F.lit(" "), _number(F.col("sum")))),
        )
    )
    return df.select(F.lit(full).alias("metric"), F.explode(extra).alias("value"))


def current(samples: DataFrame, labels: tuple[str, ...], value: str, *order: str) -> DataFrame:
    """The last value of a gauge per label set; without labels the last of all, 0 if there is none."""
    last = F.max_by(F.col(value).cast("double"), F.struct(*order)).alias("value")
    if labels:
        return samples.groupBy(*labels).agg(last)
    return samples.agg(F.coalesce(last, F.lit(0.0)).alias("value"))


def page(families: dict[str, DataFrame]) -> DataFrame:
    """A whole page of metrics: ``(metric, part, value)``, families by name with their help and type lines first.

    A family is the output of a counter, gauge or histogram operator; ``part`` orders the lines of a family as far
    as the format does: help, type, samples.
    """
    out = None
    for name, rows in families.items():
        if name in HISTOGRAMS:
            kind, lines = "histogram", histogram_lines(rows, name, HISTOGRAMS[name][0])
        else:
            kind = "counter" if name in COUNTERS else "gauge"
            lines = counter_lines(rows, name, COUNTERS.get(name, GAUGES.get(name)))
        full = PREFIX + name
        head = F.array(
            F.struct(F.lit(0).alias("part"), F.lit(f"# HELP {full} {HELP[name]}").alias("value")),
            F.struct(F.lit(1).alias("part"), F.lit(f"# TYPE {full} {kind}").alias("value")),
        )
        heads = rows.sparkSession.range(1).select(F.lit(full).alias("metric"), F.inline(head))
        part = heads.unionByName(lines.withColumn("part", F.lit(2)))
        out = part if out is None else out.unionByName(part)
    return out


def exposition(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
