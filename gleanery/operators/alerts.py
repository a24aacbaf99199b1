"""Windowed rates and quantiles, alert rules with hold times, and notification grouping.

Logs are reduced to fixed cells of one slide first; the overlapping windows are then built
from cells, whose number depends on time and label sets but not on the number of rows.
Times are whole seconds since the epoch; the window at grid point ``t`` is ``[t - window, t)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.operators.metrics import bucket_counts

# Alert rules (threshold, hold, labels, annotations), grid and grouping times.
EVALUATION_SEC = 30
RATE_WINDOW_SEC = 300
GROUP_WAIT_SEC, GROUP_INTERVAL_SEC, REPEAT_SEC = 30, 300, 4 * 3600


class Rule(NamedTuple):
    alert: str
    threshold: float
    hold_sec: int
    severity: str
    component: str
    summary: str
    description: str
    style: str


RULES = {
    rule.alert: rule
    for rule in (
        Rule(
            "HighScrapeFailureRate", 0.5, 300, "warning", "scraper",
            "High scrape failure rate for {site}", "Failure rate is {value} for site {site}", "percentage",
        ),
        Rule(
            "CircuitBreakerOpen", 0.0, 60, "critical", "circuit-breaker",
            "Circuit breaker opened for {site}",
            "Circuit breaker has opened for site {site}, indicating persistent failures", "plain",
        ),
        Rule(
            "SlowScrapeLatency", 120.0, 600, "warning", "performance",
            "Slow scrape latency for {site}", "95th percentile scrape duration is {value}s for site {site}", "plain",
        ),
        Rule(
            "HighMemoryUsage", 1.5e9, 300, "warning", "resources",
            "High memory usage detected", "Memory usage is {value}B", "si",
        ),
        Rule(
            "TooManyActiveSessions", 20.0, 300, "warning", "resources",
            "Too many active WebDriver sessions", "{value} active sessions detected", "plain",
        ),
    )
}


DAY_SEC = 86_400


def _epoch(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000))


def cells(df: DataFrame, labels: tuple[str, ...], slide_sec: int, **aggregates: Column) -> DataFrame:
    """Tumbling pre-aggregation ``(labels…, cell, aggregates…)``; ``cell`` is the cell's start."""
    start = (F.floor(_epoch("ts") / slide_sec) * slide_sec).alias("cell")
    return df.groupBy(*labels, start).agg(*[value.alias(name) for name, value in aggregates.items()])


def windows(
    cell_rows: DataFrame, labels: tuple[str, ...], window_sec: int, slide_sec: int, summed: tuple[str, ...]
) -> DataFrame:
    """Sums over ``[t - window, t)`` at every grid point ``t`` whose window is not empty."""
    grid = F.sequence(F.col("cell") + slide_sec, F.col("cell") + window_sec, F.lit(slide_sec).cast("long"))
    return (
        cell_rows.withColumn("t", F.explode(grid))
        .groupBy(*labels, "t")
        .agg(*[F.sum(name).alias(name) for name in summed])
    )


def rate(
    df: DataFrame,
    labels: tuple[str, ...],
    condition: Column | None = None,
    window_sec: int = RATE_WINDOW_SEC,
    slide_sec: int = EVALUATION_SEC,
) -> DataFrame:
    """Events per second over the window."""
    wanted = df if condition is None else df.where(condition)
    counted = cells(wanted, labels, slide_sec, n=F.count(F.lit(1)))
    return windows(counted, labels, window_sec, slide_sec, ("n",)).withColumn("rate", F.col("n") / F.lit(float(window_sec)))


def ratio(
    df: DataFrame,
    labels: tuple[str, ...],
    condition: Column,
    window_sec: int = RATE_WINDOW_SEC,
    slide_sec: int = EVALUATION_SEC,
) -> DataFrame:
    """Share of events that meet the condition; null (never an alert) over nothing."""
    counted = cells(df, labels, slide_sec, n=F.count(F.lit(1)), hits=F.count_if(condition))
    return windows(counted, labels, window_sec, slide_sec, ("n", "hits")).withColumn(
        "value", F.try_divide(F.col("hits").cast("double"), F.col("n"))
    )


def quantile(cumulative: list[Column], total: Column, edges: tuple[float, ...], phi: float) -> Column:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    Below the first edge interpolation starts at 0; beyond the last edge the last edge is
    returned; without observations the result is null.
    """
    rank = F.lit(phi) * total
    out = None
    for n, edge in enumerate(edges):
        below = F.lit(0) if n == 0 else cumulative[n - 1]
        lower = 0.0 if n == 0 else float(edges[n - 1])
        share = F.try_divide((rank - below).cast("double"), cumulative[n] - below)
        inside = F.lit(lower) + F.lit(float(edge) - lower) * F.coalesce(share, F.lit(0.0))
        out = F.when(cumulative[n] >= rank, inside) if out is None else out.when(cumulative[n] >= rank, inside)
    return F.when(total > 0, out.otherwise(float(edges[-1])))


def quantile_windows(
    df: DataFrame,
    labels: tuple[str, ...],
    value: str,
    edges: tuple[float, ...],
    phi: float = 0.95,
    window_sec: int = RATE_WINDOW_SEC,
    slide_sec: int = EVALUATION_SEC,
) -> DataFrame:
    names = tuple(f"le_{n}" for n in range(len(edges)))
    aggregates = dict(zip(names, bucket_counts(F.col(value), edges), strict=True))
    counted = cells(df, labels, slide_sec, n=F.count(value), **aggregates)
    summed = windows(counted, labels, window_sec, slide_sec, ("n", *names))
    return summed.select(*labels, "t", "n", quantile([F.col(name) for name in names], F.col("n"), edges, phi).alias("value"))


def counter_rate(
    samples: DataFrame,
    labels: tuple[str, ...],
    window_sec: int = RATE_WINDOW_SEC,
    slide_sec: int = EVALUATION_SEC,
    order: tuple[str, ...] = ("ts",),
) -> DataFrame:
    """Per-second increase of sampled counters; a drop means the counter restarted from zero.

    Differences are taken inside each cell, and across cells from one summary row per cell,
    so a long series is never sorted by a single task.
    """
    start = (F.floor(_epoch("ts") / slide_sec) * slide_sec).alias("cell")
    inside = Window.partitionBy(*labels, "cell").orderBy(*order)
    step = F.col("value") - F.lag("value").over(inside)
    stepped = samples.select(*labels, *order, "value", start).withColumn(
        "increase", F.when(step < 0, F.col("value")).otherwise(F.coalesce(step, F.lit(0.0)))
    )
    key = F.struct(*order)
    per_cell = stepped.groupBy(*labels, "cell").agg(
        F.sum("increase").alias("increase"),
        F.min_by("value", key).alias("opening"),
        F.max_by("value", key).alias("closing"),
    )
    jump = F.col("opening") - F.lag("closing").over(Window.partitionBy(*labels).orderBy("cell"))
    joined = per_cell.withColumn(
        "increase", F.col("increase") + F.when(jump < 0, F.col("opening")).otherwise(F.coalesce(jump, F.lit(0.0)))
    )
    return windows(joined, labels, window_sec, slide_sec, ("increase",)).withColumn(
        "rate", F.col("increase") / F.lit(float(window_sec))
    )


def on_grid(gauge: DataFrame, labels: tuple[str, ...], slide_sec: int = EVALUATION_SEC) -> DataFrame:
    """Last gauge value at or before every grid point between its first and last sample.

    ``gauge(labels…, at_sec, value)``; each sample is carried to the grid points up to the next.
    Only the last sample before a grid point counts, so samples are reduced per cell first. The
    next sample is sought within the day, and among the first ones of the days after it.
    """
    point = (F.ceil(F.col("at_sec") / slide_sec) * slide_sec).cast("long")
    last = gauge.withColumn("t", point).groupBy(*labels, "t").agg(F.max_by("value", "at_sec").alias("value"))
    last = last.withColumn("day", F.floor(F.col("t") / DAY_SEC))
    # one row per label set and day
    firsts = last.groupBy(*labels, "day").agg(F.min("t").alias("first"))
    firsts = firsts.withColumn("next_first", F.lead("first").over(Window.partitionBy(*labels).orderBy("day"))).drop("first")
    joined = last.join(_renamed(firsts, (*labels, "day")), _matches((*labels, "day")), "left")
    following = F.coalesce(F.lead("t").over(Window.partitionBy(*labels, "day").orderBy("t")), F.col("next_first"))
    spans = joined.withColumn("until", F.coalesce(following - slide_sec, F.col("t"))).select(*labels, "t", "until", "value")
    # a long gap is laid out day by day
    first_day, last_day = F.floor(F.col("t") / DAY_SEC), F.floor(F.col("until") / DAY_SEC)
    daily = spans.withColumn("at_day", F.explode(F.sequence(first_day, last_day)))
    skipped = F.ceil(F.greatest(F.col("at_day") * DAY_SEC - F.col("t"), F.lit(0)) / slide_sec) * slide_sec
    start, stop = F.col("t") + skipped, F.least(F.col("until"), (F.col("at_day") + 1) * DAY_SEC - 1)
    points = F.when(start <= stop, F.sequence(start, stop, F.lit(slide_sec).cast("long")))
    return daily.select(*labels, F.explode(points).alias("t"), "value")


def _renamed(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}" if c in names else c) for c in df.columns])


def _matches(names: tuple[str, ...]) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return same


# --- hold --------------------------------------------------------------------------------


def hold(
    evaluated: DataFrame, labels: tuple[str, ...], hold_sec: int, slide_sec: int = EVALUATION_SEC
) -> DataFrame:
    """Runs of consecutive true evaluations as alert intervals.

    ``evaluated(labels…, t, active, value)``; a false or missing evaluation ends a run. A run
    is pending from its first evaluation, fires once it has lasted ``hold_sec`` and resolves
    at the evaluation after its last one. ``value`` is the one at the last evaluation.
    """
    days = evaluated.where("active").withColumn("day", F.floor(F.col("t") / DAY_SEC))
    order = Window.partitionBy(*labels, "day").orderBy("t")
    runs = days.withColumn("run", F.col("t") - F.row_number().over(order) * slide_sec)
    # runs within a day, then those of one label set that touch
    parts = runs.groupBy(*labels, "day", "run").agg(
        F.min("t").alias("pending_at"), F.max("t").alias("last_true"), F.max_by("value", "t").alias("value")
    )
    along = Window.partitionBy(*labels).orderBy("pending_at")
    new = F.coalesce(F.col("pending_at") > F.lag("last_true").over(along) + slide_sec, F.lit(True))
    joined = parts.withColumn("new", new.cast("int")).withColumn("number", F.sum("new").over(along))
    spans = joined.groupBy(*labels, "number").agg(
        F.min("pending_at").alias("pending_at"), F.max("last_true").alias("last_true"), F.max_by("value", "last_true").alias("value")
    )
    # the first evaluation at which the run is old enough
    fires = F.col("pending_at") + F.ceil(F.lit(hold_sec) / slide_sec) * slide_sec
    return spans.select(
        *labels,
        "pending_at",
        F.when(F.col("last_true") >= fires, fires).alias("firing_at"),
        (F.col("last_true") + slide_sec).alias("resolved_at"),
        F.when(F.col("last_true") >= fires, "fired").otherwise("pending").alias("outcome"),
        "value",
    )


def evaluate(
    series: DataFrame,
    labels: tuple[str, ...],
    alert: str,
    threshold: float | None = None,
    hold_sec: int | None = None,
    slide_sec: int = EVALUATION_SEC,
) -> DataFrame:
    """One rule over its series ``(labels…, t, value)``: strictly above the threshold, held."""
    rule = RULES[alert]
    limit = rule.threshold if threshold is None else threshold
    judged = series.withColumn("active", F.coalesce(F.col("value") > F.lit(limit), F.lit(False)))
    return hold(judged, labels, rule.hold_sec if hold_sec is None else hold_sec, slide_sec).withColumn(
        "alertname", F.lit(alert)
    )


# --- annotations -------------------------------------------------------------------------


def four_digits(value: Column) -> Column:
    """A number with four significant digits and no trailing zeros."""
    digits = F.lit(3) - F.floor(F.log10(F.abs(value))).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    rounded = F.round(value * scale) / scale
    return F.when(value == 0, "0").otherwise(plain(rounded))


def plain(value: Column) -> Column:
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0\z", "")


def humanize_percentage(value: Column) -> Column:
    return F.concat(four_digits(value * 100), F.lit("%"))


def humanize(value: Column) -> Column:
    """SI-prefixed number, e.g. 1.5e9 -> ``1.5G``."""
    size = F.abs(value)
    out = None
    for prefix, power in (("Y", 24), ("Z", 21), ("E", 18), ("P", 15), ("T", 12), ("G", 9), ("M", 6), ("k", 3)):
        scaled = F.concat(four_digits(value / F.lit(10.0**power)), F.lit(prefix))
        condition = size >= F.lit(10.0**power)
        out = F.when(condition, scaled) if out is None else out.when(condition, scaled)
    return out.otherwise(four_digits(value))


def _filled(template: str, value: Column, site: Column) -> Column:
    parts = []
    for n, piece in enumerate(template.replace("{site}", "\0s\0").replace("{value}", "\0v\0").split("\0")):
        if n % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            parts.append(site if piece == "s" else value)
    return F.concat(*parts)


def annotate(alerts: DataFrame) -> DataFrame:
    """Adds severity, component, summary and description from the rule table."""
    site = F.col("site") if "site" in alerts.columns else F.lit("")
    shown = {"percentage": humanize_percentage, "si": humanize, "plain": plain}
    out = None
    for rule in RULES.values():
        text = F.struct(
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.component).alias("component"),
            _filled(rule.summary, F.lit(""), site).alias("summary"),
            _filled(rule.description, shown[rule.style](F.col("value")), site).alias("description"),
        )
        mine = F.col("alertname") == rule.alert
        out = F.when(mine, text) if out is None else out.when(mine, text)
    return alerts.withColumn("_note", out).select(*alerts.columns, "_note.*")


# --- grouping ----------------------------------------------------------------------------


def group(
    alerts: DataFrame,
    keys: tuple[str, ...] = ("alertname", "job"),
    wait_sec: int = GROUP_WAIT_SEC,
    interval_sec: int = GROUP_INTERVAL_SEC,
    repeat_sec: int = REPEAT_SEC,
) -> DataFrame:
    """Notifications per group of firing alerts.

    A group opens with its first firing alert and is first sent after ``wait_sec``; it is
    looked at every ``interval_sec`` and sent again when an alert started or ended since, or
    when ``repeat_sec`` has passed without a change. It closes when nothing fires any more.
    Every alert adds a start and an end to the group's ticks, so no alerts are paired up.
    """
    fired = alerts.where(F.col("firing_at").isNotNull()).select(*keys, "firing_at", "resolved_at")
    spans = fired.groupBy(*keys, "firing_at").agg(
        F.max("resolved_at").alias("resolved_at")
    )
    by_start = Window.partitionBy(*keys).orderBy("firing_at")
    reach = F.max("resolved_at").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce(F.col("firing_at") > reach, F.lit(True)))
    islands = (
        opened.withColumn("island", F.sum(F.col("opens").cast("int")).over(by_start))
        .groupBy(*keys, "island")
        .agg(F.min("firing_at").alias("opened_at"), F.max("resolved_at").alias("closed_at"))
    )
    first_tick = F.col("opened_at") + wait_sec

    def tick_of(at: str) -> Column:
        """First tick that sees what happened at the given time."""
        return F.greatest(F.ceil((F.col(at) - first_tick) / interval_sec), F.lit(0)).cast("long")

    tagged = fired.join(
        opened.withColumn("island", F.sum(F.col("opens").cast("int")).over(by_start)).select(*keys, "firing_at", "island"),
        [*keys, "firing_at"],
    ).join(islands, [*keys, "island"])
    events = (
        tagged.withColumn("from_tick", tick_of("firing_at"))
        .withColumn("to_tick", tick_of("resolved_at"))
        .where(F.col("to_tick") > F.col("from_tick"))
        .select(
            *keys,
            "island",
            F.inline(
                F.array(
                    F.struct(F.col("from_tick").alias("tick"), F.lit(1).alias("started"), F.lit(0).alias("ended")),
                    F.struct(F.col("to_tick").alias("tick"), F.lit(0).alias("started"), F.lit(1).alias("ended")),
                )
            ),
        )
        .groupBy(*keys, "island", "tick")
        .agg(F.sum("started").alias("started"), F.sum("ended").alias("ended"))
    )
    ticks = islands.withColumn(
        "tick", F.explode(F.sequence(F.lit(0).cast("long"), tick_of("closed_at")))
    )
    run = Window.partitionBy(*keys, "island").orderBy("tick")
    seen = (
        ticks.join(events, [*keys, "island", "tick"], "left")
        .na.fill(0, ["started", "ended"])
        .withColumn("firing", F.sum(F.col("started") - F.col("ended")).over(run))
        .withColumn("changed", (F.col("started") + F.col("ended")) > 0)
        .withColumn("last_change", F.max(F.when(F.col("changed"), F.col("tick"))).over(run))
        .withColumn("quiet_sec", (F.col("tick") - F.col("last_change")) * interval_sec)
    )
    repeats = (F.col("firing") > 0) & (F.col("quiet_sec") > 0) & (F.pmod(F.col("quiet_sec"), F.lit(repeat_sec)) < interval_sec)
    return seen.where(F.col("last_change").isNotNull() & (F.col("changed") | repeats)).select(
        *keys,
        (F.col("opened_at") + wait_sec + F.col("tick") * interval_sec).alias("notified_at"),
        "firing",
        F.col("ended").alias("resolved"),
        F.when(F.col("firing") == 0, "resolved").when(F.col("changed"), "changed").otherwise("repeat").alias("reason"),
    )
