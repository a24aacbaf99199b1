"""Sliding-window rates and quantiles, duplicate pages and extraction on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import urls
from gleanery.operators import alerts, extract
from gleanery.operators.metrics import bucket_counts
from gleanery.streaming.stateful import WATERMARK, hold_stream


def _windowed(
    df: DataFrame, labels: tuple[str, ...], window_sec: int, slide_sec: int, watermark: str | None, *aggregates: Column
) -> DataFrame:
    """Counts per sliding window. Where windows consist of whole slides, rows are first counted per slide, and only
    these cells are copied into the windows that hold them; a stream without a watermark argument has one already."""
    rows = df if watermark is None else df.withWatermark("ts", watermark)
    if window_sec % slide_sec == 0 and window_sec > slide_sec:
        names = [f"a{n}" for n in range(len(aggregates))]
        cells = rows.groupBy(*labels, F.window("ts", f"{slide_sec} seconds")).agg(*aggregates)
        grid = F.window("window", f"{window_sec} seconds", f"{slide_sec} seconds")
        rows = cells.groupBy(*labels, grid).agg(*[F.sum(name).alias(name) for name in names])
    else:
        grid = F.window("ts", f"{window_sec} seconds", f"{slide_sec} seconds")
        rows = rows.groupBy(*labels, grid).agg(*aggregates)
    return rows.withColumn("t", F.unix_seconds(F.col("window.end"))).withColumn(
        "event_time", F.window_time("window")
    )


def _numbered(*aggregates: Column) -> list[Column]:
    return [a.alias(f"a{n}") for n, a in enumerate(aggregates)]


def ratio_stream(
    df: DataFrame,
    labels: tuple[str, ...],
    condition: Column,
    window_sec: int = alerts.RATE_WINDOW_SEC,
    slide_sec: int = alerts.EVALUATION_SEC,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Share of events meeting the condition per window; append mode, one row per closed window."""
    rows = _windowed(
        df, labels, window_sec, slide_sec, watermark, *_numbered(F.count(F.lit(1)), F.count_if(condition))
    )
    return rows.select(
        *labels,
        "t",
        "event_time",
        F.col("a0").alias("n"),
        F.col("a1").alias("hits"),
        F.try_divide(F.col("a1").cast("double"), F.col("a0")).alias("value"),
    )


def rate_stream(
    df: DataFrame,
    labels: tuple[str, ...],
    window_sec: int = alerts.RATE_WINDOW_SEC,
    slide_sec: int = alerts.EVALUATION_SEC,
    watermark: str | None = WATERMARK,
) -> DataFrame:
    rows = _windowed(df, labels, window_sec, slide_sec, watermark, *_numbered(F.count(F.lit(1))))
    return rows.select(
        *labels, "t", "event_time", F.col("a0").alias("n"), (F.col("a0") / F.lit(float(window_sec))).alias("rate")
    )


def histogram_stream(
    df: DataFrame,
    labels: tuple[str, ...],
    value: str,
    edges: tuple[float, ...],
    window_sec: int = alerts.RATE_WINDOW_SEC,
    slide_sec: int = alerts.EVALUATION_SEC,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Cumulative bucket counts per window."""
    rows = _windowed(
        df, labels, window_sec, slide_sec, watermark, *_numbered(F.count(value), *bucket_counts(F.col(value), edges))
    )
    return rows.select(
        *labels, "t", "event_time", F.col("a0").alias("n"), *[F.col(f"a{n + 1}").alias(f"le_{n}") for n in range(len(edges))]
    )


def quantile_stream(
    df: DataFrame,
    labels: tuple[str, ...],
    value: str,
    edges: tuple[float, ...],
    phi: float = 0.95,
    window_sec: int = alerts.RATE_WINDOW_SEC,
    slide_sec: int = alerts.EVALUATION_SEC,
    watermark: str = WATERMARK,
) -> DataFrame:
    rows = histogram_stream(df, labels, value, edges, window_sec, slide_sec, watermark)
    cumulative = [F.col(f"le_{n}") for n in range(len(edges))]
    return rows.select(
        *labels, "t", "event_time", "n", alerts.quantile(cumulative, F.col("n"), edges, phi).alias("value")
    )


def alert_stream(
    series: DataFrame, labels: tuple[str, ...], alert: str, threshold: float | None = None,
    hold_sec: int | None = None, slide_sec: int = alerts.EVALUATION_SEC,
) -> DataFrame:
    """One alert rule over a windowed stream: intervals, emitted as runs end."""
    rule = alerts.RULES[alert]
    limit = rule.threshold if threshold is None else threshold
    judged = series.select(
        *labels, "t", "event_time", F.coalesce(F.col("value") > F.lit(limit), F.lit(False)).alias("active"), "value"
    )
    return hold_stream(judged, labels, rule.hold_sec if hold_sec is None else hold_sec, slide_sec)


def dedup_stream(pages: DataFrame, time: str, watermark: str = WATERMARK) -> DataFrame:
    """First page per canonical URL within the watermark."""
    keyed = urls.with_normalized(pages).where(F.col("norm_url").isNotNull())
    return keyed.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["norm_url"])


def extract_stream(
    pages: DataFrame, specs: DataFrame, mode: str = "stream", visibility: str = "approx",
    page_site: Column | None = None,
) -> DataFrame:
    """Extraction on a page stream: stateless, the same in-row plan as in batch."""
    return extract.results(extract.outcomes_by_page(pages, specs, visibility, page_site=page_site), mode)
