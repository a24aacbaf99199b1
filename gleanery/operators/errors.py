"""Error records, their roll-up by class, and the artifacts kept for failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.functions.names import artifact_file, safe_context
from gleanery.operators import extract

# Error classes with their parent, messages of records that never ran a step.
PARENTS = {
    "ConfigError": "AutomationError",
    "LoginError": "AutomationError",
    "NavigationError": "AutomationError",
    "FrameError": "NavigationError",
    "ExtractionError": "AutomationError",
    "TimeoutError": "AutomationError",
    "ElementNotFoundError": "AutomationError",
}
MSG_OPEN = "Circuit breaker is %s"
MSG_RATE = "Rate limit timeout for step '%s'"


def ancestry(kind: Column) -> Column:
    """The class itself and everything it derives from, nearest first."""
    chains = {}
    for name in PARENTS:
        chain, at = [name], name
        while at in PARENTS:
            at = PARENTS[at]
            chain.append(at)
        chains[name] = chain
    out = F.array(kind)
    for name, chain in chains.items():
        out = F.when(kind == name, F.array(*[F.lit(c) for c in chain])).otherwise(out)
    return out


def rollup(errors: DataFrame, kind: str = "type", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per error class, where a class also counts what derives from it."""
    return (
        errors.groupBy(*by, kind)
        .agg(F.count(F.lit(1)).alias("own"))
        .select(*by, "own", kind, F.explode(ancestry(F.col(kind))).alias("error_class"))
        .groupBy(*by, "error_class")
        .agg(
            F.sum("own").alias("errors"),
            F.sum(F.when(F.col(kind) == F.col("error_class"), F.col("own")).otherwise(0)).alias("own_errors"),
        )
    )


def error_records(outcomes: DataFrame) -> DataFrame:
    """Failed sites only: keys, the failing step and the ``error`` struct."""
    return extract.results(outcomes, "run").where(F.col("error").isNotNull()).drop("data")


def circuit_open(replayed: DataFrame) -> DataFrame:
    """One record per attempt the breaker refused."""
    return replayed.where(~F.col("permitted")).select(
        "id",
        "site",
        F.struct(
            F.lit("CircuitBreakerOpen").alias("type"),
            F.format_string(MSG_OPEN, F.col("state_after")).alias("message"),
        ).alias("error"),
    )


def rate_limited(admissions: DataFrame) -> DataFrame:
    """One record per attempt that the rate limiter did not admit."""
    return admissions.where(~F.col("admitted")).select(
        "id",
        "site",
        F.struct(
            F.lit("ExtractionError").alias("type"),
            F.format_string(MSG_RATE, F.col("step")).alias("message"),
            F.struct(F.col("step").alias("step")).alias("context"),
        ).alias("error"),
    )


def _contexts() -> Column:
    """A field failure leaves two captures (field, then step); any other failure one."""
    error, site = F.col("error"), F.col("site")
    step_level = F.when(F.col("failed_step").isNull(), F.concat(site, F.lit("_base"))).otherwise(
        F.concat_ws("_", site, F.col("failed_step"))
    )
    field_level = F.when(
        error["type"] == "ExtractionError",
        F.concat_ws("_", site, error["context"]["step"], error["context"]["field"]),
    )
    return F.array_compact(
        F.array(
            F.when(field_level.isNotNull(), F.struct(field_level.alias("context"), F.lit("field").alias("level"))),
            F.struct(step_level.alias("context"), F.lit("step").alias("level")),
        )
    )


def artifacts(
    errors: DataFrame,
    captured_at: Column,
    url: Column,
    enabled: Column | None = None,
) -> DataFrame:
    """Manifest: what is kept for each failure and under which file name.

    Two captures of one second would share a name; ``copy`` tells them apart. ``linked``
    marks the capture the error record refers to (the step-level one). Captures are taken
    unless ``enabled`` says otherwise.
    """
    keys = [c for c in ("spec_id", "site", "page_id") if c in errors.columns]
    rows = errors.where(F.lit(True) if enabled is None else enabled).select(
        *keys, captured_at.alias("captured_at"), url.alias("url"), F.inline(_contexts())
    )
    return rows.select(
        *keys,
        "context",
        safe_context("context").alias("safe_context"),
        F.date_format("captured_at", "yyyyMMdd_HHmmss").alias("timestamp"),
        artifact_file("context", "captured_at").alias("html"),
        "url",
        (F.col("level") == "step").alias("linked"),
    )


def number_copies(manifest: DataFrame, order: str, cell: int = 10_000) -> DataFrame:
    """Ordinal (by the numeric ``order`` column) among captures that would share a file name.

    One name may be shared by very many captures, so rows are numbered inside cells of the
    order column and shifted by the counts of the cells before, which are one row each.
    """
    placed = manifest.withColumn("_cell", F.floor(F.col(order) / F.lit(cell)))
    counts = placed.groupBy("html", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("html").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("html", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("html", "_cell").orderBy(order)
    return (
        placed.withColumn("_k", F.row_number().over(inside))
        .join(shifts, ["html", "_cell"])
        .withColumn("copy", F.col("_before") + F.col("_k"))
        .drop("_cell", "_k", "_before")
    )


def artifact_bodies(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """File name and html of every kept page, for a table or file sink."""
    return manifest.join(pages.select("page_id", F.col("html").alias("body")), "page_id").select("html", "body")


def attach_artifact(errors: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Error records with the linked capture added to the ``error`` struct."""
    linked = manifest.where("linked").select(
        *keys,
        F.struct(
            "context", "timestamp", F.lit(None).cast("string").alias("screenshot"), "html", "url"
        ).alias("artifact"),
    )
    return errors.join(linked, keys, "left").withColumn(
        "error", F.col("error").withField("artifacts", F.col("artifact"))
    ).drop("artifact")
