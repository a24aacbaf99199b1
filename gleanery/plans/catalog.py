"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import ship_package

MODULES = (
    "url_queries",
    "spec_queries",
    "extract_queries",
    "reliability_queries",
    "metric_queries",
    "alert_queries",
    "load_queries",
    "stream_queries",
)

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        found.update(import_module(f"gleanery.plans.{module}").QUERIES)
    return found


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
