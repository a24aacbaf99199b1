"""Attempt log: one row per started step or scrape.

``attempts(id, site, step, ts, duration_sec, ok, exception_type)`` as a table or a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ATTEMPT_SCHEMA = (
    "id BIGINT, site STRING, step STRING, ts TIMESTAMP, duration_sec DOUBLE, ok BOOLEAN, exception_type STRING"
)


def read_attempts(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    return spark.read.format(source_format).load(path)


def read_attempt_stream(
    spark: SparkSession,
    path: str,
    source_format: str = "parquet",
    schema: str = ATTEMPT_SCHEMA,
    files: str | None = None,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    reader = spark.readStream.format(source_format).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if files:
        reader = reader.option("pathGlobFilter", files)
    return reader.load(path)
