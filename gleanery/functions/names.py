"""File-safe context names and artifact file names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# Allowed characters, length limit and timestamp layout.
_UNICODE_UNSAFE = r"[^\p{L}\p{N}_-]"
_ASCII_UNSAFE = r"[^a-zA-Z0-9_\-]"
MAX_LENGTH = 100
STAMP = "yyyyMMdd_HHmmss"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_context(context: Column | str) -> Column:
    """Letters and digits of any script, ``_`` and ``-`` stay; everything else becomes ``_``."""
    return F.regexp_replace(_c(context), _UNICODE_UNSAFE, "_")


def sanitize_context(context: Column | str, max_length: int = MAX_LENGTH) -> Column:
    """ASCII-only variant with a length limit."""
    return F.left(F.regexp_replace(_c(context), _ASCII_UNSAFE, "_"), F.lit(max_length))


def artifact_file(context: Column | str, at: Column | str) -> Column:
    return F.concat(safe_context(context), F.lit("_"), F.date_format(_c(at), STAMP), F.lit(".html"))


def register(spark: SparkSession) -> None:
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION safe_context(context STRING) RETURNS STRING "
        r"RETURN regexp_replace(context, '[^\\p{L}\\p{N}_-]', '_')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sanitize_context(context STRING, max_length INT DEFAULT 100) "
        r"RETURNS STRING RETURN left(regexp_replace(context, '[^a-zA-Z0-9_\\-]', '_'), max_length)"
    )
