"""Even ranges of a key, fixed before any row moves."""

from __future__ import annotations

import math
import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: of percentile_approx: ranges differ from their share by at most one part in this many of all rows
ACCURACY = 10_000
MAX_RANGES = 4_096
#: bytes of a text key that its number holds without rounding
DIGITS = 6


def ordinal(df: DataFrame, key: str) -> Column:
    """A double that ascends with the key. Text keys count by the bytes that follow what all of them begin with."""
    if not isinstance(df.schema[key].dataType, T.StringType):
        return F.col(key).cast("double")
    ends = df.agg(F.min(key).alias("least"), F.max(key).alias("most")).first()
    same = len(os.path.commonprefix([(ends[c] or "").encode() for c in ("least", "most")]))
    digits = F.rpad(F.hex(F.substring(F.col(key).cast("binary"), same + 1, DIGITS)), 2 * DIGITS, "0")
    return F.conv(digits, 16, 10).cast("double")


def cuts(df: DataFrame, key: str, ranges: int) -> list[float]:
    """At most ``ranges - 1`` ascending cut points that part the keys evenly; the driver gets only these."""
    ranges = max(1, min(ranges, MAX_RANGES))
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    if ranges == 1:
        return []
    found = df.agg(F.percentile_approx(ordinal(df, key), shares, F.lit(ACCURACY)).alias("cuts")).first()["cuts"]
    return sorted({float(x) for x in found or []})


def with_range(df: DataFrame, key: str, points: list[float], out: str) -> DataFrame:
    """Adds the number of cut points at or below the key; null keys count as the largest."""
    if not points:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *points, math.inf]
    cell = Bucketizer(splits=splits, inputCol="__key", outputCol="__cell", handleInvalid="keep")
    keyed = cell.transform(df.withColumn("__key", ordinal(df, key)))
    last = len(points)
    return keyed.withColumn(out, F.coalesce(F.least(F.col("__cell").cast("int"), F.lit(last)), F.lit(last))).drop("__key", "__cell")


def with_block(df: DataFrame, key: str, blocks: int, out: str, tie: Column) -> tuple[DataFrame, int]:
    """Adds a block's number, out of about ``blocks``, and says how many there are.

    Blocks are ranges of the key; beyond ``MAX_RANGES`` every range is dealt into as many blocks as that takes, by
    ``tie``, so that their size does not grow with the table. Rows alike in key and ``tie`` share a block.
    """
    points = cuts(df, key, blocks)
    within = -(-blocks // MAX_RANGES)
    placed = with_range(df, key, points, out)
    if within > 1:
        placed = placed.withColumn(out, (F.col(out) * within + F.pmod(tie, F.lit(within))).cast("int"))
    return placed, (len(points) + 1) * within
