"""As-of join: every left row with the newest right row of its keys that is not later than it.

Both sides become one table in the order of (keys, time), cut by range into chunks of similar size, so that a busy
key spans many of them. Inside a chunk the last right row is carried forward; what each chunk leaves behind for a
key is one small row, and the ones of a key are carried over the chunks the same way. No key is held in one task,
and the rows do not depend on the chunking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleanery.session import durable

ROWS_PER_CHUNK = 1_000_000


def join(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, ...],
    left_time: str,
    right_time: str,
    right_id: str,
    take: tuple[str, ...],
    within_sec: float | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """The left rows with ``take`` of their match, null where there is none.

    Of right rows at one moment the one with the largest ``right_id`` counts; null keys match null keys; a left row
    without a time has no match; right rows without a time match nothing. ``within_sec`` bounds how old a match may
    be. Names of ``take`` must not be left columns.
    """
    clash = sorted(set(take) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = [f"__k{n}" for n in range(len(on))]
    named = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    held = F.struct(*[F.col(c) for c in take], micros(right_time).alias("__at"))
    rows = left.select(*named, micros(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[right_id].dataType).alias("__id"), F.struct("*").alias("__row"))
    kept = right.where(F.col(right_time).isNotNull())
    rights = kept.select(*named, micros(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(right_id).alias("__id"), held.alias("__held"))
    both = rows.unionByName(rights, allowMissingColumns=True)
    count = chunks or max(left.sparkSession.sparkContext.defaultParallelism, both.count() // ROWS_PER_CHUNK)
    order = [*keys, "__t", "__side", "__id"]
    laid_out = durable(both.repartitionByRange(count, *order).withColumn("__chunk", F.spark_partition_id()))
    before = Window.partitionBy("__chunk", *keys).orderBy("__t", "__side", "__id").rowsBetween(Window.unboundedPreceding, 0)
    carried = laid_out.withColumn("__own", F.last("__held", ignorenulls=True).over(before)).where("__side = 1")
    left_behind = laid_out.groupBy("__chunk", *keys).agg(F.max_by("__held", F.when(F.col("__side") == 0, F.struct("__t", "__id"))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    entry = left_behind.withColumn("__entry", F.last("__last", ignorenulls=True).over(earlier)).where(F.col("__entry").isNotNull())
    entry = entry.select(F.col("__chunk").alias("__in"), *[F.col(k).alias(f"{k}r") for k in keys], "__entry")
    same = F.col("__chunk") == F.col("__in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}r"))
    found = F.coalesce("__own", "__entry")
    good = F.col("__t").isNotNull()
    if within_sec is not None:
        good = good & (F.col("__t") - found["__at"] <= round(within_sec * 1_000_000))
    joined = carried.join(entry, same, "left").withColumn("__match", F.when(good, found))
    return joined.select("__row.*", *[F.col("__match")[c].alias(c) for c in take])


def step_durations(steps: DataFrame, attempts: DataFrame, time: str, within_sec: float | None = None) -> DataFrame:
    """Steps with the duration of the attempt that was the last to start before them, as ``duration_sec``."""
    return join(steps, attempts, ("site", "step"), time, "ts", "id", ("duration_sec",), within_sec)
