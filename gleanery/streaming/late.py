"""Rows that come later than a stream's watermark, kept instead of dropped.

The engine drops a row whose time is not after the watermark and only counts it. Here the same rule is applied
before any stateful operator: the largest time of all earlier micro-batches, less the delay, is the watermark of
this one. What each micro-batch has seen is written beside the checkpoint under the batch's number, so that a
micro-batch that is run again decides alike and overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

DELAY_SEC = 600


def _seen_before(spark, folder: str, number: int) -> int | None:
    """Largest time, in whole milliseconds, of the micro-batches before this one."""
    row = spark.read.schema("batch long, latest_ms long").json(f"{folder}/*").where(F.col("batch") < number).agg(F.max("latest_ms")).first()
    return row[0]


def split_late(
    rows: DataFrame, folder: str, time: str = "ts", delay_sec: int = DELAY_SEC, on_time: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Starts a stream into two tables, ``folder/on_time`` and ``folder/late``, one part per micro-batch.

    ``on_time(df, number)`` replaces the first sink. Late rows carry ``watermark``, the time they missed.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = f"{folder}/seen"
        if number == 0:
            spark.createDataFrame([(-1, None)], "batch long, latest_ms long").coalesce(1).write.mode("overwrite").json(f"{seen}/start")
        before = _seen_before(spark, seen, number)
        mark = F.lit(None).cast("timestamp") if before is None else F.timestamp_millis(F.lit(before - delay_sec * 1000))
        missed = F.coalesce(F.col(time) <= mark, F.lit(False))
        batch.persist()
        try:
            latest = batch.agg(F.max(F.unix_millis(F.col(time).cast("timestamp")))).first()[0]
            kept = batch.where(~missed)
            if on_time is None:
                kept.write.mode("overwrite").parquet(f"{folder}/on_time/batch={number}")
            else:
                on_time(kept, number)
            batch.where(missed).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        finally:
            batch.unpersist()
        found = spark.createDataFrame([(number, latest)], "batch long, latest_ms long")
        found.coalesce(1).write.mode("overwrite").json(f"{seen}/{number}")

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def late_rows(spark, folder: str) -> DataFrame:
    """What a finished :func:`split_late` kept aside."""
    return spark.read.option("basePath", f"{folder}/late").parquet(f"{folder}/late/*")


def late_counts(late: DataFrame, *labels: str) -> DataFrame:
    return late.groupBy(*labels).agg(F.count(F.lit(1)).alias("late"))
