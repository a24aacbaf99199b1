"""Sinks: JSON array, JSON lines, artifacts, metric lines, load summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators import serialization
from gleanery.session import durable

def write_json_array(df: DataFrame, path: str, pretty: bool = False, order: tuple[str, ...] = ()) -> None:
    """One JSON array, in the order of the named columns, else of the input.

    The array is written in parts by many tasks: its text is the part files one after the
    other in the order of their names. Small results end up in one part.
    """
    body = serialization.dumps(F.struct("*"), pretty).alias("body")
    rows = durable(df.select(body, F.struct(*order, F.monotonically_increasing_id().alias("_place")).alias("place")))
    first = rows.agg(F.min("place").alias("place")).first()["place"]
    lead = F.lit(False) if first is None else F.col("place._place") == first["_place"]
    inner = rows.select(F.lit(1).alias("part"), "place", F.when(lead, F.col("body")).otherwise(F.concat(F.lit(","), "body")).alias("value"))
    kind = rows.schema["place"].dataType
    ends = df.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, value string")
    whole = inner.unionByName(ends.select("part", F.lit(None).cast(kind).alias("place"), "value"))
    whole.orderBy("part", "place").select("value").write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def stream_json_lines(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Records appended as they arrive."""
    writer = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()


def write_artifacts(manifest: DataFrame, bodies: DataFrame, path: str) -> None:
    """Manifest and page bodies side by side."""
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    bodies.write.mode("overwrite").parquet(f"{path}/bodies")


def write_metric_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)
