"""Session helpers shared by operators that need a size check or a durable cut."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
PARTS_PER_SLOT = 8
ARROW_BATCH_LIMIT, ARROW_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 * 1024 * 1024


# JVM properties without which the XML and XPath engines refuse very large elements and paths
XML_LIMITS = (
    "jdk.xml.elementAttributeLimit",
    "jdk.xml.maxXMLNameLimit",
    "jdk.xml.xpathExprOpLimit",
    "jdk.xml.xpathExprGrpLimit",
    "jdk.xml.xpathTotalOpLimit",
)


def raise_xml_limits(spark: SparkSession) -> bool:
    """Lift the engines' limits in this JVM, if they are lifted wherever tasks run; whether they are.

    A cluster's executors need ``-D<property>=0`` for each of ``XML_LIMITS`` in
    ``spark.executor.extraJavaOptions``. Without, the driver keeps the limits too, so that what
    it accepts is what the executors can run.
    """
    master = spark.sparkContext.master
    options = spark.conf.get("spark.executor.extraJavaOptions", "") or ""
    if master.startswith("local-cluster") or not master.startswith("local"):
        if not all(f"-D{name}=0" in options for name in XML_LIMITS):
            return False
    for name in XML_LIMITS:
        spark._jvm.java.lang.System.setProperty(name, "0")
    return True


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and hand-over tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a ``local`` master, where
    every task sees the same disk, may fall back to a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="gleanery-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint; the row layout is fixed afterwards."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as by rows, unless the session has a limit of its own.

    A batch, what Python makes of it and the answers are in memory at a time in every worker, and ten
    thousand rows that hold a page or a text each can be any size.
    """
    if spark.conf.get(ARROW_BATCH_LIMIT, None) is None:
        spark.conf.set(ARROW_BATCH_LIMIT, ARROW_BATCH_BYTES)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in at most one partition per task slot.

    A stream keeps the number of shuffle partitions it starts with, and every stateful operator pays for a state
    store, its commit and a Python worker per partition and micro-batch, however few rows come.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Even out the rows of a scan that has fewer splits than there are task slots.

    Meant for a bare file scan: counting its splits plans it but runs nothing. Only a small
    input is moved; a large one already has more splits than slots.
    """
    if df.isStreaming:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def dealt_evenly(df: DataFrame) -> DataFrame:
    """Deal narrow rows that take long to work on over some partitions per task slot.

    A scan is split by bytes: a file of one row group is one task, whatever its rows cost.
    """
    return df.repartition(max(PARTS_PER_SLOT * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def broadcast_if_small(
    df: DataFrame,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Hint a broadcast only after measuring the side; otherwise leave the choice to the optimizer.

    At most ``max_rows + 1`` rows are looked at, so the check itself stays cheap.
    """
    measured = (
        df.limit(max_rows + 1)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length(F.to_json(F.struct("*")))).alias("size"),
        )
        .first()
    )
    if measured["n"] <= max_rows and (measured["size"] or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, as ``--py-files`` would."""
    import shutil
    from pathlib import Path

    import gleanery

    if spark.conf.get("gleanery.shipped", None) == "true":
        return
    package = Path(gleanery.__file__).resolve().parent
    if not package.is_dir():  # already running from a shipped archive
        return
    folder = tempfile.mkdtemp(prefix="gleanery-py-")
    archive = shutil.make_archive(f"{folder}/gleanery", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    # stateful streaming starts a Python process on the driver, which does not see shipped files
    paths = [str(package.parent), spark.sparkContext.environment.get("PYTHONPATH", "")]
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(path for path in paths if path)
    spark.conf.set("gleanery.shipped", "true")
