"""Retry decisions while attempts happen: a counter per job, in the order of event time.

A job's attempts are kept until the watermark has passed them and are then numbered, so the rows are those of the
batch ``retry_plan``. A job that is silent for longer than ``ttl_sec`` of event time is forgotten; a later attempt
under its name is the first of a new job. Jobs are many and short: they are kept in ``BUCKETS`` buckets by their
hash, a state key each, whose rows and counters are packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.operators import reliability as rel
from gleanery.streaming.packed import STATE, pack, unpack
from gleanery.streaming.stateful import WATERMARK, _timer, use_rocksdb

TTL_SEC = 86_400
BUCKETS = 512


class _Attempts(StatefulProcessor):
    """Numbers the attempts of the jobs of one bucket."""

    def __init__(self, ttl_us: int, job: tuple[str, ...]) -> None:
        self.ttl_us, self.job = ttl_us, list(job)
        self.names = [*job, "id", "ts", "ok", "exception_type", "attempt"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        listed = [(name, pa.string()) for name in self.job]
        self.held = pa.schema([*listed, ("t_us", pa.int64()), ("id", pa.int64()), ("ok", pa.bool_()), ("exception_type", pa.string())])
        self.counted = pa.schema([*listed, ("n", pa.int32()), ("seen", pa.int64())])
        self.counts = handle.getValueState("counts", STATE)
        self.buffer = handle.getListState("buffer", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.buffer.appendValue(pack(batch[self.held.names], self.held))
                earliest = int(batch["t_us"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(_timer(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = unpack(self.buffer.get(), self.held).sort_by([("t_us", "ascending"), ("id", "ascending")])
        n_ready = sum(1 for t in held["t_us"].to_pylist() if t <= watermark_us)
        ready, rest = held.slice(0, n_ready).to_pydict(), held.slice(n_ready)
        before = unpack([self.counts.get()] if self.counts.exists() else [], self.counted).to_pydict()
        counts = dict(zip(zip(*(before[c] for c in self.job)), zip(before["n"], before["seen"], strict=True), strict=True))
        numbers = []
        for one, t in zip(zip(*(ready[c] for c in self.job)), ready["t_us"], strict=True):
            n, seen = counts.get(one, (0, t))
            n = 1 if t - seen > self.ttl_us else n + 1
            counts[one] = (n, t)
            numbers.append(n)
        if numbers:
            if rest.num_rows:
                self.buffer.put([pack(rest.to_pandas(), self.held)])
            else:
                self.buffer.clear()
        if rest.num_rows:
            self.handle.registerTimer(_timer(rest["t_us"][0].as_py()))
        # whatever may still come is too late to go on with a job that is silent for so long
        kept = [(*one, n, seen) for one, (n, seen) in counts.items() if watermark_us <= seen + self.ttl_us]
        if kept:
            self.counts.update(pack(pd.DataFrame(kept, columns=self.counted.names), self.counted))
            self.handle.registerTimer(_timer(max(row[-1] for row in kept) + self.ttl_us) + 1)
        else:
            self.counts.clear()
        if numbers:
            at = pd.to_datetime(ready["t_us"], unit="us", utc=True)
            rows = {**{c: ready[c] for c in self.job}, "id": ready["id"], "ts": at, "ok": ready["ok"], "exception_type": ready["exception_type"]}
            yield pd.DataFrame({**rows, "attempt": numbers})[self.names]

    def close(self) -> None:
        pass


def retry_plan_stream(
    attempts: DataFrame,
    policy: str = "standard",
    job: tuple[str, ...] = ("site", "step", "job_id"),
    ttl_sec: int = TTL_SEC,
    watermark: str = WATERMARK,
) -> DataFrame:
    """``(job…, id, ts, ok, exception_type, attempt, eligible, exhausted, wait_sec, next_attempt_at)``, as ``retry_plan``.

    ``ts`` stays an event time, so that windowed operators can follow.
    """
    use_rocksdb(attempts.sparkSession)
    names = [F.col(c).cast("string") for c in job]
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int")
    rows = attempts.withWatermark("ts", watermark).select(
        bucket.alias("bucket"), *[name.alias(c) for name, c in zip(names, job, strict=True)], "ts", F.unix_micros("ts").alias("t_us"), "id",
        F.coalesce("ok", F.lit(False)).alias("ok"), "exception_type",
    )
    listed = ", ".join(f"{c} string" for c in job)
    numbered = rows.groupBy("bucket").transformWithStateInPandas(
        _Attempts(ttl_sec * rel.MICROS, job),
        outputStructType=f"{listed}, id bigint, ts timestamp, ok boolean, exception_type string, attempt int",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="ts",
    )
    return rel.decided(numbered, policy)


def retry_rate_stream(plan: DataFrame, window_sec: int, slide_sec: int) -> DataFrame:
    """Retries per second by exception class over sliding windows of a planned stream."""
    from gleanery.streaming import windows

    return windows.rate_stream(rel.retries(plan), ("exception_type",), window_sec, slide_sec, watermark=None)
