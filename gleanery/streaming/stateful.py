"""Limiter, breaker and alert hold on streams.

Rows are kept in state until the watermark has passed them and are then applied in
(time, id) order, so a stream gives the same rows as the batch operators. Rows later than
the watermark are dropped by the engine and show up in its ``numRowsDroppedByWatermark``.
State lives in the RocksDB store; one key's state is its buffer of one watermark delay plus
a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.operators import reliability as rel
from gleanery.streaming.packed import STATE, pack, unpack

WATERMARK = "10 minutes"
HELD = pa.schema([("t_us", pa.int64()), ("id", pa.int64()), ("ok", pa.bool_()), ("limit_capacity", pa.int32()), ("limit_rate", pa.float64())])
# rows that are Python objects at a time; the others are packed columns
ROWS_AT_A_TIME = 20_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful operators need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _OrderedFold(StatefulProcessor):
    """Buffers a key's rows until the watermark passes them, then folds them in order.

    ``wake`` says when a state changes by itself, ``woken`` the row for it; that row comes with the next attempt, or
    with ``timers`` as soon as the watermark has passed the moment, whether or not another attempt follows. A key that is silent for longer than ``ttl_us``
    of event time starts afresh, and its state is removed.
    """

    def __init__(
        self,
        start: tuple,
        step: Callable[[tuple, tuple], tuple[tuple, tuple]],
        state_schema: str,
        names: list[str],
        wake: Callable[[tuple], int | None] | None = None,
        woken: Callable[[tuple], tuple] | None = None,
        ttl_us: int | None = None,
        timers: bool = False,
    ) -> None:
        self.timers = timers
        self.start, self.step, self.state_schema, self.names = start, step, state_schema, names
        self.wake, self.woken, self.ttl_us = wake, woken, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # beside the state: the time of the last row, and the last wake-up that has its row
        self.state = handle.getValueState("state", f"{self.state_schema}, seen bigint, told bigint")
        self.buffer = handle.getListState("buffer", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.buffer.appendValue(pack(batch[HELD.names], HELD))
                earliest = int(batch["t_us"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(_timer(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = unpack(self.buffer.get(), HELD).sort_by([("t_us", "ascending"), ("id", "ascending")])
        n_ready = pc.sum(pc.less_equal(held["t_us"], watermark_us)).as_py() or 0
        ready, rest = held.slice(0, n_ready), held.slice(n_ready)
        out = []
        *state, seen, told = self.state.get() if self.state.exists() else (*self.start, None, None)
        state = tuple(state)

        def ends() -> int | None:
            return None if self.ttl_us is None or seen is None else seen + self.ttl_us

        def tell_until(t: int) -> None:
            nonlocal told
            due = self.wake(state) if self.wake else None
            if due is not None and due <= t and due != told and (ends() is None or due <= ends()):
                out.append((key[0], None, due, *self.woken(state)))
                told = due

        for slice_ in ready.to_batches(max_chunksize=ROWS_AT_A_TIME):
            for t, number, ok, size, rate in zip(*(column.to_pylist() for column in slice_.columns), strict=True):
                tell_until(t)
                if ends() is not None and t > ends():
                    state, told = tuple(self.start), None
                state, result = self.step(state, (t, ok, size, rate))
                state, seen = tuple(state), t
                out.append((key[0], number, t, *result))
            yield self._shaped(out)
            out.clear()
        if self.timers:
            tell_until(watermark_us)
        if n_ready:
            if rest.num_rows:
                self.buffer.put([pack(one.to_pandas(), HELD) for one in rest.to_batches(max_chunksize=ROWS_AT_A_TIME)])
            else:
                self.buffer.clear()
        if rest.num_rows:
            self.handle.registerTimer(_timer(rest["t_us"][0].as_py()))
        if ends() is not None and not rest.num_rows and watermark_us > ends():
            self.state.clear()
        elif seen is not None:
            self.state.update((*state, seen, told))
            due = self.wake(state) if self.wake else None
            if self.timers and due is not None and due != told and due > watermark_us:
                self.handle.registerTimer(_timer(due))
            if ends() is not None and n_ready:
                self.handle.registerTimer(_timer(ends()) + 1)
        if out:
            yield self._shaped(out)

    def _shaped(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["site", "id", "t_us", *self.names], dtype=object)

    def close(self) -> None:
        pass


def _timer(t_us: int) -> int:
    return -(-int(t_us) // 1000)


def _fold(
    attempts: DataFrame, processor: _OrderedFold, output: str, watermark: str
) -> DataFrame:
    use_rocksdb(attempts.sparkSession)
    known = set(attempts.columns)
    limits = [
        F.col(name) if name in known else F.lit(0).cast(kind).alias(name)
        for name, kind in (("limit_capacity", "int"), ("limit_rate", "double"))
    ]
    narrow = attempts.withWatermark("ts", watermark).select(
        "site", "ts", F.unix_micros("ts").alias("t_us"), "id", F.coalesce("ok", F.lit(False)).alias("ok"), *limits
    )
    folded = narrow.groupBy("site").transformWithStateInPandas(
        processor,
        outputStructType=f"site string, id bigint, t_us bigint, {output}",
        outputMode="Append",
        timeMode="EventTime",
    )
    return folded.withColumn("ts", F.timestamp_micros("t_us")).drop("t_us")


def _micros(seconds: float | None) -> int | None:
    return None if seconds is None else round(seconds * rel.MICROS)


def token_bucket_stream(
    attempts: DataFrame, tokens: int = 1, watermark: str = WATERMARK, ttl_sec: float | None = None
) -> DataFrame:
    """``(site, id, ts, admitted, tokens_after)`` in the order of time per site.

    A site that is silent for longer than ``ttl_sec`` is forgotten and starts with a full bucket.

    Every attempt carries its site's ``limit_capacity`` and ``limit_rate``. Levels are whole
    numbers of any size and are kept as text.
    """
    machine = rel._bucket_machine(tokens)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        level, at = state
        (level, at), result = machine.step((None if level is None else int(level), at), (row[0], row[2], row[3]))
        return (str(level), at), result

    processor = _OrderedFold((None, None), step, "level string, at bigint", ["admitted", "tokens_after"], ttl_us=_micros(ttl_sec))
    return _fold(attempts, processor, machine.output, watermark)


def breaker_stream(
    attempts: DataFrame,
    rules: rel.BreakerRules,
    watermark: str = WATERMARK,
    emit_recovery: bool = False,
    ttl_sec: float | None = None,
    timers: bool = False,
) -> DataFrame:
    """Breaker state per attempt; with ``emit_recovery`` also a row (``id`` null) per recovery moment that an attempt
    finds, with ``timers`` of every one as soon as the watermark has passed it. A site that is silent for longer than ``ttl_sec`` is forgotten and starts CLOSED."""
    names = [part.split()[0] for part in rel._BREAKER_OUTPUT.split(", ")]

    def due(state: tuple) -> int | None:
        return state[3] + rules.recovery_us if state[0] == rel.OPEN else None

    processor = _OrderedFold(
        (rel.CLOSED, 0, 0, None),
        lambda state, row: rules.step(tuple(state), row[0], row[1]),
        "mode int, failed bigint, passed bigint, last bigint",
        names,
        due if emit_recovery or timers else None,
        lambda state: ("OPEN", True, "HALF_OPEN", state[1], 0, None, None),
        _micros(ttl_sec),
        timers,
    )
    return rel.shape_breaker(_fold(attempts, processor, rel._BREAKER_OUTPUT, watermark))


class _Hold(StatefulProcessor):
    """Runs of true evaluations of one label set."""

    def __init__(self, hold_sec: int, slide_sec: int) -> None:
        self.hold_sec, self.slide_sec = hold_sec, slide_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "pending_at bigint, last_true bigint, value double")

    def _closed(self, key, run: tuple) -> tuple:
        pending, last, value = run
        fires = pending - (-self.hold_sec // self.slide_sec) * self.slide_sec
        fired = last >= fires
        return (
            *key,
            pending,
            fires if fired else None,
            last + self.slide_sec,
            "fired" if fired else "pending",
            value,
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        evaluated = sorted(
            row
            for batch in rows
            for row in zip(batch["t"].tolist(), batch["active"].tolist(), batch["value"].tolist(), strict=True)
        )
        run = tuple(self.run.get()) if self.run.exists() else None
        out = []
        for t, active, value in evaluated:
            if run is not None and (not active or t > run[1] + self.slide_sec):
                out.append(self._closed(key, run))
                run = None
            if active:
                run = (t if run is None else run[0], t, value)
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
            # absent evaluations end the run as well, once the following one can no longer come
            self.handle.registerTimer((run[1] + 2 * self.slide_sec) * 1000)
        if out:
            yield pd.DataFrame(out, columns=self._columns(key), dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            run = tuple(self.run.get())
            if (run[1] + 2 * self.slide_sec) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.run.clear()
                yield pd.DataFrame([self._closed(key, run)], columns=self._columns(key), dtype=object)

    def _columns(self, key) -> list[str]:
        return [f"k{n}" for n in range(len(key))] + ["pending_at", "firing_at", "resolved_at", "outcome", "value"]

    def close(self) -> None:
        pass


def hold_stream(evaluated: DataFrame, labels: tuple[str, ...], hold_sec: int, slide_sec: int) -> DataFrame:
    """Alert intervals from a stream of evaluations ``(labels…, t, active, value)`` with event time.

    Same rows as the batch ``hold``; a run is emitted when it ends.
    """
    use_rocksdb(evaluated.sparkSession)
    schema = ", ".join(f"k{n} string" for n in range(len(labels)))
    out = evaluated.groupBy(*labels).transformWithStateInPandas(
        _Hold(hold_sec, slide_sec),
        outputStructType=f"{schema}, pending_at bigint, firing_at bigint, resolved_at bigint, outcome string, value double",
        outputMode="Append",
        timeMode="EventTime",
    )
    for n, name in enumerate(labels):
        out = out.withColumnRenamed(f"k{n}", name)
    return out
