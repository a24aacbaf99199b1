"""Limiter and breaker on streams where one site may be very busy: state per cell of time, not per site.

Rows are buffered under (site, cell) until the watermark has passed the cell. The closed cell then becomes one
row: its attempts, and the transfer that says how *any* entry state would leave it, as in the batch operators.
A second operator keeps one small state per site and passes the cells on with their real entry states. The
replay itself keeps no state, and the cells of one site are replayed by different tasks.

The rows are those of the batch operators, a cell later than they could be known.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.operators import reliability as rel
from gleanery.streaming.packed import STATE, pack, unpack
from gleanery.streaming.stateful import WATERMARK, use_rocksdb

CELL_SEC = 600
_ROW = ("t_us", "id", "ok", "limit_capacity", "limit_rate")
_HELD = pa.schema([("t_us", pa.int64()), ("id", pa.int64()), ("ok", pa.bool_()), ("limit_capacity", pa.int32()), ("limit_rate", pa.float64())])
_PACKED = "t_us array<bigint>, id array<bigint>, ok array<boolean>, limit_capacity array<int>, limit_rate array<double>"


class _Cell(StatefulProcessor):
    """One cell of one site: its rows until it closes, then a single row with them and their transfer."""

    def __init__(self, machine: Callable[[], rel.Machine], cell_us: int) -> None:
        self.machine, self.cell_us = machine, cell_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = False
        for batch in rows:
            if len(batch):
                self.rows.appendValue(pack(batch[list(_ROW)], _HELD))
                added = True
        if added:
            self.handle.registerTimer((int(key[1]) + 1) * self.cell_us // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = unpack(self.rows.get(), _HELD).sort_by([("t_us", "ascending"), ("id", "ascending")])
        self.rows.clear()
        if held.num_rows:
            machine = self.machine()
            columns = {name: held[name].to_pylist() for name in _ROW}
            transfer = machine.transfer(zip(*(columns[c] for c in machine.columns), strict=True))
            closed = pd.to_datetime([(int(key[1]) + 1) * self.cell_us], unit="us", utc=True)
            packed = {name: [values] for name, values in columns.items()}
            yield pd.DataFrame({"site": [key[0]], "cell": [int(key[1])], "closed": closed, "transfer": [json.dumps(transfer)], **packed})

    def close(self) -> None:
        pass


class _Chain(StatefulProcessor):
    """One site: the state its last closed cell left behind. Cells come in order, as the watermark closes them."""

    def __init__(self, machine: Callable[[], rel.Machine]) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "exit string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self.machine()
        cells = pd.concat(list(rows)).sort_values("cell")
        state = tuple(json.loads(self.state.get()[0])) if self.state.exists() else machine.start()
        entries = []
        for transfer in cells["transfer"].tolist():
            entries.append(json.dumps(state))
            state = tuple(machine.apply(json.loads(transfer), state))
        self.state.update((json.dumps(state),))
        yield cells.assign(entry=entries)[["site", "cell", "entry", *_ROW]]

    def close(self) -> None:
        pass


def _replay(machine: Callable[[], rel.Machine]):
    names = [part.split()[0] for part in machine().output.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = machine()
        at = [_ROW.index(c) for c in rules.columns]
        for batch in batches:
            out = []
            for site, entry, *packed in zip(*(batch[c].tolist() for c in ("site", "entry", *_ROW)), strict=True):
                state = tuple(json.loads(entry))
                # plain numbers: levels outgrow 32 bits
                for row in zip(*(np.asarray(column).tolist() for column in packed), strict=True):
                    state, result = rules.step(state, tuple(row[n] for n in at))
                    out.append((site, row[1], row[0], *result))
            yield pd.DataFrame(out, columns=["site", "id", "t_us", *names], dtype=object)

    return run


def _by_cells(attempts: DataFrame, machine: Callable[[], rel.Machine], cell_sec: int, watermark: str) -> DataFrame:
    use_rocksdb(attempts.sparkSession)
    known = set(attempts.columns)
    cell_us = cell_sec * rel.MICROS
    limits = [
        F.col(name) if name in known else F.lit(0).cast(kind).alias(name)
        for name, kind in (("limit_capacity", "int"), ("limit_rate", "double"))
    ]
    ok = F.coalesce("ok", F.lit(False)) if "ok" in known else F.lit(True)
    t_us = F.unix_micros("ts")
    rows = attempts.withWatermark("ts", watermark).select(
        "site", "ts", F.floor(t_us / cell_us).cast("long").alias("cell"), t_us.alias("t_us"), "id", ok.alias("ok"), *limits
    )
    closed = rows.groupBy("site", "cell").transformWithStateInPandas(
        _Cell(machine, cell_us),
        outputStructType=f"site string, cell bigint, closed timestamp, transfer string, {_PACKED}",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="closed",
    )
    entered = closed.groupBy("site").transformWithStateInPandas(
        _Chain(machine), outputStructType=f"site string, cell bigint, entry string, {_PACKED}", outputMode="Append", timeMode="None"
    )
    spread = entered.repartition(F.col("site"), F.col("cell"))
    out = spread.mapInPandas(_replay(machine), f"site string, id bigint, t_us bigint, {machine().output}")
    return out.withColumn("ts", F.timestamp_micros("t_us")).drop("t_us")


def token_bucket_cells(
    attempts: DataFrame,
    capacity: int | None = None,
    rate: float = rel.REQUESTS_PER_SECOND,
    tokens: int = 1,
    cell_sec: int = CELL_SEC,
    watermark: str = WATERMARK,
) -> DataFrame:
    """``(site, id, admitted, tokens_after, ts)``, the rows of ``token_bucket``."""
    size = rel.default_capacity(rate) if capacity is None else capacity
    own = attempts.withColumns({"limit_capacity": F.lit(size), "limit_rate": F.lit(float(rate))})
    return _by_cells(own, lambda: rel._bucket_machine(tokens), cell_sec, watermark)


def breaker_cells(
    attempts: DataFrame,
    failures: int = rel.FAILURE_THRESHOLD,
    recovery_sec: float = rel.RECOVERY_SEC,
    successes: int = rel.SUCCESS_THRESHOLD,
    cell_sec: int = CELL_SEC,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Breaker state per attempt, the rows of ``breaker``."""
    rules = rel.BreakerRules(failures, round(recovery_sec * rel.MICROS), successes)
    return rel.shape_breaker(_by_cells(attempts, lambda: rel._breaker_machine(rules), cell_sec, watermark))
