"""Circuit breaker over attempts that overlap: checked when they start, recorded when they end.

An attempt asks for permission at its start; only if it got it, its outcome is recorded at its end. In
between, others start and end, so a failure may arrive while the breaker is OPEN and puts off its recovery.

The log becomes two events per attempt, in the order of time, cut into chunks by (site, time). A chunk is
replayed from an assumed entry: the breaker's state, and the decisions on the attempts that are open at the
cut. Every chunk first assumes a breaker that has seen nothing; then each one whose assumption turns out to
differ from what the chunks before it arrived at is replayed again, until none is left. A breaker forgets
quickly, so two or three rounds do; a site whose chunks never forget takes one round per chunk. The rows are
those of a replay in one piece, whatever the chunking. States go through the driver, one per chunk; decisions
on open attempts stay in tables of the shared folder.

Order at one moment: attempts that started earlier are recorded first, then attempts start by id; one without a
duration (or with a negative one) is recorded as soon as it is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleanery.operators.reliability import (
    CLOSED, FAILURE_THRESHOLD, HALF_OPEN, MICROS, OPEN, RECOVERY_SEC, STATE_NAMES, SUCCESS_THRESHOLD, BreakerRules,
)
from gleanery.session import broadcast_if_small, durable, shared_dir

ROWS_PER_CHUNK = 200_000
MIN_ROWS_PER_CHUNK = 5_000

CHECK, RECORD, SUMMARY = 0, 1, 2
_START = (CLOSED, 0, 0, None)
_ORDER = ("site", "t_us", "later", "id", "kind")
_FOUND = (
    "chunk int, kind int, site string, id bigint, t_us bigint, to_chunk int, permitted boolean, woke boolean, state_before string, "
    "state_after string, failures bigint, successes bigint, failure_rate double, last_failure_us bigint, "
    "first_site string, single boolean, mode int"
)
_NAMES = [part.split()[0] for part in _FOUND.split(", ")]


def check(rules: BreakerRules, state: tuple, t: int) -> tuple[tuple, bool, bool]:
    """State after the recovery check, whether the attempt may go on, and whether it woke the breaker."""
    mode, failed, passed, last = state
    woke = mode == OPEN and t - last >= rules.recovery_us
    if woke:
        mode, passed, last = HALF_OPEN, 0, None
    return (mode, failed, passed, last), mode != OPEN, woke


def record(rules: BreakerRules, state: tuple, t: int, ok: bool) -> tuple[tuple, float | None]:
    """State after an outcome, and the failure rate that a failure publishes."""
    mode, failed, passed, last = state
    if ok:
        if mode == HALF_OPEN:
            passed += 1
            if passed >= rules.successes:
                mode, failed = CLOSED, 0
        elif mode == CLOSED:
            failed = 0
        return (mode, failed, passed, last), None
    failed += 1
    if mode == HALF_OPEN or (mode == CLOSED and failed >= rules.failures):
        mode = OPEN
    # a failure that arrives while OPEN counts, and recovery is timed from it
    return (mode, failed, passed, t if mode == OPEN else None), failed / max(failed + passed, 1)


def events(attempts: DataFrame, chunks: int | None = None) -> DataFrame:
    """(chunk, site, t_us, later, id, kind, ok): checks and records in order, in balanced chunks whose layout is durable."""
    if chunks is None:
        rows = 2 * attempts.count()
        slots = attempts.sparkSession.sparkContext.defaultParallelism
        chunks = max(rows // ROWS_PER_CHUNK, min(slots, rows // MIN_ROWS_PER_CHUNK + 1))
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    length = F.greatest(F.coalesce(F.round(F.col("duration_sec") * MICROS).cast("long"), F.lit(0)), F.lit(0))
    row = lambda t, later, kind: F.struct(t.alias("t_us"), later.alias("later"), F.lit(kind).alias("kind"))
    both = F.array(row(start, F.lit(1), CHECK), row(start + length, F.when(length > 0, 0).otherwise(1), RECORD))
    told = attempts.select("site", F.col("id").cast("long").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"), F.inline(both))
    ordered = told.repartitionByRange(chunks, *_ORDER).sortWithinPartitions(*_ORDER)
    return durable(ordered.withColumn("chunk", F.spark_partition_id()))


def _fold(rules: BreakerRules, entries: dict[int, tuple]):
    """Replays one chunk from its assumed entry; decisions are those on attempts that started in earlier chunks."""

    def run(key: tuple, rows: pd.DataFrame, decisions: pd.DataFrame) -> pd.DataFrame:
        chunk = int(key[0])
        if not len(rows):
            return pd.DataFrame([], columns=_NAMES)
        rows = rows.sort_values(["place"])
        sites = [None if pd.isna(s) else s for s in rows["site"].tolist()]
        allowed = {
            (None if pd.isna(s) else s, i): bool(p)
            for s, i, p in zip(decisions["site"].tolist(), decisions["id"].tolist(), decisions["permitted"].tolist(), strict=True)
        }
        names = [name for name in _NAMES if name not in ("chunk", "first_site", "single", "mode")]
        out: dict[str, list] = {name: [] for name in names}
        add = [out[name].append for name in names]
        site, state = sites[0], entries.get(chunk, _START)
        columns = (rows[c].tolist() for c in ("t_us", "id", "kind", "ok", "to_chunk"))
        for name, t, number, kind, ok, to_chunk in zip(sites, *columns, strict=True):
            if name != site:
                site, state = name, _START
            to_chunk = None if to_chunk is None or pd.isna(to_chunk) else int(to_chunk)
            before = state
            if kind == CHECK:
                state, permitted, woke = check(rules, state, t)
                allowed[(name, number)] = permitted
                shown, rate = STATE_NAMES[state[0]], None
            else:
                # a decision that is not known yet is taken to be a yes
                if not allowed.pop((name, number), True):
                    continue
                state, rate = record(rules, state, t, bool(ok))
                permitted, woke, shown = True, False, STATE_NAMES[before[0]]
            mode, failed, passed, last = state
            row = (kind, name, number, t, to_chunk, permitted, woke, shown, STATE_NAMES[mode], failed, passed, rate, last)
            for put, value in zip(add, row, strict=True):
                put(value)
        mode, failed, passed, last = state
        single = all(name == sites[0] for name in sites)
        summary = (SUMMARY, site, None, None, None, None, None, None, None, failed, passed, None, last)
        for put, value in zip(add, summary, strict=True):
            put(value)
        told = [None] * (len(out["kind"]) - 1)
        ends = {"chunk": [chunk] * (len(told) + 1), "first_site": [*told, sites[0]], "single": [*told, single], "mode": [*told, mode]}
        whole = {**out, **ends}
        return pd.DataFrame({name: pd.Series(whole[name], dtype=object) for name in _NAMES})

    return run


def _entries(summaries: dict[int, dict]) -> dict[int, tuple]:
    """Entry state of each chunk from the exits of the ones before it."""
    entries, previous = {}, None
    for chunk in sorted(summaries):
        row = summaries[chunk]
        continues = previous is not None and previous["site"] == row["first_site"]
        entries[chunk] = (previous["mode"], previous["failures"], previous["successes"], previous["last_failure_us"]) if continues else _START
        previous = row
    return entries


def breaker_events(
    attempts: DataFrame,
    failures: int = FAILURE_THRESHOLD,
    recovery_sec: float = RECOVERY_SEC,
    successes: int = SUCCESS_THRESHOLD,
    chunks: int | None = None,
) -> DataFrame:
    """One row per check, and one per record of a permitted attempt.

    ``(site, id, ts, event, permitted, woke, state_before, state_after, failures, successes, failure_rate,
    last_failure_us)``; ``event`` is ``check`` or ``record``, ``state_before`` the state after the recovery check.
    ``(site, id)`` names an attempt; a null site is a site, a null ``ok`` a failure.
    """
    spark = attempts.sparkSession
    rules = BreakerRules(failures, round(recovery_sec * MICROS), successes)
    folder = f"{shared_dir(spark)}/breaker-{uuid4().hex}"
    laid_out = events(attempts, chunks).withColumn("place", F.monotonically_increasing_id())
    # attempts that end in another chunk than they started in
    side = lambda kind, name: laid_out.where(F.col("kind") == kind).select("site", "id", F.col("chunk").alias(name))
    ends = side(RECORD, "to_chunk").withColumnsRenamed({"site": "end_site", "id": "end_id"})
    starts = side(CHECK, "chunk")
    open_ones = starts.join(ends, F.col("site").eqNullSafe(F.col("end_site")) & (F.col("id") == F.col("end_id")))
    open_ones = durable(open_ones.where("chunk <> to_chunk").select("site", "id", "to_chunk"))
    told = laid_out.join(
        broadcast_if_small(open_ones.select(F.col("site").alias("end_site"), F.col("id").alias("end_id"), "to_chunk")),
        F.col("site").eqNullSafe(F.col("end_site")) & (F.col("id") == F.col("end_id")) & (F.col("kind") == CHECK),
        "left",
    )
    told = durable(told.select("chunk", "place", "site", "t_us", "id", "kind", "ok", "to_chunk"))
    decisions = spark.createDataFrame([], "chunk int, site string, id bigint, permitted boolean")
    dirty: list[int] | None = None
    summaries: dict[int, dict] = {}
    entries: dict[int, tuple] = {}
    runs: dict[int, int] = {}
    turn = 0
    while dirty is None or dirty:
        todo, given = (told, decisions) if dirty is None else (_of(told, dirty), _of(decisions, dirty))
        found = todo.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(_fold(rules, entries), _FOUND)
        found.write.parquet(f"{folder}/{turn}")
        found = spark.read.schema(_FOUND).parquet(f"{folder}/{turn}")
        for row in found.where(F.col("kind") == SUMMARY).toLocalIterator():
            summaries[row["chunk"]] = row.asDict()
            runs[row["chunk"]] = turn
        assumed, entries = entries, _entries(summaries)
        moved = {chunk for chunk, entry in entries.items() if entry != assumed.get(chunk, _START)}
        # the newest decision of every chunk on the attempts it leaves open
        latest = durable(_latest(spark, folder, runs, f"kind = {CHECK} and to_chunk is not null").select(F.col("to_chunk").alias("chunk"), "site", "id", "permitted"))
        refused = latest.where("not permitted")
        known = decisions.where("not permitted")
        changed = refused.exceptAll(known).union(known.exceptAll(refused)).select("chunk").distinct()
        moved |= {row["chunk"] for row in changed.toLocalIterator()}
        decisions, dirty, turn = latest, sorted(moved), turn + 1
    event = F.when(F.col("kind") == CHECK, "check").otherwise("record").alias("event")
    rows = _latest(spark, folder, runs, f"kind <> {SUMMARY}")
    return rows.select(
        "site", "id", F.timestamp_micros("t_us").alias("ts"), event, "permitted", "woke", "state_before", "state_after", "failures",
        "successes", "failure_rate", "last_failure_us",
    )


def _of(rows: DataFrame, chunks: list[int]) -> DataFrame:
    """The rows of some chunks; their numbers are known to the driver and few."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in chunks], "chunk int")), "chunk", "left_semi")


def _latest(spark, folder: str, runs: dict[int, int], condition: str) -> DataFrame:
    """Rows of every chunk's last replay."""
    out = None
    for turn in sorted(set(runs.values())):
        mine = [chunk for chunk, last in runs.items() if last == turn]
        rows = spark.read.schema(_FOUND).parquet(f"{folder}/{turn}").where(condition)
        rows = _of(rows, mine) if len(mine) < len(runs) else rows
        out = rows if out is None else out.union(rows)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def per_attempt(found: DataFrame) -> DataFrame:
    """One row per attempt: what its check decided, and what its record left behind (its check, if it was refused)."""
    last = F.max_by(
        F.struct("state_after", "failures", "successes", "failure_rate", "last_failure_us", F.col("ts").alias("decided_at")), F.col("event")
    )
    first = F.min_by(F.struct("ts", "permitted", "woke", "state_before"), F.col("event"))
    return found.groupBy("site", "id").agg(first.alias("c"), last.alias("r")).select("site", "id", "c.*", "r.*")


def transitions(found: DataFrame) -> DataFrame:
    """State changes: a recovery is a check's, any other change a record's."""
    woke = F.col("woke")
    changed = woke | (F.col("state_before") != F.col("state_after"))
    before = F.when(woke, "OPEN").otherwise(F.col("state_before"))
    return found.where(changed).select("site", "id", "ts", before.alias("from_state"), F.col("state_after").alias("to_state"))
