"""Rate limiter, circuit breaker and retries replayed over an attempt log.

The limiter and the breaker are sequential: every decision feeds the next one. They are
still run in parallel, also inside one very busy site:

1. the log is range-partitioned by (site, time), so a busy site spans many chunks of
   similar size, and the layout is fixed with a checkpoint;
2. each chunk computes, for the site it continues from the chunk before, how *any* entry
   state would leave the chunk (its transfer), and the exit state of its last site;
3. the few transfers are chained in order, which gives every chunk its real entry state;
4. each chunk replays its rows from that state, streaming through them batch by batch.

No group is ever held in memory, and the result does not depend on the chunking: times are
whole microseconds and token levels are whole multiples of a fixed quantum.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanery.session import broadcast_if_small, durable

MICROS = 1_000_000

# Limiter, breaker and retry defaults.
REQUESTS_PER_SECOND = 2.0
BURST_SECONDS = 10
FAILURE_THRESHOLD, RECOVERY_SEC, SUCCESS_THRESHOLD = 5, 60.0, 2
RETRYABLE = (
    "TimeoutException",
    "StaleElementReferenceException",
    "NoSuchElementException",
    "ElementClickInterceptedException",
    "ElementNotInteractableException",
    "WebDriverException",
)
# exceptions that derive from the last retryable class without being listed
RETRYABLE_SUBCLASSES = (
    "InvalidSelectorException",
    "InvalidElementStateException",
    "ElementNotVisibleException",
    "ElementNotSelectableException",
    "NoSuchFrameException",
    "NoSuchWindowException",
    "NoAlertPresentException",
    "UnexpectedAlertPresentException",
    "InvalidArgumentException",
    "InvalidCookieDomainException",
    "UnableToSetCookieException",
    "MoveTargetOutOfBoundsException",
    "InvalidSessionIdException",
    "SessionNotCreatedException",
    "NoSuchCookieException",
    "NoSuchShadowRootException",
    "ScreenshotException",
    "JavascriptException",
    "ImeNotAvailableException",
    "ImeActivationFailedException",
    "InsecureCertificateException",
    "InvalidCoordinatesException",
    "InvalidSwitchToTargetException",
    "NoSuchAttributeException",
    "UnknownMethodException",
    "DetachedShadowRootException",
    "NoSuchDriverException",
)
POLICIES = {"standard": (3, 0.5, 0.5, 4.0), "aggressive": (5, 0.3, 0.3, 8.0)}
ROWS_PER_CHUNK, MIN_ROWS_PER_CHUNK = 4_000_000, 5_000
JITTER, WAIT_FLOOR = 0.25, 0.1


# --- chunked replay ----------------------------------------------------------------------

@dataclass(frozen=True)
class Machine:
    """A sequential operator.

    ``start()`` is the state before a site's first row. ``step(state, row)`` returns the next
    state and the output values; states are tuples of integers (or None). ``transfer(rows)``
    turns the rows of one chunk into a function from entry state to exit state, itself made
    of plain values; ``apply(transfer, state)`` evaluates it.
    """

    columns: tuple[str, ...]
    output: str
    start: Callable[[], tuple]
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]
    transfer: Callable[[Iterator[tuple]], list]
    apply: Callable[[list, tuple], tuple]


def _runs(batches: Iterator[pd.DataFrame], machine: Machine) -> Iterator[tuple[str, Iterator[tuple]]]:
    """Consecutive rows of one site, streamed: yields ``(site, rows)`` in order."""
    source = (
        (site, values)
        for batch in batches
        for site, values in zip(
            batch["site"].tolist(), zip(*(batch[c].tolist() for c in machine.columns)), strict=True
        )
    )
    pending = next(source, None)
    while pending is not None:
        site = pending[0]

        def rows() -> Iterator[tuple]:
            nonlocal pending
            while pending is not None and pending[0] == site:
                yield pending[1]
                pending = next(source, None)

        run = rows()
        yield site, run
        for _ in run:  # whatever the consumer left
            pass

# no site, not even a null one
_NOWHERE = object()
_SUMMARY = "chunk INT, first_site STRING, last_site STRING, transfer STRING, last_exit STRING"


def _summarize(machine: Machine):

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = None

        def noted() -> Iterator[pd.DataFrame]:
            nonlocal chunk
            for batch in batches:
                if chunk is None and len(batch):
                    chunk = int(batch["chunk"].iloc[0])
                yield batch

        first = _NOWHERE
        last = transfer = exit_state = None
        for site, rows in _runs(noted(), machine):
            if first is _NOWHERE:
                first, transfer = site, machine.transfer(rows)
            else:
                state = machine.start()
                for row in rows:
                    state, _ = machine.step(state, row)
                exit_state = state
            last = site
        if first is not _NOWHERE:
            yield pd.DataFrame(
                {
                    "chunk": [chunk],
                    "first_site": [first],
                    "last_site": [last],
                    "transfer": [json.dumps(transfer)],
                    "last_exit": [None if exit_state is None else json.dumps(exit_state)],
                }
            )

    return run


def _chain(summaries: Iterator, machine: Machine) -> dict[int, tuple]:
    """Entry state of every chunk's first site; one small record per chunk passes by, in order."""

    entries, site, state = {}, _NOWHERE, None
    for row in summaries:
        entry = state if row["first_site"] == site else machine.start()
        entries[row["chunk"]] = entry
        if row["last_site"] == row["first_site"]:
            state = machine.apply(json.loads(row["transfer"]), entry)
        else:
            state = tuple(json.loads(row["last_exit"]))
        site = row["last_site"]
    return entries


def _replay(machine: Machine, entries: dict[int, tuple]):
    names = [part.split()[0] for part in machine.output.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, state = _NOWHERE, None
        for batch in batches:
            out = []
            for chunk, name, *values in zip(
                batch["chunk"].tolist(),
                batch["site"].tolist(),
                *(batch[c].tolist() for c in machine.columns),
                strict=True,
            ):
                if name != site:
                    state = entries[chunk] if site is _NOWHERE else machine.start()
                    site = name
                state, result = machine.step(state, values)
                out.append(result)
            yield pd.concat(
                [batch.drop(columns=["chunk", "t_us"]).reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=object)],
                axis=1,
            )

    return run


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def chunk_count(log: DataFrame) -> int:
    """Chunks of a few million rows each; a small log still uses the task slots there are."""
    rows = log.count()
    slots = log.sparkSession.sparkContext.defaultParallelism
    return max(rows // ROWS_PER_CHUNK, min(slots, rows // MIN_ROWS_PER_CHUNK + 1))


def chunked(log: DataFrame, chunks: int | None = None) -> DataFrame:
    """The log in (site, time, id) order, cut into balanced chunks whose layout is durable."""
    count = chunks or chunk_count(log)
    ordered = (
        log.withColumn("t_us", _micros(F.col("ts")))
        .repartitionByRange(count, "site", "t_us", "id")
        .sortWithinPartitions("site", "t_us", "id")
        .withColumn("chunk", F.spark_partition_id())
    )
    return durable(ordered)


def replay(log: DataFrame, machine: Machine, chunks: int | None = None) -> DataFrame:
    """Run a sequential operator over ``log(site, ts, id, …)``; adds its output columns."""
    laid_out = chunked(log, chunks)
    narrow = laid_out.select("chunk", "site", *machine.columns)
    summaries = narrow.mapInPandas(_summarize(machine), _SUMMARY).orderBy("chunk")
    entries = _chain(summaries.toLocalIterator(), machine)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in laid_out.schema if f.name not in ("chunk", "t_us")]
    return laid_out.mapInPandas(_replay(machine, entries), ", ".join([*kept, machine.output]))


# --- token bucket ------------------------------------------------------------------------

def _simple(rate: float) -> Fraction:
    """The simplest of ever finer fractions that is the rate to double precision, however slow it is."""
    exact, limit = Fraction(rate), 10**6
    while abs((near := exact.limit_denominator(limit)) - exact) > abs(exact) / 10**13:
        limit *= 10**3
    return near


@dataclass(frozen=True)
class Bucket:
    """A token bucket in whole numbers: one token is ``unit`` quanta, a microsecond adds ``gain``."""

    capacity: int
    gain: int
    unit: int
    cost: int

    @classmethod
    def of(cls, capacity: int, rate: float, tokens: int = 1) -> Bucket:
        per_micro = _simple(rate) / MICROS
        return cls(capacity * per_micro.denominator, per_micro.numerator, per_micro.denominator, tokens * per_micro.denominator)

    def tokens(self, level: int) -> float:
        return level / self.unit


def _bucket_stages(bucket: Bucket, times: Iterator[int]) -> list:
    """Stages of pieces ``(entry from, entry to, shift or None, constant)`` of the level function.

    All entry levels are followed at once: intervals that decide alike stay together, a full
    bucket makes them a constant, and neighbours with the same rule are merged again, so
    there are at most about ``capacity / cost`` pieces. Once every level is below the cost of
    one attempt, the rest only depends on that level: a new stage starts from it, with one
    piece, and a busy chunk goes on with two or three.
    """
    capacity, cost = bucket.capacity, bucket.cost

    def refill(pieces: list[tuple], gain: int) -> list[tuple]:
        out: list[tuple] = []
        for low, high, shift, constant in pieces:
            if constant is not None:
                out.append((low, high, None, min(capacity, constant + gain)))
                continue
            moved = shift + gain
            if high + moved < capacity:
                out.append((low, high, moved, None))
            elif low + moved >= capacity:
                out.append((low, high, None, capacity))
            else:
                edge = capacity - moved
                out.append((low, edge - 1, moved, None))
                out.append((edge, high, None, capacity))
        return out

    def consume(pieces: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for low, high, shift, constant in pieces:
            if constant is not None:
                parts = ((low, high, None, constant - cost if constant >= cost else constant),)
            elif low + shift >= cost:
                parts = ((low, high, shift - cost, None),)
            elif high + shift < cost:
                parts = ((low, high, shift, None),)
            else:
                edge = cost - shift
                parts = ((low, edge - 1, shift, None), (edge, high, shift - cost, None))
            for part in parts:
                if out and out[-1][2] == part[2] and out[-1][3] == part[3]:
                    out[-1] = (out[-1][0], part[1], part[2], part[3])
                else:
                    out.append(part)
        return out

    # the gap before the first row belongs to the entry state; levels count from that row
    pieces = [(0, capacity, 0, None)]
    stages = [pieces]
    first = at = None
    narrow = capacity < cost
    for t in times:
        first, at = (t, t) if at is None else (first, at)
        pieces = consume(refill(pieces, (t - at) * bucket.gain))
        at = t
        stages[-1] = pieces
        if not narrow and len(pieces) > 2:
            highest = max(high + shift if constant is None else constant for _, high, shift, constant in pieces)
            if highest < cost:
                narrow = True
                pieces = [(0, cost - 1, 0, None)]
                stages.append(pieces)
    return [first, at, stages]


@cache
def _bucket(capacity: int, rate: float, tokens: int) -> Bucket:
    return Bucket.of(capacity, rate, tokens)


def _bucket_machine(tokens: int) -> Machine:
    """State: (level or None while full, time of the last event or None). A site's rows carry its parameters."""
    def refilled(bucket: Bucket, state: tuple, t: int) -> int:
        level, at = state
        return bucket.capacity if level is None else min(bucket.capacity, level + (t - at) * bucket.gain)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        t, capacity, rate = row
        bucket = _bucket(capacity, rate, tokens)
        level = refilled(bucket, state, t)
        admitted = level >= bucket.cost
        if admitted:
            level -= bucket.cost
        return (level, t), (admitted, bucket.tokens(level))

    def transfer(rows: Iterator[tuple]) -> list:
        t, capacity, rate = next(rows)
        times = chain([t], (row[0] for row in rows))
        return [*_bucket_stages(_bucket(capacity, rate, tokens), times), capacity, rate]

    def apply(transfer: list, state: tuple) -> tuple:
        first, last, stages, capacity, rate = transfer
        level = refilled(_bucket(capacity, rate, tokens), tuple(state), first)
        for pieces in stages:
            rule = next((piece for piece in pieces if piece[0] <= level <= piece[1]), None)
            if rule is None:
                raise AssertionError("level outside the bucket")
            level = rule[3] if rule[3] is not None else level + rule[2]
        return level, last

    return Machine(
        columns=("t_us", "limit_capacity", "limit_rate"),
        output="admitted boolean, tokens_after double",
        start=lambda: (None, None),
        step=step,
        transfer=transfer,
        apply=apply,
    )


def default_capacity(requests_per_second: float) -> int:
    return max(1, int(requests_per_second * BURST_SECONDS))


def limiter_defaults(sites: DataFrame, rate: Column | None = None) -> DataFrame:
    """Per-site limiter parameters: capacity is ten seconds' worth of requests, at least one."""
    rps = F.lit(REQUESTS_PER_SECOND) if rate is None else F.coalesce(rate, F.lit(REQUESTS_PER_SECOND))
    return sites.withColumn("fill_rate", rps.cast("double")).withColumn(
        "capacity", F.greatest(F.lit(1), (F.col("fill_rate") * BURST_SECONDS).cast("int"))
    )


def token_bucket(
    attempts: DataFrame,
    capacity: int | None = None,
    rate: float = REQUESTS_PER_SECOND,
    tokens: int = 1,
    chunks: int | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Admission per attempt, drop mode: adds ``admitted, tokens_after``.

    The bucket starts full, refills with time, and an attempt that finds too few tokens
    changes nothing but the clock. ``limits(site, fill_rate, capacity)``, as of
    :func:`limiter_defaults`, gives sites their own parameters; the others have ``capacity``
    and ``rate``. A null site is a site of its own.
    """
    size = default_capacity(rate) if capacity is None else capacity
    if limits is None:
        own = attempts.withColumns({"limit_capacity": F.lit(size), "limit_rate": F.lit(float(rate))})
    else:
        table = limits.groupBy(F.col("site").alias("limit_site")).agg(
            F.max("capacity").cast("int").alias("limit_capacity"), F.max("fill_rate").cast("double").alias("limit_rate")
        )
        own = attempts.join(broadcast_if_small(table), F.col("site").eqNullSafe(F.col("limit_site")), "left").drop("limit_site")
        own = own.withColumns(
            {"limit_capacity": F.coalesce("limit_capacity", F.lit(size)), "limit_rate": F.coalesce("limit_rate", F.lit(float(rate)))}
        )
    if attempts.isStreaming:
        from gleanery.streaming.stateful import token_bucket_stream

        return token_bucket_stream(own, tokens)
    return replay(own, _bucket_machine(tokens), chunks).drop("limit_capacity", "limit_rate")


# --- circuit breaker ---------------------------------------------------------------------

CLOSED, OPEN, HALF_OPEN = 0, 1, 2
STATE_NAMES = ("CLOSED", "OPEN", "HALF_OPEN")
_BREAKER_OUTPUT = (
    "state_before string, permitted boolean, state_after string, failures bigint, successes bigint, "
    "failure_rate double, last_failure_us bigint"
)


@dataclass(frozen=True)
class BreakerRules:
    failures: int = FAILURE_THRESHOLD
    recovery_us: int = int(RECOVERY_SEC * MICROS)
    successes: int = SUCCESS_THRESHOLD

    def step(self, state: tuple, t: int, ok: bool, any_failed: bool = False) -> tuple[tuple, tuple]:
        """State (mode, failures, successes, last failure while OPEN) -> next state and the row's outcome.

        ``any_failed`` says that the failure count is an unknown offset; it then never decides,
        because only a CLOSED breaker compares it and a CLOSED count is always known.
        """
        was, failed, passed, last = state
        mode = was
        if mode == OPEN and t - last >= self.recovery_us:
            mode, passed = HALF_OPEN, 0
        before, rate = mode, None
        if before != OPEN:
            if ok:
                if mode == HALF_OPEN:
                    passed += 1
                    if passed >= self.successes:
                        mode, failed = CLOSED, 0
                else:
                    failed = 0
            else:
                failed += 1
                if mode == HALF_OPEN or failed >= self.failures:
                    mode = OPEN
                rate = failed / max(failed + passed, 1) if not any_failed else None
            last = t if mode == OPEN else None
        shown = STATE_NAMES[was] if before == was else "OPEN>HALF_OPEN"
        return (mode, failed, passed, last), (shown, before != OPEN, STATE_NAMES[mode], failed, passed, rate, last)


def _breaker_transfer(rules: BreakerRules) -> Callable[[Iterator[tuple]], list]:
    """Exit state for every entry state.

    Followed at once: each CLOSED failure count, each HALF_OPEN success count, and an OPEN
    entry per moment it could wake up (a new follower starts at every row until the first
    recovery time has passed). Followers that reach the same state join; a counter still carried
    from the entry is kept as an offset to it. Nothing happens to an OPEN follower until it wakes up,
    so those wait in the order of their last failure, and a row meets the few that are awake.
    """

    def run(rows: Iterator[tuple]) -> list:
        # (mode, failures, successes, last failure, failures are an offset, successes are an offset)
        groups: dict[tuple, list] = {}
        for count in range(rules.failures):
            groups[(CLOSED, count, 0, None, False, True)] = [["closed", count, count]]
        for count in range(rules.successes):
            groups[(HALF_OPEN, 0, count, None, True, False)] = [["half", count, count]]
        asleep: deque[tuple[tuple, list]] = deque()
        woken = (HALF_OPEN, 0, 0, None, True, False)
        first = previous = None
        waking = True
        for t, ok in rows:
            if waking:
                # an OPEN entry that recovers after the row before and no later than this one
                groups.setdefault(woken, []).append(["open", previous, t])
                first = t if first is None else first
                previous = t
                waking = t - first < rules.recovery_us
            while asleep and t - asleep[0][0][3] >= rules.recovery_us:
                # at one moment several rows can send followers to the same state
                key, members = asleep.popleft()
                groups.setdefault(key, []).extend(members)
            moved: dict[tuple, list] = {}
            for (mode, failed, passed, last, failed_from, passed_from), members in groups.items():
                was = mode
                (mode, failed_to, passed_to, last), _ = rules.step((mode, failed, passed, last), t, ok, any_failed=failed_from)
                if mode == CLOSED and (was != CLOSED or ok):
                    failed_from = False
                # an OPEN follower that is met wakes up, which ends its count even if it fails at once
                if passed_to != passed or was == OPEN:
                    passed_from = False
                key = (mode, failed_to, passed_to, last, failed_from, passed_from)
                held = moved.get(key)
                if held is None:
                    moved[key] = members
                elif len(held) < len(members):
                    members.extend(held)
                    moved[key] = members
                else:
                    held.extend(members)
            for key in [key for key in moved if key[0] == OPEN]:
                asleep.append((key, moved.pop(key)))
            groups = moved
        left = [*groups.items(), *asleep]
        return [previous if waking else None, [[list(state), _joined(members)] for state, members in left]]

    return run


def _joined(members: list) -> list:
    """Adjacent wake-up ranges of one follower become one range."""
    out: list = []
    # ranges in the order of time; only the first one has no lower end
    for member in sorted(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0)):
        if out and member[0] == "open" and out[-1][0] == "open" and out[-1][2] == member[1]:
            out[-1] = ["open", out[-1][1], member[2]]
        else:
            out.append(member)
    return out


def _breaker_apply(rules: BreakerRules) -> Callable[[list, tuple], tuple]:
    def enters(member: list, mode: int, failed: int, passed: int, wake: int | None) -> bool:
        kind, low, high = member
        if kind == "closed":
            return mode == CLOSED and failed == low
        if kind == "half":
            return mode == HALF_OPEN and passed == low
        return wake is not None and (low is None or wake > low) and wake <= high

    def run(transfer: list, entry: tuple) -> tuple:
        asleep_until, groups = transfer
        mode, failed, passed, last = entry
        wake = last + rules.recovery_us if mode == OPEN else None
        if wake is not None and asleep_until is not None and wake > asleep_until:
            return tuple(entry)
        for (out_mode, out_failed, out_passed, out_last, failed_from, passed_from), members in groups:
            if any(enters(member, mode, failed, passed, wake) for member in members):
                return (
                    out_mode,
                    out_failed + (failed if failed_from else 0),
                    out_passed + (passed if passed_from else 0),
                    out_last,
                )
        raise AssertionError("entry state not covered")

    return run


def _breaker_machine(rules: BreakerRules) -> Machine:
    return Machine(
        columns=("t_us", "ok"),
        output=_BREAKER_OUTPUT,
        start=lambda: (CLOSED, 0, 0, None),
        step=lambda state, row: rules.step(state, row[0], row[1]),
        transfer=_breaker_transfer(rules),
        apply=_breaker_apply(rules),
    )


def breaker(
    attempts: DataFrame,
    failures: int = FAILURE_THRESHOLD,
    recovery_sec: float = RECOVERY_SEC,
    successes: int = SUCCESS_THRESHOLD,
    record_at: str = "start",
    chunks: int | None = None,
) -> DataFrame:
    """Breaker state per attempt; a refused attempt (``permitted`` false) records nothing.

    Adds ``state_before, permitted, state_after, failures, successes, failure_rate, last_failure_us``;
    ``state_before`` is the state after the recovery check, ``woke`` marks a time-driven
    OPEN -> HALF_OPEN, ``last_failure_us`` is kept while OPEN. With ``record_at='end'`` an attempt
    asks at its start and is recorded at its end, others in between (:mod:`gleanery.operators.overlap`);
    the columns after ``permitted`` are then those its record left behind, at ``decided_at``.
    """
    if record_at == "end":
        from gleanery.operators import overlap

        if attempts.isStreaming:
            raise ValueError("record_at='end' needs a batch")
        found = overlap.per_attempt(overlap.breaker_events(attempts, failures, recovery_sec, successes, chunks)).drop("ts")
        same = (F.col("site").eqNullSafe(F.col("seen_site"))) & (F.col("id") == F.col("seen_id"))
        return attempts.join(found.withColumnsRenamed({"site": "seen_site", "id": "seen_id"}), same).drop("seen_site", "seen_id")
    rules = BreakerRules(failures, round(recovery_sec * MICROS), successes)
    if attempts.isStreaming:
        from gleanery.streaming.stateful import breaker_stream

        return breaker_stream(attempts, rules)
    return shape_breaker(replay(attempts, _breaker_machine(rules), chunks))


def shape_breaker(replayed: DataFrame) -> DataFrame:
    woke = F.col("state_before").contains(">")
    return replayed.withColumn("woke", woke).withColumn(
        "state_before", F.when(woke, "HALF_OPEN").otherwise(F.col("state_before"))
    )


def transitions(replayed: DataFrame) -> DataFrame:
    """State changes in order: a time-driven wake-up is its own row (``part`` 0)."""
    woke = F.when(
        F.col("woke"),
        F.struct(F.lit(0).alias("part"), F.lit("OPEN").alias("from_state"), F.lit("HALF_OPEN").alias("to_state")),
    )
    changed = F.when(
        F.col("state_before") != F.col("state_after"),
        F.struct(F.lit(1).alias("part"), F.col("state_before").alias("from_state"), F.col("state_after").alias("to_state")),
    )
    return replayed.select("site", "id", "ts", F.inline(F.array_compact(F.array(woke, changed))))


def transition_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("site", "from_state", "to_state").agg(F.count(F.lit(1)).alias("transitions"))


def breaker_state(replayed: DataFrame, at: Column, recovery_sec: float = RECOVERY_SEC) -> DataFrame:
    """State per site at a moment: the last one recorded, woken up when recovery has passed."""
    last = replayed.where(F.col("ts") <= at).groupBy("site").agg(
        F.max_by(F.struct("state_after", "last_failure_us"), F.struct("ts", "id")).alias("s")
    )
    recovered = _micros(at) - F.col("s.last_failure_us") >= round(recovery_sec * MICROS)
    return last.select(
        "site",
        F.when((F.col("s.state_after") == "OPEN") & recovered, "HALF_OPEN").otherwise(F.col("s.state_after")).alias("state"),
    )


def failure_rate_gauge(replayed: DataFrame) -> DataFrame:
    """Last published failure rate per site (published on failures only)."""
    return (
        replayed.where(F.col("failure_rate").isNotNull())
        .groupBy("site")
        .agg(F.max_by("failure_rate", F.struct("ts", "id")).alias("failure_rate"))
    )


# --- retries -----------------------------------------------------------------------------

def is_retryable(exception_type: Column | str) -> Column:
    """Decided by the final exception class: the retryable ones and whatever derives from them."""
    kind = F.col(exception_type) if isinstance(exception_type, str) else exception_type
    return F.coalesce(kind.isin(*RETRYABLE, *RETRYABLE_SUBCLASSES), F.lit(False))


def backoff(attempt: Column, multiplier: float, min_wait: float, max_wait: float, spread: Column | None = None) -> Column:
    """Exponential wait after the given attempt. ``spread`` in [-1, 1] adds up to a quarter of jitter."""
    wait = F.greatest(F.lit(min_wait), F.least(F.lit(max_wait), F.lit(multiplier) * F.pow(F.lit(2.0), attempt)))
    if spread is None:
        return wait
    return F.greatest(F.lit(WAIT_FLOOR), wait + wait * JITTER * spread)


def spread_of(*key: Column) -> Column:
    """Repeatable value in [-1, 1) from a key, in place of a random draw."""
    return F.pmod(F.xxhash64(*key), F.lit(2_000_001)) / 1_000_000.0 - 1.0


def register(spark: SparkSession) -> None:
    """The un-jittered wait as a SQL function."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION backoff_wait(attempt INT, multiplier DOUBLE, min_wait DOUBLE,"
        " max_wait DOUBLE) RETURNS DOUBLE"
        " RETURN greatest(min_wait, least(max_wait, multiplier * power(2, attempt)))"
    )


def retry_plan(
    attempts: DataFrame,
    policy: str = "standard",
    job: tuple[str, ...] = ("site", "step", "job_id"),
    jitter: bool = False,
) -> DataFrame:
    """Attempt number, whether another try is due, when, and whether the policy is exhausted.

    On a stream the decisions follow event time and jitter is left out. A job holds at most the handful of tries its policy allows, so the window per job is short.
    """
    if attempts.isStreaming:
        from gleanery.streaming.retries import retry_plan_stream

        return retry_plan_stream(attempts, policy, job)
    w = Window.partitionBy(*job).orderBy("ts", "id")
    return decided(attempts.withColumn("attempt", F.row_number().over(w)), policy, job if jitter else None)


def decided(numbered: DataFrame, policy: str, draw_from: tuple[str, ...] | None = None) -> DataFrame:
    """Retry decisions on attempts that are numbered within their job."""
    stop, multiplier, low, high = POLICIES[policy]
    retryable = ~F.col("ok") & is_retryable("exception_type")
    again = retryable & (F.col("attempt") < stop)
    draw = spread_of(*[F.col(c) for c in draw_from], F.col("attempt")) if draw_from else None
    wait = backoff(F.col("attempt"), multiplier, low, high, draw)
    return (
        numbered.withColumn("eligible", again)
        .withColumn("exhausted", retryable & (F.col("attempt") >= stop))
        .withColumn("wait_sec", F.when(again, wait))
        .withColumn(
            "next_attempt_at",
            F.when(again, F.timestamp_micros(_micros(F.col("ts")) + F.round(F.col("wait_sec") * MICROS).cast("long"))),
        )
    )


def retry_outcome(plan: DataFrame, job: tuple[str, ...] = ("site", "step", "job_id")) -> DataFrame:
    """Per job: tries, final success, exhaustion, and the error that is raised in the end."""
    last = F.max_by(F.struct("ok", "exception_type", "exhausted"), "attempt")
    return (
        plan.groupBy(*job)
        .agg(F.max("attempt").alias("attempts"), last.alias("last"))
        .select(
            *job,
            "attempts",
            F.col("last.ok").alias("succeeded"),
            F.col("last.exhausted").alias("exhausted"),
            F.when(~F.col("last.ok"), F.col("last.exception_type")).alias("raised"),
        )
    )


def retries(plan: DataFrame) -> DataFrame:
    """Attempts that lead to another try, with the site and class they are counted under."""
    return plan.where("eligible").select("site", "exception_type", "ts")
