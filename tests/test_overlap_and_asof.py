"""Overlapping attempts and as-of joins against plain folds, for any chunking."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import asof, overlap, reliability as R

START = datetime(2024, 1, 1)


def log(spark, rows):
    data = [(n, site, START + timedelta(microseconds=us), length, ok) for n, (site, us, length, ok) in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, site string, ts timestamp, duration_sec double, ok boolean")


def random_rows(seed, count, busy=0.7, gap=2_000_000, longest=40.0, fail=0.5):
    rng, clock, rows = random.Random(seed), {}, []
    for _ in range(count):
        site = "busy" if rng.random() < busy else rng.choice(["b", None])
        clock[site] = clock.get(site, 0) + rng.choice([0, gap // 7, gap, gap * 9])
        length = rng.choice([None, 0.0, -1.0, rng.random(), rng.random() * longest, longest])
        rows.append((site, clock[site], length, rng.choice([None, False]) if rng.random() < fail else True))
    return rows


def sequential(rows, threshold, recovery, needed):
    """The rules as they read: one pass over checks and records in the order of time."""
    events = []
    for number, (site, us, length, ok) in enumerate(rows):
        micros = max(round((length or 0) * 1e6), 0)
        events.append((us, 1, number, 0, site, ok))
        events.append((us + micros, 0 if micros else 1, number, 1, site, ok))
    sites, refused, out = {}, set(), {}
    for t, _, number, kind, site, ok in sorted(events, key=lambda e: e[:4]):
        b = sites.setdefault(site, {"st": "CLOSED", "f": 0, "s": 0, "last": None})
        if kind == 0:
            woke = b["st"] == "OPEN" and t - b["last"] >= recovery * 1e6
            if woke:
                b["st"], b["s"] = "HALF_OPEN", 0
            if b["st"] == "OPEN":
                refused.add(number)
            out[number, "check"] = (b["st"], woke, b["st"], b["f"], b["s"])
            continue
        if number in refused:
            continue
        before = b["st"]
        if ok:
            if before == "HALF_OPEN":
                b["s"] += 1
                if b["s"] >= needed:
                    b["st"], b["f"] = "CLOSED", 0
            elif before == "CLOSED":
                b["f"] = 0
        else:
            b["f"], b["last"] = b["f"] + 1, t
            if before == "HALF_OPEN" or (before == "CLOSED" and b["f"] >= threshold):
                b["st"] = "OPEN"
        out[number, "record"] = (before, False, b["st"], b["f"], b["s"])
    return out


@pytest.mark.parametrize("seed, chunks, recovery", [(1, 1, 20.0), (2, 7, 20.0), (3, 25, 5.0), (4, 12, 300.0)])
def test_breaker_over_overlapping_attempts(spark, seed, chunks, recovery):
    rows = random_rows(seed, 400)
    got = overlap.breaker_events(log(spark, rows), 3, recovery, 2, chunks=chunks).collect()
    found = {(r.id, r.event): (r.state_before, r.woke, r.state_after, r.failures, r.successes) for r in got}
    assert len(found) == len(got)
    assert found == sequential(rows, 3, recovery, 2)


def test_a_breaker_that_never_forgets(spark):
    """Nothing but failures at an even pace: every chunk depends on the one before it."""
    rows = [("s", n * 1_000_000, 2.5, False) for n in range(200)]
    want = sequential(rows, 3, 7.0, 2)
    got = overlap.breaker_events(log(spark, rows), 3, 7.0, 2, chunks=9).collect()
    assert {(r.id, r.event): (r.state_before, r.woke, r.state_after, r.failures, r.successes) for r in got} == want


def test_attempts_longer_than_chunks(spark):
    """A decision is carried over many cuts; a failure that arrives while OPEN puts off the recovery."""
    rows = [("s", 0, 100.0, False)] + [("s", n * 1_000_000, 0.0, False) for n in range(1, 60)]
    got = overlap.breaker_events(log(spark, rows), 2, 70.0, 1, chunks=10)
    want = sequential(rows, 2, 70.0, 1)
    assert {(r.id, r.event): (r.state_before, r.woke, r.state_after, r.failures, r.successes) for r in got.collect()} == want
    late = got.where("id = 0 and event = 'record'").first()
    assert (late.state_before, late.state_after, late.failures) == ("OPEN", "OPEN", 3)
    assert late.last_failure_us == R.MICROS * 100 + int(START.timestamp() * 0) + got.where("id = 0 and event = 'check'").select(F.unix_micros("ts")).first()[0]


def test_without_durations_both_breakers_agree(spark):
    rows = [(s, us, 0.0, bool(ok)) for s, us, _, ok in random_rows(7, 300)]
    attempts = log(spark, rows)
    columns = ["id", "site", "state_before", "permitted", "woke", "state_after", "failures", "successes", "failure_rate"]
    whole = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: r[0])
    assert whole(R.breaker(attempts, 3, 15.0, record_at="end", chunks=4)) == whole(R.breaker(attempts, 3, 15.0))


def test_end_records_keep_the_attempts_columns(spark):
    attempts = log(spark, [("a", 0, 5.0, False), (None, 1, 1.0, True)])
    got = R.breaker(attempts, record_at="end").orderBy("id").collect()
    assert [(r.site, r.ok, r.permitted, r.failures) for r in got] == [("a", False, True, 1), (None, True, True, 0)]
    assert (got[0].decided_at - got[0].ts) == timedelta(seconds=5)
    assert R.breaker(attempts.limit(0), record_at="end").collect() == []


def test_transitions_of_overlapping_attempts(spark):
    rows = random_rows(5, 300)
    found = overlap.breaker_events(log(spark, rows), 3, 20.0, 2, chunks=5)
    want = []
    for (number, event), (before, woke, after, _, _) in sequential(rows, 3, 20.0, 2).items():
        if woke:
            want.append((number, "OPEN", "HALF_OPEN"))
        elif event == "record" and before != after:
            want.append((number, before, after))
    assert sorted((r.id, r.from_state, r.to_state) for r in overlap.transitions(found).collect()) == sorted(want)


# as-of join


def brute_asof(left, right, within=None):
    out = []
    for number, site, t in left:
        mine = [(rt, rid, v) for rid, rsite, rt, v in right if rsite == site and rt is not None and t is not None and rt <= t]
        best = max(mine, key=lambda m: m[:2], default=None)
        good = best is not None and (within is None or (t - best[0]).total_seconds() <= within)
        out.append((number, best[2] if good else None))
    return sorted(out)


@pytest.mark.parametrize("chunks, within", [(None, None), (11, None), (11, 60.0), (1, 5.0)])
def test_asof_equals_brute_force(spark, chunks, within):
    rng = random.Random(chunks or 0)
    at = lambda: None if rng.random() < 0.05 else START + timedelta(seconds=rng.randint(0, 3000))
    site = lambda: "hot" if rng.random() < 0.8 else rng.choice(["x", "y", None])
    left = [(n, site(), at()) for n in range(300)]
    right = [(n, site(), at(), rng.choice([None, rng.random()])) for n in range(200)]
    a = spark.createDataFrame([(*r, "kept", 1) for r in left], "n int, site string, t timestamp, id string, __own int")
    b = spark.createDataFrame(right, "id bigint, site string, ts timestamp, value double")
    got = asof.join(a, b, ("site",), "t", "ts", "id", ("value",), within, chunks)
    assert got.columns == [*a.columns, "value"]
    assert sorted((r.n, r.value) for r in got.collect()) == brute_asof(left, right, within)


def test_asof_of_nothing_and_clashes(spark):
    a = spark.createDataFrame([(1, "s", START)], "n int, site string, t timestamp")
    b = spark.createDataFrame([], "id bigint, site string, ts timestamp, value double")
    assert [r.value for r in asof.join(a, b, ("site",), "t", "ts", "id", ("value",)).collect()] == [None]
    assert asof.join(a.limit(0), b, ("site",), "t", "ts", "id", ("value",)).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        asof.join(a.withColumn("value", F.lit(1)), b, ("site",), "t", "ts", "id", ("value",))


def test_replayed_chunks_are_bounded_well_below_a_million_rows():
    from gleanery.operators import overlap

    # four workers hold a chunk each, with everything that is made of it
    assert overlap.ROWS_PER_CHUNK <= 200_000
