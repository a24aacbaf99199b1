"""Chunked replay against a plain sequential fold of the same rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import reliability as R

START = datetime(2024, 1, 1)


def _log(spark, rows):
    data = [(n, site, "step", START + timedelta(microseconds=us), ok) for n, (site, us, ok) in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, site string, step string, ts timestamp, ok boolean")


def _random_rows(seed, count, busy, gap_us, fail=0.4):
    rng = random.Random(seed)
    clock = {}
    rows = []
    for _ in range(count):
        site = "busy" if rng.random() < busy else rng.choice(["b", "c"])
        clock[site] = clock.get(site, 0) + rng.choice([0, gap_us // 10, gap_us, gap_us * 3])
        rows.append((site, clock[site], rng.random() > fail))
    return rows


def _sequential_bucket(rows, capacity, rate, n=1):
    state, out = {}, {}
    for number, (site, us, _) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        tokens, at = state.get(site, (float(capacity), us))
        tokens = min(capacity, tokens + (us - at) / 1e6 * rate)
        admitted = tokens >= n - 1e-9
        if admitted:
            tokens -= n
        state[site] = (tokens, us)
        out[number] = (admitted, tokens)
    return out


def _sequential_breaker(rows, threshold, recovery, needed):
    sites, out = {}, {}
    for number, (site, us, ok) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        b = sites.setdefault(site, {"st": "CLOSED", "f": 0, "s": 0, "last": None})
        if b["st"] == "OPEN" and us - b["last"] >= recovery * 1e6:
            b["st"], b["s"] = "HALF_OPEN", 0
        before = b["st"]
        rate = None
        if before != "OPEN":
            if ok:
                if before == "HALF_OPEN":
                    b["s"] += 1
                    if b["s"] >= needed:
                        b["st"], b["f"] = "CLOSED", 0
                else:
                    b["f"] = 0
            else:
                b["f"] += 1
                b["last"] = us
                if before == "HALF_OPEN" or b["f"] >= threshold:
                    b["st"] = "OPEN"
                rate = b["f"] / max(b["f"] + b["s"], 1)
        out[number] = (before, before != "OPEN", b["st"], b["f"], b["s"], rate)
    return out


@pytest.mark.parametrize(
    ("seed", "gap_us", "capacity", "rate", "tokens"),
    [(1, 400_000, 5, 2.0, 1), (2, 900_000, 20, 1.0, 1), (3, 200_000, 3, 1.5, 1), (4, 500_000, 7, 2.0, 3), (5, 2_000_000, 2, 0.5, 1)],
)
def test_bucket_chunks_equal_fold(spark, seed, gap_us, capacity, rate, tokens):
    rows = _random_rows(seed, 1500, 0.7, gap_us)
    got = R.token_bucket(_log(spark, rows), capacity, rate, tokens, chunks=9).collect()
    want = _sequential_bucket(rows, capacity, rate, tokens)
    assert len(got) == len(rows)
    for r in got:
        assert r["admitted"] == want[r["id"]][0]
        assert abs(r["tokens_after"] - want[r["id"]][1]) < 1e-6
    assert {r["admitted"] for r in got} == {True, False}


@pytest.mark.parametrize(("seed", "gap_us", "fail", "chunks"), [(1, 5_000_000, 0.5, 7), (2, 20_000_000, 0.6, 13), (3, 1_000_000, 0.7, 40), (4, 60_000_000, 0.5, 5), (5, 300_000, 0.8, 30)])
def test_breaker_chunks_equal_fold(spark, seed, gap_us, fail, chunks):
    rows = _random_rows(seed, 1500, 0.7, gap_us, fail)
    got = R.breaker(_log(spark, rows), chunks=chunks).collect()
    want = _sequential_breaker(rows, 5, 60.0, 2)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["id"]]
        assert (r["state_before"], r["permitted"], r["state_after"], r["failures"], r["successes"]) == w[:5]
        assert (r["failure_rate"] is None) == (w[5] is None)
        assert w[5] is None or abs(r["failure_rate"] - w[5]) < 1e-12
    assert {r["permitted"] for r in got} == {True, False}


def _times(*seconds):
    return [("s", round(s * 1e6), True) for s in seconds]


def test_bucket_examples(spark):
    got = [r["admitted"] for r in R.token_bucket(_log(spark, _times(0)), 10, 1.0, 10).collect()]
    assert got == [True]
    got = R.token_bucket(_log(spark, _times(*[0] * 6)), 5, 10.0).orderBy("id").collect()
    assert [r["admitted"] for r in got] == [True] * 5 + [False]
    rows = _times(*[0] * 10, 0, 0.2, 0.2)
    got = R.token_bucket(_log(spark, rows), 10, 10.0).orderBy("id").collect()
    assert [r["admitted"] for r in got] == [True] * 10 + [False, True, True]


def test_slow_rates_refill(spark):
    month = 30 * 86_400
    rows = _times(0, 0, 0, month / 2, month, 2 * month)
    got = R.token_bucket(_log(spark, rows), 2, 1 / month, chunks=3).orderBy("id").collect()
    assert [r["admitted"] for r in got] == [True, True, False, False, True, True]
    assert R.Bucket.of(5, 1 / month).gain > 0


def test_sites_have_their_own_limits(spark):
    rows = [(site, round(k * 1e5), True) for k in range(400) for site in ("a", "b", None)]
    limits = spark.createDataFrame([("a", 1.0, 3), (None, 0.5, 2)], "site string, fill_rate double, capacity int")
    got = R.token_bucket(_log(spark, rows), 7, 2.0, limits=limits, chunks=7).collect()
    want = {}
    for site, size, rate in (("a", 3, 1.0), ("b", 7, 2.0), (None, 2, 0.5)):
        own = [(n, ("s", us, ok)) for n, (name, us, ok) in enumerate(rows) if name == site]
        found = _sequential_bucket([r for _, r in own], size, rate)
        want |= {n: found[k][0] for k, (n, _) in enumerate(own)}
    assert {r["id"]: r["admitted"] for r in got} == want
    assert "limit_rate" not in R.token_bucket(_log(spark, rows), 7, 2.0, limits=limits).columns


def test_null_site_is_a_site(spark):
    rows = [(site, round(k * 3e6), k % 4 == 0) for k in range(300) for site in ("a", None)]
    got = R.breaker(_log(spark, rows), chunks=5).collect()
    want = _sequential_breaker([("" if s is None else s, us, ok) for s, us, ok in rows], 5, 60.0, 2)
    assert all((r["state_before"], r["permitted"], r["state_after"]) == want[r["id"]][:3] for r in got)


def _breaker_states(spark, *events):
    rows = [("s", round(s * 1e6), ok) for s, ok in events]
    return [r["state_after"] for r in R.breaker(_log(spark, rows)).orderBy("id").collect()]


def test_breaker_examples(spark):
    fails = [(n, False) for n in range(5)]
    assert _breaker_states(spark, *fails)[-1] == "OPEN"
    # recovery exactly at the limit, then two successes close it
    assert _breaker_states(spark, *fails, (63.9, True), (64, True), (65, True))[-3:] == ["OPEN", "HALF_OPEN", "CLOSED"]
    assert _breaker_states(spark, *fails, (64, True), (65, False))[-1] == "OPEN"


def test_transitions_and_state(spark):
    rows = [("s", n * 1_000_000, False) for n in range(5)] + [("s", 70_000_000, True), ("s", 71_000_000, True)]
    replayed = R.breaker(_log(spark, rows))
    changes = R.transitions(replayed).orderBy("ts", "part").collect()
    assert [(r["from_state"], r["to_state"]) for r in changes] == [
        ("CLOSED", "OPEN"),
        ("OPEN", "HALF_OPEN"),
        ("HALF_OPEN", "CLOSED"),
    ]
    at = F.lit(START + timedelta(seconds=10)).cast("timestamp")
    assert R.breaker_state(replayed, at).first()["state"] == "OPEN"
    at = F.lit(START + timedelta(seconds=64)).cast("timestamp")
    assert R.breaker_state(replayed, at).first()["state"] == "HALF_OPEN"


def test_backoff_schedules(spark):
    df = spark.range(1, 6).select(
        "id", R.backoff(F.col("id"), 0.5, 0.5, 4.0).alias("a"), R.backoff(F.col("id"), 0.3, 0.3, 8.0).alias("b")
    )
    rows = df.orderBy("id").collect()
    assert [r["a"] for r in rows[:2]] == [1.0, 2.0]
    assert [round(r["b"], 6) for r in rows[:4]] == [0.6, 1.2, 2.4, 4.8]
    jittered = spark.range(200).select(R.backoff(F.lit(1), 0.5, 0.5, 4.0, R.spread_of(F.col("id"))).alias("w"))
    lo, hi = jittered.agg(F.min("w"), F.max("w")).first()
    assert 0.75 <= lo < 0.8 and 1.2 < hi <= 1.25


def _exits(rules, rows, entry):
    """The state that a chunk leaves behind: from its transfer, and row by row."""
    machine, state = R._breaker_machine(rules), entry
    for row in rows:
        state, _ = machine.step(state, row)
    return tuple(machine.apply(machine.transfer(iter(rows)), entry)), state


def test_breaker_transfer_counts_successes_anew_after_a_failed_wake_up():
    rules = R.BreakerRules(failures=1, recovery_us=10, successes=2)
    by_transfer, by_rows = _exits(rules, [(0, False), (10, False), (11, True)], (R.CLOSED, 0, 2, None))
    assert by_transfer == by_rows


def test_breaker_transfer_of_a_dense_log_steps_a_few_followers_a_row():
    rng = random.Random(2)
    met = []

    class Counting(R.BreakerRules):
        def step(self, *given, **named):
            met.append(1)
            return super().step(*given, **named)

    rules = Counting(5, 3_000, 2)
    rows = [(t // 2, rng.random() > 0.45) for t in range(12_000)]
    R._breaker_transfer(rules)(iter(rows))
    assert len(met) < 8 * len(rows)
    for entry in [(R.CLOSED, 3, 1, None), (R.HALF_OPEN, 7, 1, None), *((R.OPEN, 6, 0, last) for last in range(-2999, 0, 250))]:
        by_transfer, by_rows = _exits(rules, rows[:9000], entry)
        assert by_transfer == by_rows
