"""Streams with state per cell, timers, time-to-live, retry counters and late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import alerts as A, reliability as R
from gleanery.plans import stream_queries
from gleanery.sources import attempts as attempts_source
from gleanery.streaming import cells, late, retries, stateful, windows as W

START = datetime(2024, 1, 1)
SCHEMA = attempts_source.ATTEMPT_SCHEMA + ", job_id STRING"
KINDS = ["TimeoutException", "WebDriverException", "ValueError"]


def attempts_at(seconds, sites, seed=3, fail=0.45):
    rng = random.Random(seed)
    rows = []
    for n, at in enumerate(seconds):
        ok = rng.random() >= fail
        kind = None if ok else rng.choice(KINDS)
        rows.append((n, rng.choice(sites), "step", START + timedelta(seconds=at), float(at % 7), ok, kind, f"j{at // 500}-{rng.randint(0, 2)}"))
    return rows


def as_files(spark, folder, *parts):
    """One file per part, in this order."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, df, name, tmp):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return spark.table(name), query


def far(n=90_000, days=30):
    return [(n, "far", "step", START + timedelta(days=days), 1.0, True, None, "far")]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def busy(spark):
    """One very busy site beside a small one, shuffled within each file."""
    rng = random.Random(9)
    at, seconds = 0, []
    for _ in range(700):
        at += rng.choice([0, 1, 2, 9, 40])
        seconds.append(at)
    rows = attempts_at(seconds, ["hot"] * 9 + ["cold"])
    parts = [rows[n : n + 175] for n in range(0, 700, 175)]
    for part in parts:
        rng.shuffle(part)
    return rows, parts


def test_bucket_by_cells(spark, busy, tmp_path):
    rows, parts = busy
    stream = as_files(spark, str(tmp_path / "in"), *parts, far())
    got, _ = drained(spark, cells.token_bucket_cells(stream, 3, 0.1, cell_sec=60), "bucket_cells", tmp_path / "c")
    want = R.token_bucket(spark.createDataFrame(rows, SCHEMA), 3, 0.1)
    columns = ("id", "site", "admitted", "tokens_after")
    assert rows_of(got.where("site <> 'far'"), *columns) == rows_of(want, *columns)


def test_breaker_by_cells(spark, busy, tmp_path):
    rows, parts = busy
    stream = as_files(spark, str(tmp_path / "in"), *parts, far())
    got, query = drained(spark, cells.breaker_cells(stream, 3, 30.0, cell_sec=60), "breaker_cells", tmp_path / "c")
    want = R.breaker(spark.createDataFrame(rows, SCHEMA), 3, 30.0)
    columns = ("id", "site", "state_before", "permitted", "state_after", "failures", "woke")
    assert rows_of(got.where("site <> 'far'"), *columns) == rows_of(want, *columns)
    # the site's own state is one row; its attempts are held by cell
    chain = query.lastProgress["stateOperators"]
    assert min(op["numRowsTotal"] for op in chain) <= 3


def test_recovery_of_a_silent_site_by_timer(spark, tmp_path):
    failing = [(n, "silent", "step", START + timedelta(seconds=n), 1.0, False, "ValueError", "j") for n in range(5)]
    later = [(50, "other", "step", START + timedelta(hours=2), 1.0, True, None, "j")]
    end = [(51, "other", "step", START + timedelta(hours=4), 1.0, True, None, "j")]
    stream = as_files(spark, str(tmp_path / "in"), failing, later, end)
    told, _ = drained(spark, stateful.breaker_stream(stream, R.BreakerRules(), timers=True), "recovered", tmp_path / "c")
    rows = told.where("id is null").collect()
    assert [(r.site, r.state_before, r.state_after) for r in rows] == [("silent", "OPEN", "HALF_OPEN")]
    assert rows[0].ts - START == timedelta(seconds=4 + 60)


def test_recovery_is_told_once_when_an_attempt_follows(spark, tmp_path):
    failing = [(n, "s", "step", START + timedelta(seconds=n), 1.0, False, "ValueError", "j") for n in range(5)]
    beat = [(40, "other", "step", START + timedelta(hours=1), 1.0, True, None, "j")]
    again = [(50, "s", "step", START + timedelta(hours=2), 1.0, True, None, "j")]
    stream = as_files(spark, str(tmp_path / "in"), failing, beat, again, far())
    told, _ = drained(spark, stateful.breaker_stream(stream, R.BreakerRules(), timers=True), "told_once", tmp_path / "c")
    assert told.where("id is null and site = 's'").count() == 1
    assert told.where("id = 50").first().woke


def test_breaker_forgets_after_its_time_to_live(spark, tmp_path):
    failing = [(n, "s", "step", START + timedelta(seconds=n), 1.0, False, "ValueError", "j") for n in range(4)]
    after = [(9, "s", "step", START + timedelta(hours=3), 1.0, False, "ValueError", "j")]
    stream = as_files(spark, str(tmp_path / "in"), failing, after, far())
    got, query = drained(spark, stateful.breaker_stream(stream, R.BreakerRules(), ttl_sec=3600), "forgetful", tmp_path / "a")
    row = got.where("id = 9").first()
    assert (row.state_before, row.state_after, row.failures) == ("CLOSED", "CLOSED", 1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, _ = drained(spark, stateful.breaker_stream(stream, R.BreakerRules()), "mindful", tmp_path / "b")
    assert got.where("id = 9").first().state_after == "OPEN"


def test_bucket_is_full_after_its_time_to_live(spark, tmp_path):
    first = [(n, "s", "step", START + timedelta(seconds=n), 1.0, True, None, "j") for n in range(3)]
    after = [(9, "s", "step", START + timedelta(hours=3), 1.0, True, None, "j")]
    stream = as_files(spark, str(tmp_path / "in"), first, after, far())
    slow = stream.withColumns({"limit_capacity": F.lit(3), "limit_rate": F.lit(1e-9)})
    got, _ = drained(spark, stateful.token_bucket_stream(slow, ttl_sec=3600), "full_again", tmp_path / "a")
    assert [round(r.tokens_after) for r in got.where("site = 's'").orderBy("id").collect()] == [2, 1, 0, 2]


def test_retry_plan_and_rate_streams(spark, busy, tmp_path):
    rows, parts = busy
    batch = R.retry_plan(spark.createDataFrame(rows, SCHEMA))
    stream = as_files(spark, str(tmp_path / "in"), *parts, far())
    got, _ = drained(spark, R.retry_plan(stream), "planned", tmp_path / "a")
    columns = ("id", "site", "job_id", "attempt", "eligible", "exhausted", "wait_sec", "next_attempt_at")
    assert rows_of(got.where("site <> 'far'"), *columns) == rows_of(batch, *columns)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rated, _ = drained(spark, retries.retry_rate_stream(R.retry_plan(stream), 300, 30), "rated", tmp_path / "b")
    want = A.rate(R.retries(batch), ("exception_type",), None, 300, 30)
    assert rows_of(rated, "exception_type", "t", "n", "rate") == rows_of(want, "exception_type", "t", "n", "rate")


def test_a_forgotten_job_starts_anew(spark, tmp_path):
    tries = [(n, "s", "step", START + timedelta(seconds=at), 1.0, False, KINDS[0], "j") for n, at in enumerate([0, 10, 4000, 4010])]
    stream = as_files(spark, str(tmp_path / "in"), tries[:2], tries[2:], far())
    got, _ = drained(spark, retries.retry_plan_stream(stream, ttl_sec=600), "anew", tmp_path / "a")
    assert [r.attempt for r in got.where("site = 's'").orderBy("id").collect()] == [1, 2, 1, 2]


def test_windows_are_built_from_cells(spark, busy, tmp_path):
    rows, parts = busy
    stream = as_files(spark, str(tmp_path / "in"), *parts, far())
    got, query = drained(spark, W.rate_stream(stream, ("site",), 1800, 30), "from_cells", tmp_path / "a")
    want = A.rate(spark.createDataFrame(rows, SCHEMA), ("site",), None, 1800, 30)
    assert rows_of(got.where("site <> 'far'"), "site", "t", "n") == rows_of(want, "site", "t", "n")
    # rows are counted into cells before they are copied into 60 windows each
    first = [p for p in query.recentProgress if p["numInputRows"]][0]["stateOperators"]
    assert sorted(op["numRowsUpdated"] for op in first)[0] <= 175


def test_late_rows_are_kept(spark, tmp_path):
    rows = attempts_at(range(0, 40_000, 100), ["a", "b"])
    held = [r for r in rows[:100] if r[0] % 3 == 0]
    parts = [[r for r in rows[:200] if r not in held], rows[200:], held]
    log = as_files(spark, str(tmp_path / "in"), *parts)
    folder = str(tmp_path / "out")
    late.split_late(log, folder).awaitTermination(300)
    kept = late.late_rows(spark, folder)
    assert sorted(r.id for r in kept.collect()) == sorted(r[0] for r in held)
    counts = {r.site: r.late for r in late.late_counts(kept, "site").collect()}
    assert counts == {s: sum(r[1] == s for r in held) for s in {r[1] for r in held}}
    on_time = spark.read.parquet(f"{folder}/on_time/*")
    assert on_time.count() + kept.count() == len(rows)
    # as many as the engine drops from a stateful operator
    counted = log.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 second"), "id").count()
    _, query = drained(spark, counted, "engine_drops", tmp_path / "engine")
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == len(held)


def test_late_rows_go_to_a_sink_of_ones_own(spark, tmp_path):
    seen = []
    log = as_files(spark, str(tmp_path / "in"), attempts_at([0, 10], ["a"]), attempts_at([5000], ["a"]), attempts_at([20], ["a"]))
    late.split_late(log, str(tmp_path / "out"), on_time=lambda df, n: seen.append((n, df.count()))).awaitTermination(300)
    assert sorted(seen) == [(0, 2), (1, 1), (2, 0)]
    assert late.late_rows(spark, str(tmp_path / "out")).count() == 1


def test_retry_streams_keep_many_jobs_in_few_state_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retries, "BUCKETS", 8)
    rows = [(n, "s", "step", START + timedelta(seconds=n // 2), 1.0, n % 3 == 0, "TimeoutException", f"j{n % 2000}") for n in range(6000)]
    stream = as_files(spark, str(tmp_path / "in"), rows[:3000], rows[3000:], far())
    got, query = drained(spark, R.retry_plan(stream), "many_jobs", tmp_path / "a")
    want = R.retry_plan(spark.createDataFrame(rows, SCHEMA))
    columns = ("id", "job_id", "attempt", "eligible", "exhausted", "wait_sec", "next_attempt_at")
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 500


def test_a_busy_site_is_folded_from_packed_rows_in_slices(spark, busy, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "ROWS_AT_A_TIME", 50)
    rows, parts = busy
    stream = as_files(spark, str(tmp_path / "in"), *parts, far())
    got, query = drained(spark, R.breaker(stream, recovery_sec=30), "in_slices", tmp_path / "a")
    want = R.breaker(spark.createDataFrame(rows, SCHEMA), recovery_sec=30)
    columns = ("site", "id", "state_before", "state_after", "failures", "successes", "last_failure_us")
    assert rows_of(got.where("site <> 'far'"), *columns) == rows_of(want, *columns)
    # a buffered row is no state row of its own
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 100


def test_streams_keep_their_state_in_one_partition_per_task_slot_at_most(spark, tmp_path, monkeypatch):
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(stream_queries, "shared_dir", lambda _: str(tmp_path))
    rows = as_files(spark, str(tmp_path / "log"), attempts_at(range(0, 600, 60), ["a"]))
    spark.conf.set(name, 32)
    try:
        stream_queries._drained(W.ratio_stream(rows, ("site",), F.col("ok"), 60, 30).select("site", "t"))
        assert spark.conf.get(name) == "32"
    finally:
        spark.conf.set(name, before)
    kept = [folder for folder in tmp_path.glob("stream-*/checkpoint/state/0/*") if folder.name.isdigit()]
    assert len(kept) == spark.sparkContext.defaultParallelism
