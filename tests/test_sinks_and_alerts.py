"""Sinks, exposition numbers, quantiles, holds, grouping and other small rules."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from gleanery import functions
from gleanery.operators import alerts as A, loadlog as L, metrics as M, serialization as J
from gleanery.sources import sinks


def test_stream_json_lines(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    sinks.stream_json_lines(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.schema("id long").json(str(tmp_path / "out")).count() == 5


def test_summary_and_metric_sinks(spark, tmp_path):
    requests = spark.createDataFrame(
        [(n, datetime(2024, 1, 1, 0, 0, n), "GET /x", 200, 1.5 * n, 10, "", n == 3) for n in range(4)],
        "id long, ts timestamp, name string, status int, response_ms double, length long, body string, failed boolean",
    )
    summary = L.summary(requests)
    sinks.write_summary(summary, str(tmp_path / "s"))
    got = json.loads(spark.read.text(str(tmp_path / "s")).first()[0])
    assert got == {"total_requests": 4, "total_failures": 1, "avg_response_time": 2.25, "max_response_time": 4.5, "requests_per_second": 0.4, "failure_rate": 0.25}
    lines = M.counter_lines(spark.createDataFrame([('a"\n\\', 3)], "site string, value long"), "x_total", ("site",))
    sinks.write_metric_lines(lines, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == 'selenium_x_total{site="a\\"\\n\\\\"} 3.0'


def test_exposition_numbers(spark):
    values = [0.0, 1.0, 999999.5, 1234567.0, 1000000.0, 12345678.25, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    got = [r[0] for r in df.select(M._number(F.col("value"))).collect()]
    assert got == ["0.0", "1.0", "999999.5", "1.234567e+06", "1e+06", "1.234567825e+07", "0.1"]


def test_quantile_rules(spark):
    edges = (1.0, 5.0, 10.0)

    def q(*counts, total, phi=0.95):
        cols = [F.lit(c) for c in counts]
        return spark.range(1).select(A.quantile(cols, F.lit(total), edges, phi)).first()[0]

    assert q(0, 0, 0, total=0) is None
    assert q(10, 10, 10, total=10, phi=0.5) == 0.5
    assert q(0, 10, 10, total=10, phi=0.5) == 3.0
    assert q(0, 0, 0, total=10) == 10.0
    assert q(2, 4, 4, total=4, phi=0.75) == 3.0


def test_hold_resets_on_gap(spark):
    times = [30, 60, 90, 120, 180, 210, 240]
    df = spark.createDataFrame([("a", t, t != 210, 1.0) for t in times], "site string, t long, active boolean, value double")
    got = sorted(tuple(r)[1:5] for r in A.hold(df, ("site",), 60).collect())
    assert got == [(30, 90, 150, "fired"), (180, None, 210, "pending"), (240, None, 270, "pending")]


def test_grouping_schedule(spark):
    rows = [("A", "j", 0, 20_000), ("A", "j", 100, 1_000), ("A", "j", 40_000, 40_100), ("A", "j", None, 5)]
    df = spark.createDataFrame(rows, "alertname string, job string, firing_at long, resolved_at long")
    got = sorted(tuple(r)[2:] for r in A.group(df).collect())
    assert got[0] == (30, 1, 0, "changed")
    assert got[1] == (330, 2, 0, "changed")
    assert (1230, 1, 1, "changed") in got
    assert (1230 + 14_400, 1, 0, "repeat") in got
    assert (20_130, 0, 1, "resolved") in got
    assert got[-2:] == [(40_030, 1, 0, "changed"), (40_330, 0, 1, "resolved")]


def test_annotations(spark):
    rows = [("HighScrapeFailureRate", "s", 2 / 3), ("HighMemoryUsage", "s", 1.5e9), ("SlowScrapeLatency", "s", 150.0), ("TooManyActiveSessions", "s", 21.0)]
    df = spark.createDataFrame(rows, "alertname string, site string, value double")
    got = {r["alertname"]: r["description"] for r in A.annotate(df).collect()}
    assert got == {
        "HighScrapeFailureRate": "Failure rate is 66.67% for site s",
        "HighMemoryUsage": "Memory usage is 1.5GB",
        "SlowScrapeLatency": "95th percentile scrape duration is 150s for site s",
        "TooManyActiveSessions": "21 active sessions detected",
    }


def test_counter_reset(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0, s), v) for s, v in [(0, 5.0), (10, 8.0), (40, 2.0), (50, 4.0)]]
    df = spark.createDataFrame(rows, "site string, ts timestamp, value double")
    total = A.counter_rate(df, ("site",)).agg(F.max("increase")).first()[0]
    assert total == 7.0


def test_active_sessions(spark):
    rows = [(0, 10), (5, 20), (10, 30), (50_000_000, None)]
    df = spark.createDataFrame(rows, "start_us long, end_us long")
    got = sorted((r["at_us"], r["active"]) for r in M.active(df).collect())
    assert got == [(0, 1), (5, 2), (10, 2), (20, 1), (30, 0), (50_000_000, 1)]
    assert tuple(M.peak(M.active(df)).first()) == (2, 5)


def test_json_shapes(spark):
    df = spark.sql(
        "select timestamp'2024-01-02 03:04:05' as a, timestamp'2024-01-02 03:04:05.25' as b, date'2024-01-02' as c,"
        " map(1, map('x', array(1, 2))) as m, true as t, cast(null as string) as n"
    )
    assert json.loads(J.lines(J.to_jsonable(df)).first()[0]) == {
        "a": "2024-01-02T03:04:05", "b": "2024-01-02T03:04:05.250000", "c": "2024-01-02", "m": {"1": {"x": [1, 2]}}, "t": True,
    }
    pretty = df.select(J.dumps(F.struct("a", "t"), pretty=True)).first()[0]
    assert pretty.split("\n")[2] == '  "t": true'


def test_sql_functions(spark):
    functions.register_sql(spark)
    row = spark.sql(
        "select backoff_wait(1, 0.5, 0.5, 4.0), sanitize_context('é/x'), safe_context('é/x'), make_absolute_url('a', 'http://b/'), is_absolute_url('HTTP://x')"
    ).first()
    assert tuple(row) == (1.0, "__x", "é_x", "http://b/a", False)
    found = spark.sql("select xpath_string(repair_html('<p>a<p>b <i>c'), '//p[2]')").first()[0]
    assert found == "b c"


def test_array_of_many_records_in_order(spark, tmp_path):
    df = spark.range(5_000).select((4_999 - F.col("id")).alias("n"), F.lit("x").alias("s")).repartition(7)
    sinks.write_json_array(df, str(tmp_path / "a"), order=("n",))
    text = "".join(open(p).read() for p in sorted((tmp_path / "a").glob("part-*")))
    assert [r["n"] for r in json.loads(text)] == list(range(5_000))
    sinks.write_json_array(df.limit(0), str(tmp_path / "b"))
    assert json.loads("".join(open(p).read() for p in sorted((tmp_path / "b").glob("part-*")))) == []


def test_nested_values_are_adapted(spark):
    df = spark.sql(
        "select timestamp'2024-01-01 00:00:00' t, array(struct(timestamp'2024-01-01 00:00:00.5' as u, map(date'2024-01-02', timestamp'2024-01-03 00:00:00') as m)) a,"
        " cast(null as struct<d:date>) s, map(1, map(2, date'2024-01-04')) k"
    )
    got = J.to_jsonable(df).select(F.to_json(F.struct("*"))).first()[0]
    assert json.loads(got) == {
        "t": "2024-01-01T00:00:00", "a": [{"u": "2024-01-01T00:00:00.500000", "m": {"2024-01-02": "2024-01-03T00:00:00"}}], "k": {"1": {"2": "2024-01-04"}},
    }


def test_holds_and_grids_cross_days(spark):
    day = 86_400
    gauge = spark.createDataFrame([("j", day - 100, 5.0), ("j", 3 * day + 7, 1.0), ("k", 50, 2.0)], "job string, at_sec long, value double")
    grid = A.on_grid(gauge, ("job",), 15)
    got = {(r.job, r.t): r.value for r in grid.collect()}
    want = {("j", t): 5.0 for t in range(-(-(day - 100) // 15) * 15, 3 * day + 15, 15)} | {("j", 3 * day + 15): 1.0, ("k", 60): 2.0}
    assert got == want
    spans = A.hold(grid.withColumn("active", F.col("value") > 4), ("job",), 60, 15).collect()
    start = -(-(day - 100) // 15) * 15
    assert [(r.pending_at, r.firing_at, r.resolved_at) for r in spans] == [(start, start + 60, 3 * day + 15)]


def test_running_count_of_open_intervals(spark):
    day = 86_400_000_000
    df = spark.createDataFrame([(5, day + 3), (day - 1, None), (day + 2, 5 * day)], "start_us long, end_us long")
    got = [tuple(r) for r in M.active(df).orderBy("at_us").collect()]
    assert got == [(5, 1), (day - 1, 2), (day + 2, 3), (day + 3, 2), (5 * day, 1)]
