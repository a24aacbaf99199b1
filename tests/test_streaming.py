"""Streams give the rows of the batch operators."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import alerts as A, extract as X, reliability as R
from gleanery.sources import attempts as attempts_source, specs as S
from gleanery.streaming import stateful, windows as W

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def attempt_files(spark, tmp_path_factory):
    """Four files in shuffled order inside one watermark delay, then a far row that closes the stream."""
    import random

    rng = random.Random(11)
    rows, at = [], 0
    for n in range(600):
        at += rng.choice([0, 1, 2, 9, 40])
        rows.append((n, rng.choice(["a", "a", "b"]), "step", START + timedelta(seconds=at), float(at % 7), rng.random() < 0.45, None))
    far = START + timedelta(days=30)
    sentinels = [(10_000 + n, "z", "step", far, 1.0, True, None) for n in range(1)]
    folder = str(tmp_path_factory.mktemp("attempts"))
    for part in range(0, 600, 150):
        mixed = rows[part : part + 150]
        rng.shuffle(mixed)
        spark.createDataFrame(mixed, attempts_source.ATTEMPT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame(sentinels, attempts_source.ATTEMPT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, attempts_source.ATTEMPT_SCHEMA)


def _drain(spark, df, name, tmp):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return spark.table(name)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_token_bucket_stream(spark, attempt_files, tmp_path):
    folder, batch = attempt_files
    stream = attempts_source.read_attempt_stream(spark, folder, max_files_per_trigger=1)
    got = _drain(spark, R.token_bucket(stream, 3, 0.1), "bucket", tmp_path).where("id < 10000")
    want = R.token_bucket(batch, 3, 0.1)
    cols = ("id", "site", "admitted", "tokens_after")
    assert _rows(got, *cols) == _rows(want, *cols)


def test_breaker_stream(spark, attempt_files, tmp_path):
    folder, batch = attempt_files
    stream = attempts_source.read_attempt_stream(spark, folder, max_files_per_trigger=1)
    got = _drain(spark, R.breaker(stream), "breaker", tmp_path).where("id < 10000")
    want = R.breaker(batch)
    cols = ("id", "site", "state_before", "permitted", "state_after", "failures", "woke")
    assert _rows(got, *cols) == _rows(want, *cols)


def test_breaker_stream_recovery_rows(spark, attempt_files, tmp_path):
    folder, batch = attempt_files
    stream = attempts_source.read_attempt_stream(spark, folder, max_files_per_trigger=1)
    got = _drain(spark, stateful.breaker_stream(stream, R.BreakerRules(), emit_recovery=True), "recovery", tmp_path)
    assert got.where("id is null").count() == R.breaker(batch).where("woke").count() > 0


def test_windowed_streams_and_hold(spark, attempt_files, tmp_path):
    folder, batch = attempt_files
    stream = attempts_source.read_attempt_stream(spark, folder, max_files_per_trigger=1)
    labels = ("site",)
    got = _drain(spark, W.ratio_stream(stream, labels, ~F.col("ok")), "ratio", tmp_path / "a").where("site <> 'z'")
    want = A.ratio(batch, labels, ~F.col("ok"))
    assert _rows(got, "site", "t", "n", "hits") == _rows(want, "site", "t", "n", "hits")

    edges = (1.0, 3.0, 5.0)
    stream = attempts_source.read_attempt_stream(spark, folder, max_files_per_trigger=1)
    got = _drain(spark, W.quantile_stream(stream, labels, "duration_sec", edges), "p95", tmp_path / "b").where("site <> 'z'")
    want = A.quantile_windows(batch, labels, "duration_sec", edges)
    assert _rows(got, "site", "t", "n", "value") == _rows(want, "site", "t", "n", "value")

    stream = attempts_source.read_attempt_stream(spark, folder, max_files_per_trigger=1)
    held = W.alert_stream(W.ratio_stream(stream, labels, ~F.col("ok")), labels, "HighScrapeFailureRate", hold_sec=90)
    got = _drain(spark, held, "held", tmp_path / "c").where("site <> 'z'")
    want = A.evaluate(A.ratio(batch, labels, ~F.col("ok")), labels, "HighScrapeFailureRate", hold_sec=90)
    cols = ("site", "pending_at", "resolved_at", "outcome", "value")
    assert _rows(got, *cols) == _rows(want, *cols)
    assert {r["outcome"] for r in want.collect()} == {"fired", "pending"}


def test_extract_and_dedup_streams(spark, tmp_path):
    specs = {"sites": [{"name": "s", "base_url": "http://a.example/", "steps": [
        {"name": "one", "fields": [{"name": "h", "xpath": "//h1"}]},
        {"name": "two", "fields": [{"name": "p", "xpath": "//p"}]}]}]}
    spec = S.sites_of(S.parse_documents(spark.createDataFrame([("d", json.dumps(specs))], "source string, value string")))
    rows = [(n, f"http://a.example/{n % 7}", f"<h1>t{n}</h1>" + ("<p>x" if n % 2 else ""), START + timedelta(seconds=n)) for n in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, fetched_at timestamp")
    folder = str(tmp_path / "pages")
    pages.repartition(3).write.parquet(folder)
    source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = _drain(spark, W.extract_stream(source, spec), "extracted", tmp_path / "x")
    want = X.results(X.outcomes_by_page(pages, spec), "stream")
    flat = ["page_id", "step", F.to_json("data").alias("data")]
    assert _rows(got, *flat) == _rows(want, *flat)
    assert got.count() == 30
    source = spark.readStream.schema(pages.schema).parquet(folder)
    assert _drain(spark, W.dedup_stream(source, "fetched_at"), "unique_pages", tmp_path / "y").count() == 7
