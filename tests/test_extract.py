"""Extraction on hand-written pages: golden records, failures, frames, visibility."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import errors, extract as X, validation
from gleanery.sources import pages as page_source, sinks, specs as S

QUOTES = [
    ("“The world as we have created it is a process of our thinking. It cannot be changed without changing our thinking.”", "Albert Einstein", ["change", "deep-thoughts"]),
    ("“It is our choices, Harry, that show what we truly are, far more than our abilities.”", "J.K. Rowling", ["abilities", "choices"]),
    ("“There are only two ways to live your life. One is as though nothing is a miracle. The other is as though everything is a miracle.”", "Albert Einstein", ["inspirational", "life"]),
]


def _page():
    blocks = "".join(
        f'<div class="quote"><span class="text">{text}</span><span>by <small class="author">{author}</small></span>'
        f'<div class="tags">Tags: {"".join(f"<a class=tag href=/tag/{t}>{t}</a>" for t in tags)}</div></div>'
        for text, author, tags in QUOTES
    )
    return f"<!DOCTYPE html><html><head><title>Quotes</title></head><body><div class=row>{blocks}</div></body></html>"


def _spec(spark, *sites):
    document = json.dumps({"sites": list(sites)})
    return S.sites_of(S.parse_documents(spark.createDataFrame([("d", document)], "source string, value string")))


def _pages(spark, *rows):
    return spark.createDataFrame([(n, url, html) for n, (url, html) in enumerate(rows)], page_source.PAGE_SCHEMA)


QUOTE_SITE = {
    "name": "quotes_to_scrape",
    "base_url": "http://quotes.example/",
    "steps": [
        {
            "name": f"extract_quote_{n}",
            "goto_url": "/",
            "wait_xpath": "//div[@class='quote']",
            "fields": [
                {"name": "quote_text", "xpath": f"//div[@class='quote'][{n}]//span[@class='text']"},
                {"name": "author", "xpath": f"//div[@class='quote'][{n}]//small[@class='author']"},
                {"name": "tags", "xpath": f"//div[@class='quote'][{n}]//a[@class='tag']"},
            ],
        }
        for n in (1, 2, 3)
    ],
}


def test_golden_record(spark, tmp_path):
    found = X.records(X.outcomes_by_target(_pages(spark, ("http://quotes.example/", _page())), _spec(spark, QUOTE_SITE)))
    golden = {
        "site": "quotes_to_scrape",
        "data": {
            f"extract_quote_{n + 1}": {"quote_text": text, "author": author, "tags": tags[0]}
            for n, (text, author, tags) in enumerate(QUOTES)
        },
    }
    line = found.select(F.to_json(F.struct("*"))).first()[0]
    assert line == json.dumps(golden, ensure_ascii=False, separators=(",", ":"))
    sinks.write_json_lines(found, str(tmp_path / "lines"))
    sinks.write_json_array(found, str(tmp_path / "array"))
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first()[0]) == golden
    assert json.loads("".join(open(p).read() for p in sorted((tmp_path / "array").glob("part-*")))) == [golden]


def _one(spark, html, steps, **site):
    spec = _spec(spark, {"name": "s", "base_url": "http://a.example/", "steps": steps, **site})
    return X.outcomes_by_target(_pages(spark, ("http://a.example/", html)), spec)


def test_first_match_decides_visibility(spark):
    html = "<body><p class=x style='display: none'>no</p><p class=x>yes</p><p class=y>one</p>"
    step = [{"name": "a", "fields": [{"name": "f", "xpath": "//p[@class='x']"}]}]
    assert X.records(_one(spark, html, step)).first()["error"]["type"] == "ExtractionError"
    step = [{"name": "a", "fields": [{"name": "f", "xpath": "//p[@class='y']"}]}]
    assert X.records(_one(spark, html, step)).first()["data"] == {"a": {"f": "one"}}


def test_attributes(spark):
    html = "<body><a id=l href='../x?y' data-k=' v ' checked>t <b>u</b></a><i id=e></i>"
    names = {"href": "http://a.example/x?y", "data-k": " v ", "checked": "true", "textContent": "t u", "missing": "", "bad name": ""}
    fields = [{"name": n, "xpath": "//a[@id='l']", "attribute": n} for n in names]
    assert X.records(_one(spark, html, [{"name": "a", "fields": fields}])).first()["data"]["a"] == names
    empty = [{"name": "a", "fields": [{"name": "f", "xpath": "//i"}]}, {"name": "none"}]
    assert X.records(_one(spark, html, empty)).first()["data"] == {"a": {"f": ""}, "none": {}}


@pytest.mark.parametrize(
    ("steps", "kind", "message"),
    [
        ([{"name": "a", "wait_xpath": "//zz"}], "ElementNotFoundError", "Element not visible: //zz (URL: http://a.example/)"),
        ([{"name": "a", "wait_url_contains": "zz"}], "TimeoutError", "URL does not contain 'zz' (current: http://a.example/)"),
        ([{"name": "a", "goto_url": "/other"}], "NavigationError", "Page not captured: http://a.example/other"),
        ([{"name": "a", "fields": [{"name": "f", "xpath": "//a/@href"}]}], "ExtractionError", "Field 'f' extraction failed"),
        ([{"name": "a", "fields": [{"name": "f", "xpath": "//a["}]}], "ExtractionError", "Field 'f' extraction failed"),
        ([{"name": "a", "frames": [{"css": "#nope"}]}], "FrameError", "Failed to switch to frame: css=#nope"),
        ([{"name": "a", "click_xpath": "//a"}], "UnsupportedAction", "Step 'a' needs click_xpath, which a captured page cannot answer"),
    ],
)
def test_failures(spark, steps, kind, message):
    error = X.records(_one(spark, "<body><a href=q>k</a>", steps, wait_timeout_sec=7)).first()["error"]
    assert (error["type"], error["message"]) == (kind, message)
    assert error["timeout_sec"] == (7 if kind == "TimeoutError" else None)


def test_url_and_blank_failures(spark):
    spec = _spec(
        spark,
        {"name": "blank", "steps": [{"name": "a", "wait_xpath": "//p"}]},
        {"name": "base", "steps": [{"name": "a", "goto_url": "/x"}]},
        {"name": "ftp", "base_url": "ftp://x", "steps": [{"name": "a"}]},
    )
    rows = {r["site"]: r["error"] for r in X.records(X.outcomes_by_target(_pages(spark, ("http://a/", "")), spec)).collect()}
    assert rows["blank"]["message"] == "Element not visible: //p (URL: about:blank)"
    assert rows["base"]["message"] == "Cannot make absolute URL: relative URL '/x' but invalid base_url ''"
    assert rows["ftp"]["message"] == "URL scheme must be http or https, got: ftp"


def test_stream_mode_keeps_earlier_steps(spark):
    steps = [{"name": "a", "fields": [{"name": "f", "xpath": "//p"}]}, {"name": "b", "wait_xpath": "//q"}, {"name": "c"}]
    found = _one(spark, "<p>x", steps)
    assert [r["step"] for r in X.results(found, "stream").collect()] == ["a"]
    assert [(r["step"], r["status"]) for r in X.steps(found).where("reached and not is_base").orderBy("step_ord").collect()] == [
        ("a", "success"), ("b", "failure"),
    ]


def test_frames_and_exit(spark):
    top = "<body><iframe class='x' srcdoc='&lt;h2&gt;in&lt;/h2&gt;'></iframe><iframe id=f2 src='/inner'></iframe><h1>top</h1>"
    inner = "<body><h4>four</h4><iframe name=n2 srcdoc='<h3>deep</h3>'></iframe>"
    spec = _spec(spark, {"name": "s", "base_url": "http://f.example/", "steps": [
        {"name": "a", "frames": [{"css": "iframe.x"}], "fields": [{"name": "h", "xpath": "//h2"}]},
        {"name": "b", "frames": [{"index": 1}, {"name": "n2"}], "frame_exit": "parent", "fields": [{"name": "h", "xpath": "//h3"}]},
        {"name": "c", "fields": [{"name": "h", "xpath": "//h4"}]},
        {"name": "d", "goto_url": "/", "fields": [{"name": "h", "xpath": "//h1"}]}]})
    pages = _pages(spark, ("http://f.example/", top), ("http://f.example/inner", inner))
    assert X.records(X.outcomes_by_target(pages, spec)).first()["data"] == {
        "a": {"h": "in"}, "b": {"h": "deep"}, "c": {"h": "four"}, "d": {"h": "top"},
    }


def test_pages_are_not_read_for_steps_without_frames_where_there_are_none(spark):
    top = "<body><iframe srcdoc='<h3>in</h3>'></iframe>"
    steps = [{"name": n, "frames": [{"index": 0}], "frame_exit": "parent", "fields": [{"name": "h", "xpath": "//h3"}]} for n in "ab"]
    found = X.outcomes_by_page(_pages(spark, ("http://f.example/", top)), _spec(spark, {"name": "s", "base_url": "http://f.example/", "steps": steps}))
    # what is left after the frames were entered: one reading of their documents
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert X.records(found).first()["data"] == {"a": {"h": "in"}, "b": {"h": "in"}}


def test_newest_capture_wins(spark):
    rows = [(1, "http://a.example/", "<p>old", "2024-01-01"), (2, "HTTP://a.example/", "<p>new", "2024-01-03"), (3, "http://a.example/", "<p>mid", "2024-01-02")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at string").withColumn("fetched_at", F.col("at").cast("timestamp")).drop("at")
    spec = _spec(spark, {"name": "s", "base_url": "http://a.example/", "steps": [{"name": "a", "fields": [{"name": "f", "xpath": "//p"}]}]})
    assert X.records(X.outcomes_by_target(pages, spec)).first()["data"] == {"a": {"f": "new"}}


def test_many_fields_span_several_packs(spark):
    html = "".join(f"<p id=p{n}>v{n}</p>" for n in range(40))
    fields = [{"name": f"f{n}", "xpath": f"//p[@id='p{n}' or (@id='zz' and position()=3)]"} for n in range(40)]
    data = X.records(_one(spark, html, [{"name": "a", "fields": fields}])).first()["data"]["a"]
    assert data == {f"f{n}": f"v{n}" for n in range(40)}


def test_page_mode_has_no_shuffle_after_the_scan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    spec = _spec(spark, {"name": "s", "base_url": "", "steps": [{"name": "a", "fields": [{"name": "f", "xpath": "//h1"}]}]})
    found = X.records(X.outcomes_by_page(pages, spec, page_site=F.lit("s")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in above and plan.count("ArrowEvalPython") == 1
    assert found.where("data['a']['f'] <> ''").count() == 250


def test_checks(spark):
    pages = _pages(spark, ("http://a/", "<title>t</title><button id=b disabled>x</button><button id=c>y</button>"))
    rows = {r["name"]: tuple(r)[2:] for r in X.checks(pages, [("t", "//title"), ("b", "//button[@id='b']"), ("c", "//button[@id='c']"), ("n", "//video")]).collect()}
    assert rows == {"t": (True, False, False), "b": (True, True, False), "c": (True, True, True), "n": (False, False, False)}


def test_artifacts(spark):
    steps = [{"name": "é 1", "fields": [{"name": "f/1", "xpath": "//zz"}]}]
    failed = errors.error_records(_one(spark, "<p>", steps)).withColumn("page_id", F.lit(0))
    manifest = errors.artifacts(failed, F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("http://a.example/"))
    rows = {r["context"]: (r["html"], r["linked"]) for r in manifest.collect()}
    assert rows == {
        "s_é 1_f/1": ("s_é_1_f_1_20240102_030405.html", False),
        "s_é 1": ("s_é_1_20240102_030405.html", True),
    }
    assert errors.artifacts(failed, F.current_timestamp(), F.lit("x"), F.lit(False)).count() == 0
    linked = errors.attach_artifact(failed, manifest, ["site"]).select("error.artifacts.html").collect()
    assert [r[0] for r in linked] == ["s_é_1_20240102_030405.html"]


def test_validation_rules(spark):
    ok = {"name": "ok", "base_url": "https://a.example", "steps": [{"name": "s", "fields": [{"name": "f", "xpath": "//a"}]}]}
    bad = {
        "name": " ", "base_url": "nope", "wait_timeout_sec": "3.5", "page_load_timeout_sec": 0.5, "artifact_dir": "a\\b",
        "login": {"url": "x", "username_xpath": "//a"},
        "steps": [
            {"name": "s", "goto_url": "rel", "click_xpath": "//a[", "frame_exit": "up", "frames": [{}, {"index": -1}],
             "fields": [{"name": "", "xpath": "//a"}, {"name": "d", "xpath": ""}, {"name": "d", "xpath": "//b"}, {"xpath": "//c"}]},
            {"name": "s"}, {"goto_url": "/fine"},
        ],
    }
    spec = _spec(spark, ok, bad)
    found = validation.violations(spec)
    rules = {r["rule"] for r in found.collect()}
    assert rules == {f"V{n}" for n in (1, 2, 4, 5, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18)}
    assert [r["spec_id"] for r in validation.clean(spec, found).collect()] == ["d#000000000"]
    first = validation.first_violations(found).collect()
    assert [(r["rule"], r["detail"]) for r in first] == [("V14", "nope")]


def test_long_paths_and_many_selector_lists(spark, monkeypatch):
    monkeypatch.setattr(X, "TEMPLATES_PER_PASS", 2)
    long = "//p[" + " or ".join(f"@id='p{n}'" for n in range(12)) + "]"
    sites = [
        {"name": f"s{n}", "base_url": "http://a.example/", "steps": [{"name": "a", "fields": [
            {"name": "f", "xpath": f"//p[@id='p{n}']"}, {"name": "g", "xpath": long}, {"name": "h", "xpath": long, "attribute": "id"}]}]}
        for n in range(5)
    ]
    pages = _pages(spark, ("http://a.example/", "".join(f"<p id=p{n}>v{n}</p>" for n in range(5))))
    spec = _spec(spark, *sites)
    want = {f"s{n}": {"a": {"f": f"v{n}", "g": "v0", "h": "p0"}} for n in range(5)}
    assert {r["site"]: r["data"] for r in X.records(X.outcomes_by_target(pages, spec)).collect()} == want
    assert {r["site"]: r["data"] for r in X.records(X.outcomes_by_page(pages, spec)).collect()} == want


def test_text_content_holds_script_text(spark):
    html = '<body><div>a<script type="application/ld+json">{"k": "<v>"}</script>b</div></body>'
    steps = [{"name": "s", "fields": [
        {"name": "all", "xpath": "//div", "attribute": "textContent"}, {"name": "seen", "xpath": "//div"},
        {"name": "href", "xpath": "//div", "attribute": "class"}, {"name": "inner", "xpath": "//div", "attribute": "innerText"},
    ]}]
    site = {"name": "a", "base_url": "http://a.example/", "steps": steps}
    found = X.results(X.outcomes_by_target(_pages(spark, ("http://a.example/", html)), _spec(spark, site))).first()
    assert dict(found["data"]["s"].items()) == {"all": 'a{"k": "<v>"}b', "seen": "ab", "href": "", "inner": "ab"}


def test_frames_on_a_blank_page_fail(spark):
    site = {"name": "a", "steps": [{"name": "s", "frames": [{"css": "iframe"}], "fields": []}]}
    found = X.records(X.outcomes_by_target(_pages(spark, ("http://z.example/", "")), _spec(spark, site))).first()
    assert found["data"] is None and found["error"]["type"] == "FrameError"


def test_repeated_names_are_errors_of_their_site(spark):
    field = {"name": "f", "xpath": "//p"}
    twice = {"name": "a", "base_url": "http://a.example/", "steps": [{"name": "s", "fields": [field]}, {"name": "s", "fields": [field]}]}
    fields = {"name": "b", "base_url": "http://a.example/", "steps": [{"name": "s", "fields": [field, field]}]}
    good = {"name": "c", "base_url": "http://a.example/", "steps": [{"name": "s", "fields": [field]}]}
    found = X.outcomes_by_target(_pages(spark, ("http://a.example/", "<p>x")), _spec(spark, twice, fields, good))
    got = {r["site"]: (r["data"], r["error"] and r["error"]["type"]) for r in X.records(found).collect()}
    assert got == {"a": (None, "ValueError"), "b": (None, "ValueError"), "c": ({"s": {"f": "x"}}, None)}
    assert [r["site"] for r in X.results(found, "stream").collect()] == ["c"]


def test_newest_of_several_captures_of_one_page(spark):
    rows = [(1, "http://a.example/", "<p>old", "2024-01-01"), (1, "http://a.example/", "<p>new", "2024-02-01"), (2, "http://a.example/", "<p>older", "2023-01-01")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string").withColumn("fetched_at", F.to_timestamp("at")).drop("at")
    assert [r["html"] for r in page_source.latest(pages).collect()] == ["<p>new"]
    site = {"name": "a", "base_url": "http://a.example/", "steps": [{"name": "s", "fields": [{"name": "f", "xpath": "//p"}]}]}
    found = X.records(X.outcomes_by_target(pages, _spec(spark, site))).collect()
    assert [r["data"]["s"]["f"] for r in found] == ["new"]


def test_clean_drops_every_site_of_a_shared_name(spark):
    sites = [{"name": name, "base_url": "http://a.example/", "steps": [{"name": "s", "fields": [{"name": "f", "xpath": "//p"}]}]} for name in ("dup", "dup", "dup", "own")]
    assert [r["name"] for r in validation.clean(_spec(spark, *sites)).collect()] == ["own"]


def test_long_paths_are_valid(spark):
    path = "//a[" + " or ".join(f"@k{n}='1'" for n in range(150)) + "]"
    site = {"name": "a", "base_url": "http://a.example/", "steps": [{"name": "s", "fields": [{"name": "f", "xpath": path}]}]}
    assert validation.violations(_spec(spark, site)).where("rule = 'V15'").count() == 0
    found = X.records(X.outcomes_by_target(_pages(spark, ("http://a.example/", "<a k149=1>x</a>")), _spec(spark, site))).first()
    assert found["data"]["s"]["f"] == "x"
