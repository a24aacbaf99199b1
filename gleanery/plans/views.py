"""The shared test tables seen as specs, pages, attempts and requests.

Everything is derived by Spark from the given tables, so the work of every
registered query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.sources.pages import read_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def page_group() -> Column:
    """Every page belongs to one of three sites, named after its top-level domain."""
    return F.concat(F.lit("site_"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*\.([a-z]+)", 1))


_FIELD = "named_struct('name', '{n}', 'xpath', '{x}', 'attribute', {a})"
_NO_FRAMES = "cast(array() as array<struct<xpath:string,css:string,index:int,name:string>>)"


def _frame(kind: str, value: str) -> str:
    members = [
        f"'{name}', " + (f"'{value}'" if name == kind and name != "index" else value if name == kind else f"cast(null as {kind_type})")
        for name, kind_type in (("xpath", "string"), ("css", "string"), ("index", "int"), ("name", "string"))
    ]
    return f"named_struct({', '.join(members)})"


def _step(
    name: str,
    fields: list[tuple[str, str, str | None]],
    frames: list[tuple[str, str]] = (),
    **options: str,
) -> str:
    quoted = ", ".join(
        _FIELD.format(n=n, x=x.replace("'", "\\'"), a=f"'{a}'" if a else "cast(null as string)")
        for n, x, a in fields
    )
    option = {
        key: "'" + options[key].replace("'", "\\'") + "'" if key in options else "cast(null as string)"
        for key in ("goto_url", "click_xpath", "wait_xpath", "wait_url_contains", "execute_js", "frame_exit")
    }
    listed = f"array({quoted})" if fields else "cast(array() as array<struct<name:string,xpath:string,attribute:string>>)"
    entered = f"array({', '.join(_frame(*f) for f in frames)})" if frames else _NO_FRAMES
    return (
        f"named_struct('name', '{name}', 'goto_url', {option['goto_url']}, 'click_xpath', {option['click_xpath']},"
        f" 'wait_xpath', {option['wait_xpath']}, 'wait_url_contains', {option['wait_url_contains']},"
        f" 'execute_js', {option['execute_js']}, 'fields', {listed}, 'frames', {entered},"
        f" 'frame_exit', {option['frame_exit']})"
    )


PAGE_STEPS = {
    "site_com": [
        _step("head", [("h1", "//article/h1", None), ("ad", "//div[@class='ad']", None)], wait_xpath="//article"),
        _step("body", [("p1", "//article/p[1]", None), ("p2", "//article/p[2]", None)]),
    ],
    "site_net": [
        _step("nav", [("first", "(//nav//a)[1]", None), ("first_href", "(//nav//a)[1]", "href"),
                      ("last_href", "(//nav//a)[last()]", "href")]),
        _step("feed", [("footer", "//footer", None)], wait_url_contains="utm_source"),
    ],
    "site_org": [
        _step("top", [("h1", "//h1", None), ("charset", "//article/h1", "lang")]),
        _step("deep", [("third", "//article/p[3]", None)], wait_xpath="//article/p[3]"),
        _step("title", [("title", "//title", None)]),
    ],
}


H1_STEPS = {
    "site_com": [_step("head", [("h1", "//article/h1", None)])],
    "site_net": [_step("head", [("h1", "//article/h1", None)])],
    "site_org": [_step("head", [("h1", "//article/h1", None)])],
}
SCRIPT_STEPS = {
    name: [_step("raw", [("code", "//script", "textContent"), ("h1", "//h1", None)])] for name in ("site_com", "site_net", "site_org")
}


def host_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec per host that occurs among the pages."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    step = F.expr(f"array({H1_STEPS['site_com'][0]})")
    return table(spark, sf_dir, "pages").select(host.alias("spec_id")).distinct().select(
        "spec_id",
        F.col("spec_id").alias("name"),
        F.concat(F.lit("https://"), "spec_id").alias("base_url"),
        step.alias("steps"),
        F.lit(20).alias("wait_timeout_sec"),
        F.lit(30).alias("page_load_timeout_sec"),
    )


ACTION_STEPS = {
    "site_com": [_step("read", [("h1", "//h1", None)]), _step("press", [("h1", "//h1", None)], click_xpath="//a")],
    "site_net": [_step("run", [("h1", "//h1", None)], execute_js="return 1")],
    "site_org": [_step("read", [("h1", "//h1", None)])],
}

FRAME_STEPS = [
    _step("inline", [("h1", "//h1", None)], frames=[("css", "iframe.in")]),
    _step("linked", [("h1", "//h1", None)], frames=[("name", "outer"), ("index", "0")], frame_exit="parent"),
    _step("still", [("note", "//p[@class='note']", None)]),
    _step("none", [], frames=[("xpath", "//iframe[@id=\\'absent\\']")]),
]


def specs_of(spark: SparkSession, sf_dir: str, listed: dict[str, list[str]]) -> DataFrame:
    """One spec per group that occurs among the pages."""
    groups = table(spark, sf_dir, "pages").select(page_group().alias("name")).distinct()
    steps = F.expr(
        "case name "
        + " ".join(f"when '{name}' then array({', '.join(steps)})" for name, steps in listed.items())
        + " end"
    )
    return groups.select(
        F.col("name").alias("spec_id"),
        "name",
        F.lit("").alias("base_url"),
        steps.alias("steps"),
        F.lit(20).alias("wait_timeout_sec"),
        F.lit(30).alias("page_load_timeout_sec"),
    ).where(F.col("steps").isNotNull())


def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs_of(spark, sf_dir, PAGE_STEPS)


def framed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents per page: a frame set, the page it links to, and that page's own frame.

    The given page's html is what both the inline and the innermost linked frame show.
    """
    source = pages(spark, sf_dir)
    origin = F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0)
    escaped = F.replace(F.replace(F.col("html"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    number = F.col("page_id").cast("string")
    top = F.concat(
        F.lit('<html><body><iframe class="x in" srcdoc="'), escaped,
        F.lit('"></iframe><iframe name="outer" src="/middle/'), number, F.lit('?b=1&amp;a"></iframe></body></html>'),
    )
    middle = F.concat(
        F.lit('<body><p class="note">middle '), number, F.lit("</p><iframe srcdoc='"),
        F.replace(escaped, F.lit("'"), F.lit("&#39;")), F.lit("'></iframe>"),
    )
    documents = F.array(
        F.struct((F.col("page_id") * 2).alias("page_id"), F.concat(origin, F.lit("/top/"), number).alias("url"), top.alias("html")),
        F.struct(
            (F.col("page_id") * 2 + 1).alias("page_id"),
            F.concat(origin, F.lit("/middle/"), number, F.lit("?b=1&a=")).alias("url"),
            middle.alias("html"),
        ),
    )
    return source.select(F.inline(documents))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page captured three times, under differently written forms of its URL."""
    source = table(spark, sf_dir, "pages")
    forms = F.array(
        F.struct(F.lit(0).alias("n"), F.col("url").alias("u")),
        F.struct(F.lit(1).alias("n"), F.regexp_replace("url", "^http", "HTTP").alias("u")),
        F.struct(F.lit(2).alias("n"), F.concat(F.lit("  "), F.col("url"), F.lit("\t")).alias("u")),
    )
    return source.select("page_id", "html", F.inline(forms)).select(
        (F.col("page_id") * 3 + F.col("n")).alias("page_id"),
        F.col("u").alias("url"),
        "html",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7 + F.col("n") * 11, F.lit(13)) * 60).alias("fetched_at"),
    )


# --- attempts and requests ---------------------------------------------------------------

EXCEPTIONS = (
    "TimeoutException",
    "StaleElementReferenceException",
    "NoSuchElementException",
    "NoSuchFrameException",
    "ElementNotFoundError",
    "ValueError",
)


def attempts(spark: SparkSession, sf_dir: str, failing: tuple[str, ...] = ("error",)) -> DataFrame:
    """The event log as an attempt log: ten sites, the event type as step."""
    events = table(spark, sf_dir, "events")
    return attempts_of(events, failing)


def attempts_of(events: DataFrame, failing: tuple[str, ...] = ("error",)) -> DataFrame:
    ok = ~F.col("event_type").isin(*failing)
    kind = F.get(
        F.array(*[F.lit(name) for name in EXCEPTIONS]),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(len(EXCEPTIONS))),
    )
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("site_"), (F.col("user_id") % 10).cast("string")).alias("site"),
        F.col("event_type").alias("step"),
        ts.alias("ts"),
        F.col("value").alias("duration_sec"),
        ok.alias("ok"),
        F.when(~ok, kind).alias("exception_type"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(ts, "yyyyMMdd")).alias("job_id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a load-test log; status and body follow from the event."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", 500).when(k % 10 == 0, 404).otherwise(200)
    body = (
        F.when(k % 7 == 0, "not json")
        .when(F.col("event_type") == "view", F.format_string('{"status": "%s"}', F.when(k % 3 == 0, "ready").otherwise("healthy")))
        .when(F.col("event_type") == "click", F.format_string('{"active_jobs": %d}', k * 2))
        .when(F.col("event_type") == "signup", F.format_string('{"quality_score": 0.%02d}', k))
        .when(F.col("event_type") == "purchase", F.format_string('{"cpu_percent": %d, "memory_percent": %d}', k, F.lit(99) - k))
        .otherwise("")
    )
    name = (
        F.when(F.col("event_type") == "view", "GET /healthz")
        .when(F.col("event_type") == "click", "REAL /metrics")
        .when(F.col("event_type") == "signup", "POST /api/Scrape")
        .when(F.col("event_type") == "purchase", "GET /browser/resources")
        .otherwise("CIRCUIT_TEST /error")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        name.alias("name"),
        F.lit("GET").alias("method"),
        status.alias("status"),
        (F.col("value") * 100).alias("response_ms"),
        (k * 20).cast("long").alias("length"),
        body.alias("body"),
        (status >= 400).alias("failed"),
        F.col("event_type").alias("kind"),
    )


# --- specs derived from pages ------------------------------------------------------------

_FRAME_ROW = "named_struct('xpath', {x}, 'css', {c}, 'index', {i}, 'name', cast(null as string))"
_NS, _NI = "cast(null as string)", "cast(null as int)"
_DERIVED_STEP = f"""
named_struct(
  'n', page_id,
  'name', case when page_id % 29 = 0 then '  ' when page_id % 5 = 4 and page_id % 3 = 0 then concat('step_', page_id - 1)
    else concat('step_', page_id) end,
  'goto_url', case when page_id % 23 = 1 then 'no-slash'
    when page_id % 3 = 1 then regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) else url end,
  'click_xpath', {_NS},
  'wait_xpath', case when page_id % 37 = 2 then '//a[' when page_id % 2 = 0 then '//article' end,
  'wait_url_contains', {_NS},
  'execute_js', {_NS},
  'fields', array(
    named_struct('name', 'h1', 'xpath', if(page_id % 41 = 3, '   ', '//h1'), 'attribute', {_NS}),
    named_struct('name', case when page_id % 19 = 5 then 'h1' when page_id % 43 = 6 then '' else 'ad' end,
      'xpath', if(page_id % 17 = 7, '//p[[', '//div[@class="ad"]'), 'attribute', {_NS})),
  'frames', case
    when page_id % 13 = 8 then array({_FRAME_ROW.format(x="'//iframe'", c="'iframe'", i=_NI)})
    when page_id % 11 = 9 then array({_FRAME_ROW.format(x=_NS, c=_NS, i="-1")})
    when page_id % 7 = 3 then array({_FRAME_ROW.format(x=_NS, c="'div:hover > iframe'", i=_NI)})
    when page_id % 10 = 0 then array({_FRAME_ROW.format(x=_NS, c=_NS, i="0")})
    else {_NO_FRAMES} end,
  'frame_exit', case when page_id % 31 = 10 then 'sideways' when page_id % 6 = 0 then 'parent' end)
"""
_DERIVED_LOGIN = f"""
case when g % 6 = 0 then named_struct(
  'url', if(g % 12 = 0, 'nope', 'http://login.example/x'), 'username_xpath', '//u', 'password_xpath', '//p',
  'submit_xpath', '//s', 'username_env', if(g % 18 = 0, '', 'U'), 'password_env', if(g % 24 = 0, {_NS}, 'P'),
  'post_login_wait_xpath', {_NS}, 'post_login_url_contains', {_NS}) end
"""


def derived_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec per five pages, with mistakes of every kind spread over them."""
    rows = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 5).alias("g"), "url", "page_id", F.expr(_DERIVED_STEP).alias("step")
    )
    grouped = rows.groupBy("g").agg(
        F.array_sort(F.collect_list("step")).alias("steps"), F.min_by("url", "page_id").alias("url")
    )
    return grouped.select(
        F.concat(F.lit("spec_"), F.lpad(F.col("g").cast("string"), 6, "0")).alias("spec_id"),
        F.expr("if(g % 12 = 0, ' ', concat('site_', g % 40))").alias("name"),
        F.expr(
            "case when g % 9 = 1 then 'ftp://x' when g % 4 = 0 then '' else regexp_extract(url, '^[a-z]+://[^/?#]+', 0) end"
        ).alias("base_url"),
        F.expr(_DERIVED_LOGIN).alias("login"),
        F.transform("steps", lambda s: s.dropFields("n")).alias("steps"),
        F.expr("if(g % 8 = 2, 0, 20)").alias("wait_timeout_sec"),
        F.expr("if(g % 10 = 3, -5, 30)").alias("page_load_timeout_sec"),
        F.expr("case when g % 7 = 4 then 'a/b' when g % 15 = 5 then '' end").alias("artifact_dir"),
        F.lit(None).cast("boolean").alias("capture_enabled"),
    )


def target_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid specs of up to five steps whose targets are mostly captured pages."""
    step = F.expr(
        f"""named_struct('n', page_id, 'name', concat('step_', page_id),
        'goto_url', case when page_id % 5 = 3 then {_NS} when page_id % 15 = 4 then '/missing/page' else url end,
        'click_xpath', {_NS}, 'wait_xpath', if(page_id % 2 = 0, '//article', {_NS}), 'wait_url_contains', {_NS},
        'execute_js', {_NS},
        'fields', array(named_struct('name', 'h1', 'xpath', '//h1', 'attribute', {_NS}),
          named_struct('name', 'p2', 'xpath', '//article/p[2]', 'attribute', {_NS})),
        'frames', {_NO_FRAMES}, 'frame_exit', {_NS})"""
    )
    rows = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).alias("g"), "url", "page_id", step.alias("step"))
    return rows.groupBy("g").agg(
        F.array_sort(F.collect_list("step")).alias("steps"), F.min_by("url", "page_id").alias("url")
    ).select(
        F.concat(F.lit("spec_"), F.lpad(F.col("g").cast("string"), 6, "0")).alias("spec_id"),
        F.concat(F.lit("site_"), F.col("g").cast("string")).alias("name"),
        F.expr("case when g % 4 = 0 then regexp_extract(url, '^[a-z]+://[^/?#]+', 0) when g % 4 = 1 then regexp_extract(url, '^[^?#]*', 0) else '' end").alias("base_url"),
        F.transform("steps", lambda s: s.dropFields("n")).alias("steps"),
        F.lit(20).alias("wait_timeout_sec"),
        F.lit(30).alias("page_load_timeout_sec"),
    )


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per ten pages, one site per page, with timeouts written in several ways."""
    timeout = F.expr(
        """case pmod(page_id, 7) when 0 then '15' when 1 then '3.7' when 2 then '"12"' when 3 then '"3.5"'
        when 4 then 'true' when 5 then '" 8 "' else '"soon"' end"""
    )
    site = F.format_string(
        '{"name": "page_%d", "base_url": "%s", "wait_timeout_sec": %s, "steps": [{"name": "s", "fields": [{"name": "h", "xpath": "//h1"}]}]}',
        F.col("page_id"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0), timeout,
    )
    groups = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 10).alias("g"), F.struct("page_id", site.alias("text")).alias("s")
    ).groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("s"))
    listed = F.array_join(F.transform("s", lambda x: x["text"]), ", ")
    value = (
        F.when(F.col("g") % 6 == 1, F.concat(F.lit('{"pages": ['), listed, F.lit("]}")))
        .when(F.col("g") % 6 == 2, F.lit('{"sites": "none"}'))
        .when(F.col("g") % 6 == 3, F.concat(F.lit('{"sites": ['), listed))
        .otherwise(F.concat(F.lit('{"sites": ['), listed, F.lit("]}")))
    )
    return groups.select(F.concat(F.lit("doc_"), F.lpad(F.col("g").cast("string"), 6, "0")).alias("source"), value.alias("value"))
