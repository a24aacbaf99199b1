"""A page is read into a document once, however many visits and selector lists need it."""

import json

from pyspark.sql import functions as F

from gleanery.functions.html import repair_both, repair_page
from gleanery.operators import extract
from gleanery.sources import specs as S


def sites_of(spark, sites):
    return S.sites_of(S.parse_documents(spark.createDataFrame([("d", json.dumps({"sites": sites}))], "source string, value string")))


def repairs(df):
    """Rows that went through Arrow functions, by the metrics of the finished plan."""
    execution = df._jdf.queryExecution()
    df._jdf.collect()
    found, todo = [], [execution.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ArrowEvalPythonExec":
            found.append(int(node.metrics().apply("pythonNumRowsReceived").value()))
        children = node.children()
        todo += [children.apply(n) for n in range(children.size())]
    return found


def many_specs(count, attribute=None):
    fields = lambda n: [{"name": "h", "xpath": f"//h{n % 6 + 1}"}] + ([{"name": "s", "xpath": "//script", "attribute": attribute}] if attribute else [])
    return [{"name": f"site_{n}", "base_url": "http://a.example", "steps": [{"name": "one", "fields": fields(n)}]} for n in range(count)]


def test_pages_are_read_once_for_all_specs(spark):
    specs = sites_of(spark, many_specs(40, "textContent"))
    rows = [(n, f"http://a.example/{n}", f"<h1>t{n}</h1><h2>u{n}</h2><script>x<{n}</script>") for n in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract.outcomes_by_page(pages, specs, visibility="presence")
    assert repairs(found) == [15]
    long = {(r.site, r.page_id, r.field): r.value for r in extract.long(found).collect()}
    assert len(long) == 15 * 40 * 2
    assert long["site_6", 3, "h"] == "t3" and long["site_1", 4, "h"] == "u4" and long["site_9", 5, "s"] == "x<5"


def test_targets_are_read_once_for_all_specs(spark):
    step = [{"name": "one", "goto_url": "http://a.example/1", "fields": [{"name": "h", "xpath": "//h1"}]}]
    specs = sites_of(spark, [{"name": f"s{n}", "base_url": "", "steps": step} for n in range(30)])
    pages = spark.createDataFrame([(1, "http://a.example/1", "<h1>x</h1>"), (2, "http://a.example/2", "<h1>y</h1>")], "page_id long, url string, html string")
    found = extract.outcomes_by_target(pages, specs)
    assert repairs(found) == [1]
    assert {(r.site, r.value) for r in extract.long(found).collect()} == {(f"s{n}", "x") for n in range(30)}


def test_more_visits_than_a_page_carries(spark, monkeypatch):
    monkeypatch.setattr(extract, "VISITS_PER_READ", 4)
    specs = sites_of(spark, many_specs(10))
    pages = spark.createDataFrame([(1, "http://a.example/1", "<h1>x</h1>")], "page_id long, url string, html string")
    found = extract.outcomes_by_page(pages, specs)
    assert repairs(found) == [3]
    assert extract.long(found).count() == 10


def test_hundreds_of_selector_lists_read_the_pages_once(spark):
    sites = [{"name": f"s{n}", "base_url": "http://a.example", "steps": [{"name": "one", "fields": [{"name": "h", "xpath": f"//*[@id='i{n}']"}]}]} for n in range(230)]
    rows = [(k, f"http://a.example/{k}", f"<p id=i{k}>v{k}</p>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract.long(extract.outcomes_by_page(pages, sites_of(spark, sites)))
    assert found.count() == 230 * 8
    assert {(r.site, r.page_id, r.value) for r in found.where(F.col("status") == "found").collect()} == {(f"s{k}", k, f"v{k}") for k in range(8)}
    # the parts read what was written, not the pages
    assert repairs(found) == []


def test_both_documents_of_a_page():
    html = "<p>a<script>if (x < y) {}</script><style>p > b</style>c<title>t</title>"
    assert repair_both(html, False) == (repair_page(html, False, False), repair_page(html, True, False))
    assert "x &lt; y" in repair_both(html)[1] and "x &lt;" not in repair_both(html)[0]
    assert repair_both(None) == (None, None)
