"""HTML repair: always well-formed, and elements end up where a browser puts them."""

import random
import xml.dom.minidom as dom

import pytest
from pyspark.sql import functions as F

from gleanery.functions.html import is_cut, repair, repair_page
from gleanery.functions.xpath import css_to_xpath, invalid_paths

TOKENS = (
    "<p> </p> <b> </b> <i|a='1'> </i> <div> </div> <table> <tr> <td> </table> <a|href=x> </a> <li> </ul> <ul> txt &amp; & < > \" '"
    " <!-- --> <script> </script> <title> </title> <head> </head> <body> </body> <html> </html> <br/> <x:y|z:w=1> </x:y>"
    " <select> <option> <span|style='display:none'> </span> <1> <é> <?pi?> <!d> </tr> </td> \x00 \x1f"
).split(" ")


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<p><b>a<br><p>b</p><p>c", "<p><b>a<br></br></b></p><p><b>b</b></p><p><b>c</b></p>"),
        ("<div><b><p>x</b>y</p><p>z</p></div>", "<div><b><p>xy</p></b><p>z</p></div>"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>x", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>x"),
        ("a < b & c &lt; d", "a &lt; b &amp; c &lt; d"),
        ("<a href=x>1<a href=y>2", '<a href="x">1</a><a href="y">2</a>'),
        ("<a href='x'><div>block</div></a>t", '<a href="x"><div>block</div></a>t'),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<div a=\"unclosed>text", '<div a="&quot;unclosed">text</div>'),
        ("<div hidden><p>q", '<div hidden="" _hid="1"><p _hid="1">q</p></div>'),
    ],
)
def test_structure(html, body):
    assert repair_page(html) == f"<html><body>{body}</body></html>"


def test_any_token_soup_is_well_formed():
    rng = random.Random(3)
    for _ in range(8000):
        html = "".join(rng.choice(TOKENS).replace("|", " ") for _ in range(rng.randint(1, 25)))
        dom.parseString(repair_page(html).encode())


@pytest.mark.parametrize("piece", ['<a "', "<a ", "<a b='", '<a ">" ', "<!-", "</a ", "<b><p>"])
def test_repair_takes_linear_time(piece):
    import time

    started = time.perf_counter()
    dom.parseString(repair_page(piece * 100_000)[:1_000_000_000].encode())
    assert time.perf_counter() - started < 20
    started = time.perf_counter()
    repair_page('<a "' * 100_000)
    repair_page("<a " * 100_000)
    assert time.perf_counter() - started < 2


def test_a_tag_that_never_ends_is_text():
    assert repair_page("<p>x</p><a y") == "<html><body><p>x</p>&lt;a y</body></html>"
    assert repair_page("<p>x</p><é y<!-- c -->z") == "<html><body><p>x</p>&lt;é yz</body></html>"


def test_large_elements_are_kept_or_reported(spark):
    many = "<a " + " ".join(f'a{k}="{k}"' for k in range(9_500)) + ">x</a>"
    long = "<a " + "n" * 3_000 + '="v">y</a>'
    deep = "<div>" * 600 + "z"
    df = spark.createDataFrame([(many,), (long,), (deep,), ("<p>w",)], "html string").select(repair("html").alias("d"))
    got = df.select(
        F.xpath_string("d", F.lit("string(count(//a/@*))")).alias("n"),
        F.xpath_string("d", F.lit("normalize-space(//body)")).alias("t"),
        is_cut("d").alias("cut"),
    ).collect()
    assert [(r.n, r.t, r.cut) for r in got] == [("9500", "x", False), ("1", "y", False), ("0", "z", True), ("0", "w", False)]
    assert '_cut="1"' in repair_page(many) and repair_page(many).count('="') == 9_001
    assert '_cut="1"' in repair_page(long) and "nnn" not in repair_page(long)


def test_null_and_empty():
    assert repair_page(None) is None
    assert repair_page("") == "<html><body></body></html>"
    assert "if(a" not in repair_page("<script>if(a<b)</script>x")
    assert "if(a&lt;b)" in repair_page("<script>if(a<b)</script>x", keep_raw_text=True)


def test_spark_reads_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    titles = pages.select(
        F.xpath_string(repair("html"), F.lit("normalize-space(//h1)")).alias("h1"),
        F.xpath_string(repair("html"), F.lit("string(//body/@_hid)")).alias("hidden"),
    )
    assert titles.where("h1 = '' or hidden <> ''").count() == 0


@pytest.mark.parametrize(
    ("css", "path"),
    [
        ("iframe", "//iframe"),
        ("#main > iframe.x", "//*[@id='main']/iframe[contains(concat(' ', normalize-space(@class), ' '), ' x ')]"),
        ("div [name='f']", "//div//*[@name='f']"),
        ("iframe[src^=\"/a\"], frame", "//iframe[starts-with(@src, '/a')] | //frame"),
        ("a:hover", None),
        ("a[b", None),
        ("iframe[src=\"a,b\"], frame", "//iframe[@src='a,b'] | //frame"),
        ("iframe[title='x > y']", "//iframe[@title='x > y']"),
        ("div >", None),
    ],
)
def test_css_subset(css, path):
    assert css_to_xpath(css) == path


def test_invalid_paths(spark):
    paths = ["//a", "//a[", "", "count(//b)", "//p[[", "//a/@href", "string(//x"]
    found = invalid_paths(spark.createDataFrame([(p,) for p in paths * 3], "path string"))
    assert sorted(found) == sorted(["//a[", "", "//p[[", "string(//x"])


def test_extreme_pages_are_readable(spark):
    pages = [
        "<div>" * 30_000 + "<h1>deep</h1>",
        "<p " + " ".join(f"a{n}=1" for n in range(20_000)) + "><h1>wide</h1>",
        f"<{'x' * 5000} {'y' * 5000}=1><h1>long</h1>",
        "<h1>" + "word " * 200_000 + "</h1>",
        "<a \"<a '<b \"><h1>quotes</h1>",
        "<!-- open <h1>comment</h1>",
    ]
    df = spark.createDataFrame([(n, p) for n, p in enumerate(pages)], "n int, html string")
    got = df.select("n", F.xpath_string(repair("html"), F.lit("normalize-space((//h1)[1])")).alias("h")).orderBy("n").collect()
    assert [r["h"][:6].strip() for r in got] == ["deep", "wide", "long", "word w", "quotes", ""]
    assert len(got[3]["h"]) == len("word " * 200_000) - 1


def test_reopened_formatting_adds_a_few_times_the_page():
    flood = "".join(f"<p><b id={n}>" for n in range(20_000))
    made = repair_page(flood)
    assert len(made) < 10 * len(flood)
    assert made.startswith('<html _cut="1">') and made.count("<p>") == 20_000
    # a page that never closes its formatting keeps all of it
    plain = "<p><b><i><font size=2>" + "<p>some text and more of it" * 500
    assert "_cut" not in repair_page(plain)[:40] and repair_page(plain).count("<font") == 501


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<p><b id=1><p><i><p>x", '<p><b id="1"></b></p><p><b id="1"><i></i></b></p><p><b id="1"><i>x</i></b></p>'),
        ("<p><a href=x><b>1<p>2<p><a href=y>3", '<p><a href="x"><b>1</b></a></p><p><a href="x"><b>2</b></a></p><p><b><a href="y">3</a></b></p>'),
        ("<p hidden><b>1<p>2", '<p hidden="" _hid="1"><b _hid="1">1</b></p><p><b>2</b></p>'),
        ("<p><b><div hidden>1</b><i>2<p>3", '<p><b></b></p><div hidden="" _hid="1"><b _hid="1">1</b><i _hid="1">2<p _hid="1">3</p></i></div>'),
        ("<b><p><i>1</b>2</p>3<span>4", "<b><p><i>12</i></p></b><i>3<span>4</span></i>"),
        ("<p><b><b><b><b><b class='x'><p>1", '<p><b><b><b><b><b class="x"></b></b></b></b></b></p><p><b><b><b><b class="x">1</b></b></b></b></p>'),
        ("<b><table><td><a x=1><b>1</table>2<p>3", '<b><table><tbody><tr><td><a x="1"><b>1</b></a></td></tr></tbody></table><a x="1"><b>2<p>3</p></b></a></b>'),
    ],
)
def test_formatting_is_reopened_in_order(html, body):
    assert repair_page(html) == f"<html><body>{body}</body></html>"


def test_flooded_pages_are_dealt_to_all_task_slots(spark):
    from gleanery.plans.extract_queries import formatting_flood

    # the table is one file of one row group, which a scan does not split
    places = formatting_flood(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("place")).distinct().count()
    assert places >= spark.sparkContext.defaultParallelism


def test_many_names_without_an_open_one_are_fast():
    import time

    start = time.perf_counter()
    repair_page("<li><ul>" * 20_000)
    assert time.perf_counter() - start < 5


def test_outcomes_say_what_was_cut(spark):
    from gleanery.operators import extract
    from gleanery.sources import specs as S

    spec = '{"sites": [{"name": "s", "base_url": "http://a.example", "steps": [{"name": "one", "fields": [{"name": "h", "xpath": "//h1"}]}]}]}'
    sites = S.sites_of(S.parse_documents(spark.createDataFrame([("d", spec)], "source string, value string")))
    rows = [(1, "http://a.example/1", "<h1>x</h1>"), (2, "http://a.example/2", "<div>" * 600 + "<h1>y</h1>"), (3, "http://a.example/3", None)]
    found = extract.steps(extract.outcomes_by_page(spark.createDataFrame(rows, "page_id long, url string, html string"), sites))
    assert [(r.page_id, r.cut) for r in found.orderBy("page_id").collect()] == [(1, False), (2, True), (3, False)]


def test_texts_of_several_documents(spark):
    from gleanery.sources import specs as S

    one = '{"sites": [{"name": "%s"}]}'
    texts = {
        "single": one % "a",
        "spread": '\n{"sites":\n [{"name": "b"}]}\n',
        "lines": "\n".join([one % "c", "", "{broken", "\t" + one % "d" + "\r", '["no site"]']),
        "behind": one % "e" + " " + one % "f",
        "array_end": one % "g" + "] [",
        "object_end": one % "h" + "} {",
        "two": one % "i" + "," + one % "j",
        "blank": " \n ",
    }
    found = S.parse_documents(spark.createDataFrame(list(texts.items()), "source string, value string"))
    got = {(r.source, r.kind, r.site) for r in found.selectExpr("source", "kind", "sites[0].name as site").collect()}
    assert got == {
        ("single", "list", "a"), ("spread", "list", "b"), ("lines:1", "list", "c"), ("lines:3", "unreadable", None), ("lines:4", "list", "d"),
        ("lines:5", "missing", None), ("behind", "unreadable", None), ("array_end", "unreadable", None), ("object_end", "unreadable", None),
        ("two", "unreadable", None), ("blank", "unreadable", None),
    }


def test_pages_meet_python_in_batches_of_bounded_bytes(spark):
    from gleanery import session

    spark.conf.unset(session.ARROW_BATCH_LIMIT)
    pages = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("<p>x"), 2000).alias("html"))
    pages.select(repair("html").alias("document"))

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = pages.mapInArrow(counted, "n bigint").collect()
    assert max(row.n for row in rows) < 500
