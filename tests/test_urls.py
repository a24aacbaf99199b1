"""URL expressions: written-out answers, properties of random values, and the same answers through SQL."""

import random
from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from gleanery.functions import urls

# value, canonical form, valid
ANSWERS = [
    ("http://shop.test/a?x=1", "http://shop.test/a?x=1", True),
    ("HTTP://Shop.test/X?q", "http://Shop.test/X?q=", True),
    ("http://shop.test?", "http://shop.test", True),
    ("http://shop.test#", "http://shop.test", True),
    ("http://shop.test/?a&&b=1;2", "http://shop.test/?a=&b=1%3B2", True),
    ("http://shop.test/?k=%zz&k=%2", "http://shop.test/?k=%25zz&k=%252", True),
    ("http://shop.test/?s=two%20words+more", "http://shop.test/?s=two+words+more", True),
    ("http://shop.test/p?q=~*-._#end part", "http://shop.test/p?q=~%2A-._#end part", True),
    ("  https://shop.test/y\t", "https://shop.test/y", True),
    ("ht\ntp://shop.test/", "http://shop.test/", True),
    ("http://[::1]/x", "http://[::1]/x", True),
    ("http://[2001:db8::7]:8080/x", "http://[2001:db8::7]:8080/x", True),
    ("http://[v1.name]/", "http://[v1.name]/", True),
    ("http://[::1/x", None, False),
    ("http://::1]/x", None, False),
    ("http://[::g]/x", None, False),
    ("http://[1.2.3.4]/", None, False),
    ("http://s\u2100p.test/", None, False),
    ("http://", "http://", False),
    ("ftp://shop.test/", None, False),
    ("//shop.test/", None, False),
    ("/shelf/3", None, False),
    ("shelf", None, False),
    ("", None, False),
    ("\x01\x02", None, False),
]


def test_answers(spark):
    df = spark.createDataFrame(ANSWERS, "url string, want string, valid boolean")
    for r in df.select("*", urls.normalize("url").alias("n"), urls.is_valid("url").alias("v")).collect():
        assert (r["n"], r["v"]) == (r["want"], r["valid"]), r


def _random_urls(count, seed):
    rng = random.Random(seed)
    alphabet = "htp:/?#[]@&=+%25 aé~*;.\t-2Ff\x07\u2100"
    for _ in range(count):
        yield "http://" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        yield "https://h.test/p?" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10)))


def test_canonical_form_keeps_what_it_must(spark):
    df = spark.createDataFrame([(v,) for v in _random_urls(900, 5)], "url string")
    df = df.select("url", urls.normalize("url").alias("n"), urls.url_error("url").alias("e")).withColumn("again", urls.normalize("n"))
    kept = 0
    for r in df.collect():
        assert (r["n"] is None) == (r["e"] is not None), r
        if r["n"] is None:
            continue
        kept += 1
        assert r["again"] == r["n"]
        assert not any(ord(c) < 32 for c in r["n"])
        before, after = urlsplit("".join(c for c in r["url"] if ord(c) > 31).strip()), urlsplit(r["n"])
        assert (after.scheme, after.netloc) == (before.scheme, before.netloc)
        assert parse_qsl(after.query, keep_blank_values=True) == parse_qsl(before.query, keep_blank_values=True)
    assert kept > 500


def test_sql_functions_equal_the_columns(spark):
    urls.register(spark)
    values = [v for v, _, _ in ANSWERS] + list(_random_urls(700, 9)) + [None]
    df = spark.createDataFrame([(v,) for v in values], "url string")
    pairs = {
        "normalize_url(url)": urls.normalize("url"),
        "validate_url(url)": urls.is_valid("url"),
        "is_absolute_url(url)": urls.is_absolute("url"),
        "url_host(url)": urls.host("url"),
    }
    for sql, column in pairs.items():
        wrong = df.where(~F.expr(sql).eqNullSafe(column)).collect()
        assert wrong == [], sql


@pytest.mark.parametrize(
    ("url", "base", "expected"),
    [
        ("https://shop.test/item", "https://else.test", "https://shop.test/item"),
        ("/shelf/3", "https://shop.test", "https://shop.test/shelf/3"),
        ("shelf/3", "https://shop.test", "https://shop.test/shelf/3"),
        ("/shelf", "https://shop.test/", "https://shop.test/shelf"),
        ("/shelf", "https://shop.test///", "https://shop.test/shelf"),
        ("", "https://shop.test", None),
        ("  ", "https://shop.test", None),
        ("/shelf", "/not/a/site", None),
        ("HTTP://x/y", "https://b", "https://b/HTTP://x/y"),
    ],
)
def test_make_absolute(spark, url, base, expected):
    df = spark.createDataFrame([(url, base)], "u string, b string")
    assert df.select(urls.make_absolute("u", "b")).first()[0] == expected


def test_dedup_keeps_the_smallest_id(spark):
    rows = [(3, "http://a.test/?x", "c"), (1, "HTTP://a.test/?x=", "a"), (2, "http://b.test", "b"), (4, "nowhere", "d")]
    got = urls.dedup(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {(r.norm_url, r.page_id, r.html) for r in got.collect()} == {("http://a.test/?x=", 1, "a"), ("http://b.test", 2, "b")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_reasons(spark):
    cases = [("", "empty"), (" \t", "blank"), ("/p", "no_scheme"), ("ftp://x", "bad_scheme"), ("http://[x/", "invalid_host"), ("http://x", None)]
    df = spark.createDataFrame(cases, "u string, want string")
    assert all(r[0] == r[1] for r in df.select(urls.url_error("u"), "want").collect())
    pairs = [("a", "/b", "bad_base"), ("", "http://b", "empty"), ("a", "http://b", None)]
    df = spark.createDataFrame(pairs, "u string, b string, want string")
    assert all(r[0] == r[1] for r in df.select(urls.url_error("u", "b"), "want").collect())
    with pytest.raises(Exception, match="no_scheme"):
        spark.createDataFrame([("/p",)], "u string").select(urls.normalize_strict("u")).collect()


def test_join_reference(spark):
    base = "http://a.com/b/c;d?q"
    refs = ["g", "./g", "g/", "/g", "//h", "?y", "g?y", "#s", "", "..", "../g", "../../../g", "./", "g/./h", "g/../h", "mailto:x"]
    df = spark.createDataFrame([(base, r) for r in refs], "b string, r string")
    for r in df.select("b", "r", urls.join_reference("b", "r").alias("j")).collect():
        assert r["j"] == urljoin(r["b"], r["r"])


def test_plan_stays_in_the_jvm(spark):
    df = spark.range(10).select(F.concat(F.lit("http://a/?x="), F.col("id")).alias("url")).select(urls.normalize("url"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
