"""Extraction specs: site -> steps -> fields / frames, from JSON documents or tables.

A spec row is one site with nested steps. ``flatten`` turns it into four tables
that keep document order in ``step_ord`` / ``field_ord`` / ``frame_ord``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Defaults of the spec format.
DEFAULT_WAIT_TIMEOUT_SEC = 20
DEFAULT_PAGE_LOAD_TIMEOUT_SEC = 30
DEFAULT_ARTIFACT_DIR = "artifacts"
DEFAULT_FRAME_EXIT = "default"
LOGIN_REQUIRED = ("url", "username_xpath", "password_xpath", "submit_xpath", "username_env", "password_env")
LOGIN_OPTIONAL = ("post_login_wait_xpath", "post_login_url_contains")

_FIELD = "struct<name:string,xpath:string,attribute:string>"
_FRAME = "struct<xpath:string,css:string,index:int,name:string>"
_STEP = (
    "struct<name:string,goto_url:string,click_xpath:string,wait_xpath:string,wait_url_contains:string,"
    f"execute_js:string,fields:array<{_FIELD}>,frames:array<{_FRAME}>,frame_exit:string>"
)
_LOGIN = "struct<" + ",".join(f"{key}:string" for key in LOGIN_REQUIRED + LOGIN_OPTIONAL) + ">"
SITE_SCHEMA = (
    f"struct<name:string,base_url:string,login:{_LOGIN},steps:array<{_STEP}>,"
    "wait_timeout_sec:variant,page_load_timeout_sec:variant,artifact_dir:string,capture_enabled:boolean>"
)


class Specs(NamedTuple):
    """Flattened spec tables; ``spec_id`` ties them together."""

    sites: DataFrame
    steps: DataFrame
    fields: DataFrame
    frames: DataFrame


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents ``{"sites": [...]}``, one a file or one a line: a row per document with its parse result."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return parse_documents(raw)


def _single(text: Column) -> Column:
    """The text as a variant if it is one JSON value and nothing else, else null.

    The parser stops at the end of the first value. Whatever follows it spoils the text as the only element of a
    list or as the only member of an object: no text closes both early.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"d":'), text, F.lit("}")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & member.isNotNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def parse_documents(raw: DataFrame) -> DataFrame:
    """``(source, value)`` -> ``(source, kind, sites)``; ``kind`` is the JSON type found under ``sites``.

    A text of several documents, one a line, gives a row per line that is not blank, under ``source:line``. Any
    other text that is not one JSON document, or has something after it, is ``unreadable``.
    """
    lines = F.filter(F.transform(F.split("value", "\n"), lambda text, n: F.struct((n + 1).alias("n"), text.alias("text"))), lambda x: F.trim(F.translate(x["text"], "\r\t", "  ")) != "")
    # only where the first line is a document are the others taken for documents as well
    many = _single(F.col("value")).isNull() & (F.size("lines") > 1) & F.schema_of_variant(_single(F.col("lines")[0]["text"])).startswith("OBJECT")
    whole = F.array(F.struct("source", F.col("value").alias("text")))
    split = F.transform("lines", lambda x: F.struct(F.concat_ws(":", "source", x["n"].cast("string")).alias("source"), x["text"].alias("text")))
    rows = raw.select("source", "value", lines.alias("lines")).select(F.inline(F.when(many, split).otherwise(whole)))
    parsed = _single(F.col("text"))
    found = F.try_variant_get(parsed, "$.sites", "variant")
    return rows.withColumn("parsed", parsed).select(
        "source",
        F.when(F.col("parsed").isNull(), "unreadable")
        .when(found.isNull(), "missing")
        .when(F.schema_of_variant(found).startswith("ARRAY"), "list")
        .otherwise("other")
        .alias("kind"),
        F.when(F.col("parsed").isNotNull(), F.from_json("text", f"struct<sites:array<{SITE_SCHEMA}>>")["sites"]).alias("sites"),
    )


def sites_of(documents: DataFrame) -> DataFrame:
    """One spec row per site; ``spec_id`` keeps document order."""
    return documents.where(F.col("kind") == "list").select(
        "source", F.posexplode("sites").alias("site_ord", "spec")
    ).select(
        F.concat_ws("#", "source", F.lpad(F.col("site_ord").cast("string"), 9, "0")).alias("spec_id"),
        "spec.*",
    )


def read_tables(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """Spec rows stored as a table with the nested layout of ``SITE_SCHEMA`` plus ``spec_id``."""
    return spark.read.format(source_format).load(path)


def _timeout(specs: DataFrame, name: str) -> tuple[Column, Column]:
    """Coerced whole seconds, and whether coercion is impossible.

    A number is truncated; a string must spell an integer; a boolean counts as 0 or 1.
    """
    raw = F.col(name)
    if dict(specs.dtypes)[name] != "variant":
        return raw.cast("int"), F.lit(False)
    kind = F.schema_of_variant(raw)
    text = F.try_variant_get(raw, "$", "string")
    is_text = kind == "STRING"
    spelled = F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", ""), r"(?<=\d)_(?=\d)", "")
    value = F.when(
        is_text, F.when(spelled.rlike(r"^[+-]?\d+\z"), spelled.try_cast("int"))
    ).when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("int")).otherwise(
        F.try_variant_get(raw, "$", "double").cast("int")
    )
    return value, raw.isNotNull() & value.isNull()


def flatten(specs: DataFrame) -> Specs:
    """Nested spec rows -> sites, steps, fields, frames with defaults filled in."""
    wait, bad_wait = _timeout(specs, "wait_timeout_sec")
    load, bad_load = _timeout(specs, "page_load_timeout_sec")
    sites = specs.select(
        "spec_id",
        F.col("name").alias("site"),
        F.coalesce("base_url", F.lit("")).alias("base_url"),
        "login",
        F.when(~bad_wait, F.coalesce(wait, F.lit(DEFAULT_WAIT_TIMEOUT_SEC))).alias("wait_timeout_sec"),
        F.when(~bad_load, F.coalesce(load, F.lit(DEFAULT_PAGE_LOAD_TIMEOUT_SEC))).alias("page_load_timeout_sec"),
        F.coalesce("artifact_dir", F.lit(DEFAULT_ARTIFACT_DIR)).alias("artifact_dir"),
        F.coalesce("capture_enabled", F.lit(True)).alias("capture_enabled"),
    )
    exploded = specs.select(
        "spec_id", F.col("name").alias("site"), F.posexplode("steps").alias("pos", "s")
    ).withColumn("step_ord", F.col("pos") + 1)
    steps = exploded.select(
        "spec_id",
        "site",
        "step_ord",
        F.col("s.name").alias("step"),
        "s.goto_url",
        "s.click_xpath",
        "s.wait_xpath",
        "s.wait_url_contains",
        "s.execute_js",
        F.coalesce("s.frame_exit", F.lit(DEFAULT_FRAME_EXIT)).alias("frame_exit"),
    )
    fields = exploded.select(
        "spec_id", "site", "step_ord", F.col("s.name").alias("step"), F.posexplode("s.fields").alias("fpos", "f")
    ).select(
        "spec_id",
        "site",
        "step_ord",
        "step",
        (F.col("fpos") + 1).alias("field_ord"),
        F.col("f.name").alias("field"),
        "f.xpath",
        "f.attribute",
    )
    frames = exploded.select(
        "spec_id", "site", "step_ord", F.col("s.name").alias("step"), F.posexplode("s.frames").alias("fpos", "f")
    ).select(
        "spec_id",
        "site",
        "step_ord",
        "step",
        (F.col("fpos") + 1).alias("frame_ord"),
        "f.xpath",
        "f.css",
        "f.index",
        "f.name",
        frame_kind(F.col("f")).alias("kind"),
        frame_value(F.col("f")).alias("value"),
    )
    return Specs(sites, steps, fields, frames)


def frame_kind(frame: Column) -> Column:
    return (
        F.when(frame["xpath"].isNotNull(), "xpath")
        .when(frame["css"].isNotNull(), "css")
        .when(frame["index"].isNotNull(), "index")
        .when(frame["name"].isNotNull(), "name")
    )


def frame_value(frame: Column) -> Column:
    return F.coalesce(frame["xpath"], frame["css"], frame["index"].cast("string"), frame["name"])
