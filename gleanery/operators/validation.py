"""Spec validation: every broken rule as a row, instead of stopping at the first.

Rules are checked in one pass per spec table; only duplicate names need a grouping.
``seq`` orders violations the way a sequential reader of the document would meet them,
so ``first_violations`` gives what such a reader would have raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import urls, xpath as xp
from gleanery.session import broadcast_if_small
from gleanery.sources.specs import LOGIN_REQUIRED, Specs, flatten

# Reading order inside a site: before its steps, the steps, after them, across sites.
_BEFORE, _STEPS, _AFTER, _ACROSS = 0, 1, 2, 3


def _blank(text: Column) -> Column:
    return F.coalesce(urls.strip(text), F.lit("")) == ""


def _given(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _rows(df: DataFrame, rules: list[tuple[str, Column, Column]], place: list[Column], **columns: Column) -> DataFrame:
    """One output row per rule that holds; ``place`` + rule position gives the reading order."""
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    broken,
                    F.struct(
                        F.lit(rule).alias("rule"),
                        detail.cast("string").alias("detail"),
                        F.array(*[p.cast("int") for p in place], F.lit(n)).alias("seq"),
                    ),
                )
                for n, (rule, broken, detail) in enumerate(rules)
            ]
        )
    )
    missing = F.lit(None).cast("string")
    return df.select(
        "spec_id",
        F.col("site"),
        columns.get("step", missing).alias("step"),
        columns.get("field", missing).alias("field"),
        F.inline(found),
    ).select("rule", "spec_id", "site", "step", "field", "detail", "seq")


def _duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def path_verdicts(tables: Specs) -> DataFrame:
    """Distinct paths that do not compile (rule V15), as a one-column table."""
    fields = tables.fields.select(F.col("xpath").alias("path")).where(F.col("path").isNotNull())
    gates = tables.steps.select(F.explode(F.array("click_xpath", "wait_xpath")).alias("path")).where(_given(F.col("path")))
    spark = tables.fields.sparkSession
    bad = xp.invalid_paths(fields.union(gates))
    return spark.createDataFrame([(path, True) for path in bad], "path string, bad_path boolean")


def violations(specs: DataFrame) -> DataFrame:
    """``(rule, spec_id, site, step, field, detail, seq)`` for nested spec rows."""
    # specs are configuration; each table below reads them, so they are computed once
    tables = flatten(specs.persist())
    sites, steps, fields, frames = tables
    bad_paths = broadcast_if_small(path_verdicts(tables))

    login = F.col("login")
    has_login = login.isNotNull()
    login_missing = F.array_compact(
        F.array(*[F.when(login[key].isNull(), F.lit(key)) for key in LOGIN_REQUIRED])
    )
    site_before = _rows(
        sites,
        [
            ("V17", F.col("site").isNull(), F.lit("name")),
            ("V14", _given(F.col("base_url")) & ~urls.is_valid("base_url"), F.col("base_url")),
            ("V14", has_login & login["url"].isNotNull() & ~urls.is_valid(login["url"]), login["url"]),
            ("V17", has_login & (F.size(login_missing) > 0), F.array_join(login_missing, ",")),
            ("V3", has_login & ~_given(login["url"]), F.lit("login.url")),
            (
                "V4",
                has_login & (~_given(login["username_env"]) | ~_given(login["password_env"])),
                F.lit("login.username_env,login.password_env"),
            ),
        ],
        [F.lit(_BEFORE), F.lit(0), F.lit(0), F.lit(0)],
    )
    site_after = _rows(
        sites,
        [
            ("V18", F.col("wait_timeout_sec").isNull(), F.lit("wait_timeout_sec")),
            ("V18", F.col("page_load_timeout_sec").isNull(), F.lit("page_load_timeout_sec")),
            ("V11", F.col("site").isNotNull() & _blank(F.col("site")), F.lit("name")),
            ("V11", F.col("wait_timeout_sec") < 1, F.col("wait_timeout_sec")),
            ("V11", F.col("page_load_timeout_sec") < 1, F.col("page_load_timeout_sec")),
        ],
        [F.lit(_AFTER), F.lit(0), F.lit(0), F.lit(0)],
    )
    artifact = _rows(
        sites,
        [
            (
                "V16",
                (F.col("artifact_dir") == "") | F.col("artifact_dir").rlike(r"[/\\\x00]"),
                F.col("artifact_dir"),
            )
        ],
        [F.lit(_AFTER), F.lit(2), F.lit(0), F.lit(0)],
    )

    step, goto = F.col("step"), F.col("goto_url")
    wait_bad = bad_paths.select(F.col("path").alias("wait_xpath"), F.col("bad_path").alias("bad_wait"))
    click_bad = bad_paths.select(F.col("path").alias("click_xpath"), F.col("bad_path").alias("bad_click"))
    judged = steps.join(wait_bad, "wait_xpath", "left").join(click_bad, "click_xpath", "left")
    at = F.col("step_ord")
    step_before = _rows(
        judged,
        [
            ("V17", step.isNull(), F.lit("step.name")),
            ("V13", _given(goto) & ~urls.is_valid(goto) & ~goto.startswith("/"), goto),
            ("V15", _given(F.col("click_xpath")) & F.col("bad_click"), F.col("click_xpath")),
            ("V15", _given(F.col("wait_xpath")) & F.col("bad_wait"), F.col("wait_xpath")),
        ],
        [F.lit(_STEPS), at, F.lit(0), F.lit(0)],
        step=step,
    )
    step_after = _rows(
        steps,
        [
            ("V8", step.isNotNull() & _blank(step), F.lit("step.name")),
            ("V9", ~F.col("frame_exit").isin("default", "parent"), F.col("frame_exit")),
        ],
        [F.lit(_STEPS), at, F.lit(3), F.lit(0)],
        step=step,
    )

    path = F.col("xpath")
    field_bad = bad_paths.withColumnRenamed("path", "xpath")
    field_rows = _rows(
        fields.join(field_bad, "xpath", "left"),
        [
            ("V17", F.col("field").isNull(), F.lit("field.name")),
            ("V17", path.isNull(), F.lit("field.xpath")),
            ("V15", F.col("bad_path"), path),
            ("V1", F.col("field").isNotNull() & _blank(F.col("field")), F.lit("field.name")),
            ("V2", path.isNotNull() & _blank(path), F.lit("field.xpath")),
        ],
        [F.lit(_STEPS), at, F.lit(1), F.col("field_ord")],
        step=step,
        field=F.col("field"),
    )

    selectors = F.size(
        F.array_compact(F.array("xpath", "css", F.col("index").cast("string"), "name"))
    )
    frame_rows = _rows(
        frames,
        [
            ("V5", selectors == 0, F.lit("no selector")),
            ("V6", selectors > 1, selectors),
            ("V7", (selectors == 1) & (F.col("index") < 0), F.col("index")),
            (
                "C1",
                (selectors == 1) & F.col("css").isNotNull() & ~_simple_css(F.col("css")),
                F.col("css"),
            ),
        ],
        [F.lit(_STEPS), at, F.lit(2), F.col("frame_ord")],
        step=step,
    )

    same_field = _rows(
        _duplicates(fields, ["spec_id", "site", "step_ord", "step"], "field"),
        [("V10", F.lit(True), F.col("copies"))],
        [F.lit(_STEPS), at, F.lit(4), F.lit(0)],
        step=step,
        field=F.col("field"),
    )
    same_step = _rows(
        _duplicates(steps, ["spec_id", "site"], "step"),
        [("V12", F.lit(True), F.col("copies"))],
        [F.lit(_AFTER), F.lit(1), F.lit(0), F.lit(0)],
        step=step,
    )
    # counts combine map-side; every site of a shared name gets its violation
    repeated = sites.groupBy("site").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    repeated = sites.select("spec_id", "site").join(repeated, "site")
    same_site = _rows(
        repeated,
        [("V12", F.lit(True), F.col("copies"))],
        [F.lit(_ACROSS), F.lit(0), F.lit(0), F.lit(0)],
    )
    parts = [site_before, step_before, field_rows, frame_rows, step_after, same_field, site_after, same_step, artifact, same_site]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _simple_css(css: Column) -> Column:
    """Within the subset that frame selectors are translated from (an added rule of ours)."""
    part = r"(?:[.#][\w-]+|\[\s*[\w-]+\s*(?:[~|^$*]?=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])"
    simple = rf"(?:(?:\*|[\w-]+){part}*|{part}+)"
    return css.rlike(rf"^\s*{simple}(?:\s*[\s>,]\s*{simple})*\s*\z")


def document_violations(documents: DataFrame) -> DataFrame:
    """V19: the document has a ``sites`` list."""
    return documents.where(F.col("kind") != "list").select(F.lit("V19").alias("rule"), "source", F.col("kind").alias("detail"))


def first_violations(found: DataFrame) -> DataFrame:
    """Per spec, the violation a sequential reader meets first."""
    return (
        found.groupBy("spec_id")
        .agg(F.min_by(F.struct("rule", "site", "step", "field", "detail"), F.struct("seq", "detail")).alias("v"))
        .select("spec_id", "v.*")
    )


def clean(specs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Spec rows without any violation of their own."""
    broken = (violations(specs) if found is None else found).select("spec_id").distinct()
    return specs.join(broken, "spec_id", "left_anti")


def rollup(specs: DataFrame) -> DataFrame:
    """Per spec: number of steps and fields, and whether login and frames are used."""
    return specs.select(
        "spec_id",
        F.col("name").alias("site"),
        F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("total_steps"),
        F.coalesce(
            F.aggregate("steps", F.lit(0), lambda acc, s: acc + F.coalesce(F.size(s["fields"]), F.lit(0))), F.lit(0)
        )
        .cast("long")
        .alias("total_fields"),
        (F.col("login").isNotNull() if "login" in specs.columns else F.lit(False)).alias("has_login"),
        F.coalesce(F.exists("steps", lambda s: F.coalesce(F.size(s["frames"]), F.lit(0)) > 0), F.lit(False)).alias(
            "has_frames"
        ),
    )
