"""Pages joined with specs: the core extraction job.

Two ways to pair them:

* ``by_target``: each step names a URL (its own, or the one the site is still on) and is
  joined to the newest capture of that URL;
* ``by_page``: every page is read with all steps of the site it belongs to.

Both produce *visits*: one row per document with the steps to answer on it. A page meets
its visits as a list and is repaired once for all of them; the selectors of a visit run as a
few constant XPath calls on the JVM, and the outcome of every step is computed inside the row
with array functions. In ``by_page``
mode nothing is shuffled between the scan and the finished record, so the same plan
serves a stream.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gleanery.functions import urls, xpath as xp
from gleanery.functions.html import repair, with_document
from gleanery.session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, broadcast_if_small, durable, shared_dir
from gleanery.sources import pages as page_source
from gleanery.sources.specs import (
    DEFAULT_FRAME_EXIT,
    DEFAULT_WAIT_TIMEOUT_SEC,
    frame_kind,
    frame_value,
)

# Error classes and message formats of a failed step.
BLANK_URL = "about:blank"
MSG_FIELD = "Field '%s' extraction failed"
MSG_NOT_VISIBLE = "Element not visible: %s (URL: %s)"
MSG_REPEATED = "Name used more than once: %s"
MSG_URL = "URL does not contain '%s' (current: %s)"
MSG_FRAME = "Failed to switch to frame: %s"
MSG_EMPTY = "URL cannot be empty"
MSG_BLANK = "URL is empty after stripping whitespace"
MSG_NO_SCHEME = "URL must have scheme (http/https): %s"
MSG_BAD_SCHEME = "URL scheme must be http or https, got: %s"
MSG_INVALID_HOST = "Invalid IPv6 URL"
MSG_BAD_BASE = "Cannot make absolute URL: relative URL '%s' but invalid base_url '%s'"
# our own, for what only a capture can report
MSG_NOT_CAPTURED = "Page not captured: %s"
MSG_UNSUPPORTED = "Step '%s' needs %s, which a captured page cannot answer"

TEMPLATES_PER_PASS = 100

_ERROR = (
    "struct<type:string,message:string,"
    "context:struct<step:string,field:string,frame:string,xpath:string,url:string>,timeout_sec:int>"
)
_VALUE = "array<struct<status:string,value:string>>"
_BLANK_PAGE = "<html><body></body></html>"


def _truthy(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _with_target(df: DataFrame, url: str, base: str, direct: Column) -> DataFrame:
    """Adds ``target`` and ``target_error``: the canonical URL, or the message of its rejection.

    A ``direct`` URL (the base page itself) is canonicalised without the joining rules.
    """
    u, b = F.col(url), F.col(base)
    joined = F.col("_joined")
    cleaned = urls.cleaned(joined)
    message = (
        F.when(u.isNull(), F.lit(None).cast("string"))
        .when(joined.isNull() & (urls.strip(u) == ""), MSG_EMPTY)
        .when(joined.isNull(), F.format_string(MSG_BAD_BASE, urls.strip(u), b))
        .when(F.col("_reason") == "blank", MSG_BLANK)
        .when(F.col("_reason") == "no_scheme", F.format_string(MSG_NO_SCHEME, cleaned))
        .when(
            F.col("_reason") == "bad_scheme",
            F.format_string(MSG_BAD_SCHEME, F.lower(F.substring_index(cleaned, ":", 1))),
        )
        .when(F.col("_reason") == "invalid_host", MSG_INVALID_HOST)
    )
    return (
        df.withColumn("_joined", F.when(direct | urls.is_absolute(u), u).otherwise(urls.make_absolute(u, b)))
        .withColumn("target", urls.normalize("_joined"))
        .withColumn("_reason", urls.url_error("_joined"))
        .withColumn("target_error", message)
        .drop("_joined", "_reason")
    )


# --- steps and their targets -------------------------------------------------------------


def _frames_of(step: Column) -> Column:
    return F.coalesce(
        F.transform(
            step["frames"],
            lambda f: F.struct(frame_kind(f).alias("kind"), frame_value(f).alias("value")),
        ),
        F.array().cast("array<struct<kind:string,value:string>>"),
    )


def _step_rows(specs: DataFrame) -> DataFrame:
    timeout = "wait_timeout_sec"
    wait = F.col(timeout)
    if dict(specs.dtypes).get(timeout) == "variant":
        wait = F.try_variant_get(wait, "$", "int")
    rows = specs.select(
        "spec_id",
        F.col("name").alias("site"),
        F.coalesce("base_url", F.lit("")).alias("base_url"),
        F.coalesce(wait.cast("int"), F.lit(DEFAULT_WAIT_TIMEOUT_SEC)).alias("timeout_sec"),
        "steps",
        F.posexplode("steps").alias("pos", "s"),
    )
    before = F.slice("steps", 1, F.col("pos") + 1)
    gotos = F.filter(before, lambda s: _truthy(s["goto_url"]))
    goto = F.try_element_at(gotos, F.lit(-1))["goto_url"]
    # position (1-based) from which frames entered earlier can still be open
    since_goto = F.array_max(
        F.transform(before, lambda s, i: F.when(_truthy(s["goto_url"]), i + 1).otherwise(F.lit(1)))
    )
    since_exit = F.coalesce(
        F.array_max(
            F.transform(
                F.slice("steps", 1, F.col("pos")),
                lambda s, i: F.when(
                    (F.coalesce(F.size(s["frames"]), F.lit(0)) > 0)
                    & (F.coalesce(s["frame_exit"], F.lit(DEFAULT_FRAME_EXIT)) != "parent"),
                    i + 2,
                ).otherwise(F.lit(1)),
            )
        ),
        F.lit(1),
    )
    start = F.greatest(since_goto, since_exit)
    open_steps = F.when(
        F.col("pos") + 1 > start, F.slice("steps", start, F.col("pos") + 1 - start)
    ).otherwise(F.slice("steps", 1, 0))
    still_open = F.flatten(
        F.transform(
            F.filter(open_steps, lambda s: F.coalesce(F.size(s["frames"]), F.lit(0)) > 0),
            lambda s: F.slice(_frames_of(s), 1, F.size(s["frames"]) - 1),
        )
    )
    return rows.withColumn("goto", goto).withColumn("chain", F.concat(still_open, _frames_of(F.col("s"))))


_STEP_FIELDS = (
    "step_ord step is_base target_error frame_desc unsupported wait_xpath wait_url_contains timeout_sec fields"
).split()


def _planned(rows: DataFrame) -> DataFrame:
    """Step rows with the struct that evaluation needs."""
    s = F.col("s")
    fields = F.coalesce(
        F.transform(
            s["fields"],
            lambda f, i: F.struct(
                (i + 1).alias("field_ord"),
                f["name"].alias("field"),
                f["xpath"].alias("xpath"),
                F.coalesce(f["attribute"], F.lit("")).alias("attribute"),
            ),
        ),
        F.array().cast("array<struct<field_ord:int,field:string,xpath:string,attribute:string>>"),
    )
    return rows.select(
        "spec_id",
        "site",
        (F.col("pos") + 1).alias("step_ord"),
        s["name"].alias("step"),
        F.lit(False).alias("is_base"),
        "target",
        "target_error",
        "chain",
        F.when(_truthy(s["execute_js"]), "execute_js").when(_truthy(s["click_xpath"]), "click_xpath").alias("unsupported"),
        F.when(_truthy(s["wait_xpath"]), s["wait_xpath"]).alias("wait_xpath"),
        F.when(_truthy(s["wait_url_contains"]), s["wait_url_contains"]).alias("wait_url_contains"),
        "timeout_sec",
        fields.alias("fields"),
    )


def step_targets(specs: DataFrame) -> DataFrame:
    """One row per step, plus the base page as step 0, with the URL it reads.

    A step without its own URL stays on the last one visited; relative URLs are joined to
    the base. ``target`` is null on a blank page or when ``target_error`` says why.
    ``chain`` lists the frames to enter, including those an earlier step left open.
    """
    # a step without any URL so far stays on the base page, or on a blank one
    rows = (
        _step_rows(specs)
        .withColumn("on_base", F.col("goto").isNull())
        .withColumn("goto", F.coalesce("goto", F.when(F.col("base_url") != "", F.col("base_url"))))
    )
    own = _planned(_with_target(rows, "goto", "base_url", F.col("on_base")))
    with_base = _with_target(specs.where(_truthy(F.col("base_url"))), "base_url", "base_url", F.lit(True))
    base_rows = with_base.select(
        "spec_id",
        F.col("name").alias("site"),
        F.lit(0).alias("step_ord"),
        F.lit(None).cast("string").alias("step"),
        F.lit(True).alias("is_base"),
        "target",
        "target_error",
    )
    return own.unionByName(base_rows, allowMissingColumns=True)


def _visit_steps() -> Column:
    return F.array_sort(F.collect_list(F.struct(*_STEP_FIELDS)))


_NO_FIELDS = "array<struct<field_ord:int,field:string,xpath:string,attribute:string>>"
_NO_CHAIN = "array<struct<kind:string,value:string>>"


def visits_by_target(specs: DataFrame) -> DataFrame:
    """One row per (spec, URL, frame chain) with the steps answered there."""
    targets = (
        step_targets(specs)
        .withColumn("fields", F.coalesce("fields", F.array().cast(_NO_FIELDS)))
        .withColumn("chain", F.coalesce("chain", F.array().cast(_NO_CHAIN)))
        .withColumn("frame_desc", F.lit(None).cast("string"))
    )
    return targets.groupBy("spec_id", "site", F.col("target").alias("norm_url"), "chain").agg(
        _visit_steps().alias("steps")
    )


def visits_by_page(specs: DataFrame) -> DataFrame:
    """Per spec: one row per frame chain with the steps read on whatever page is given."""
    rows = _step_rows(specs).withColumn("target", F.lit(None).cast("string"))
    steps = _planned(rows.withColumn("target_error", F.lit(None).cast("string")))
    return (
        steps.withColumn("frame_desc", F.lit(None).cast("string"))
        .groupBy("spec_id", "site", "chain")
        .agg(_visit_steps().alias("steps"))
    )


# --- page lookup -------------------------------------------------------------------------


def lookup(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets with the newest capture of their URL: ``page_id`` is null where there is none.

    Only keys are joined; bodies are fetched later by ``page_id``.
    """
    wanted = targets.where(F.col("target").isNotNull()).select(F.col("target").alias("norm_url"))
    ids = page_source.latest_ids(pages, wanted).select(F.col("norm_url").alias("target"), "page_id")
    status = (
        F.when(F.col("target_error").isNotNull(), "url_error")
        .when(F.col("target").isNull(), "blank")
        .when(F.col("page_id").isNull(), "not_captured")
        .otherwise("ok")
    )
    return targets.join(ids, "target", "left").withColumn("lookup", status)


# --- evaluation --------------------------------------------------------------------------


def _probes_of(steps: Column) -> Column:
    def of_step(s: Column) -> Column:
        fields = F.transform(
            s["fields"], lambda f: F.struct(f["xpath"].alias("xpath"), f["attribute"].alias("attribute"))
        )
        wait = F.when(
            s["wait_xpath"].isNotNull(),
            F.array(F.struct(s["wait_xpath"].alias("xpath"), F.lit("").alias("attribute"))),
        ).otherwise(F.array().cast("array<struct<xpath:string,attribute:string>>"))
        return F.concat(wait, fields)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(steps, of_step))))


class Compiled(NamedTuple):
    """Visits with the distinct selector lists they need, and what decides the plan's shape."""

    visits: DataFrame
    templates: dict[int, list[xp.Probe]]
    framed: bool
    flat: bool
    small: bool

    def for_join(self, side: DataFrame) -> DataFrame:
        return F.broadcast(side) if self.small else side


def compile_visits(visits: DataFrame) -> Compiled:
    """Tag each visit with the list of selectors it needs.

    Sites share few distinct lists; each becomes part of the plan, which reads the rows in
    several passes when there are many. The same aggregation measures the visits, so a
    broadcast is hinted only within bounds.
    """
    tagged = (
        visits.withColumn("probes", _probes_of(F.col("steps")))
        .withColumn("template", F.xxhash64(F.to_json("probes")))
        .persist()
    )
    lists = (
        tagged.groupBy("template")
        .agg(
            F.any_value("probes").alias("probes"),
            F.max(F.size("chain")).alias("depth"),
            F.count_if(F.size("chain") == 0).alias("flat"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length(F.to_json(F.struct("steps", "probes")))).alias("size"),
        )
        .collect()
    )
    templates = {row["template"]: [xp.Probe(p["xpath"], p["attribute"]) for p in row["probes"]] for row in lists}
    return Compiled(
        tagged,
        templates,
        framed=any(row["depth"] for row in lists),
        flat=any(row["flat"] for row in lists),
        small=sum(row["n"] for row in lists) <= BROADCAST_MAX_ROWS
        and sum(row["size"] for row in lists) <= BROADCAST_MAX_BYTES,
    )


def _computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of repeating its expression.

    The optimizer pushes predicates through projections by copying their expressions, which would
    run the selectors again for every reference; it does not push them through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _values(df: DataFrame, templates: dict[int, list[xp.Probe]], document: str, page_url: str) -> DataFrame:
    """Adds ``found``: status and value per selector of the row's template."""
    spark = df.sparkSession
    answers, found = None, None
    for template, probes in sorted(templates.items()):
        if not probes:
            continue
        raw = F.col("raw_document") if "raw_document" in df.columns else None
        read, shaped = xp.evaluate(spark, F.col(document), F.col("answers"), F.col(page_url), probes, raw)
        mine = F.col("template") == F.lit(template)
        answers = F.when(mine, read) if answers is None else answers.when(mine, read)
        found = F.when(mine, shaped) if found is None else found.when(mine, shaped)
    if answers is None:
        return df.withColumn("found", F.array().cast(_VALUE))
    return _computed_once(df, "answers", answers).withColumn("found", found).drop("answers")


def _error(
    kind: str | Column,
    message: Column,
    step: Column | None = None,
    field: Column | None = None,
    frame: Column | None = None,
    path: Column | None = None,
    url: Column | None = None,
    timeout: Column | None = None,
) -> Column:
    def text(value: Column | None) -> Column:
        return (F.lit(None) if value is None else value).cast("string")

    members = [text(step), text(field), text(frame), text(path), text(url)]
    named = [m.alias(n) for m, n in zip(members, ("step", "field", "frame", "xpath", "url"))]
    context = (
        F.struct(*named)
        if any(v is not None for v in (step, field, frame, path, url))
        else F.lit(None)
    )
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        message.alias("message"),
        context.cast("struct<step:string,field:string,frame:string,xpath:string,url:string>").alias("context"),
        (F.lit(None) if timeout is None else timeout).cast("int").alias("timeout_sec"),
    ).cast(_ERROR)


def _outcome(s: Column, row_url: Column, nav: Column, visibility: str, unsupported: str) -> Column:
    """Step struct -> step outcome struct; phases are tried in their fixed order."""

    def answer(path: Column, attribute: Column) -> Column:
        key = F.struct(path.alias("xpath"), attribute.alias("attribute"))
        return F.get(F.col("found"), F.array_position(F.col("probes"), key).cast("int") - 1)

    def shown(status: Column) -> Column:
        return status == "found" if visibility == "approx" else status.isin("found", "hidden")

    def read(f: Column) -> Column:
        got = answer(f["xpath"], f["attribute"])
        return F.struct(
            f["field_ord"].alias("field_ord"),
            f["field"].alias("field"),
            f["xpath"].alias("xpath"),
            F.coalesce(got["status"], F.lit("missing")).alias("status"),
            F.when(shown(got["status"]), got["value"]).otherwise("").alias("value"),
        )

    fields = F.transform(s["fields"], read)
    failed_fields = F.filter(fields, lambda f: ~shown(f["status"]))
    first_bad = F.get(failed_fields, F.lit(0))
    wait_status = F.coalesce(answer(s["wait_xpath"], F.lit(""))["status"], F.lit("missing"))
    error = (
        F.when(s["target_error"].isNotNull(), _error("ValueError", s["target_error"]))
        .when(nav.isNotNull(), _error("NavigationError", nav, url=row_url))
        .when(
            s["frame_desc"].isNotNull(),
            _error(
                "FrameError",
                F.format_string(MSG_FRAME, s["frame_desc"]),
                frame=s["frame_desc"],
                url=row_url,
            ),
        )
        .when(
            s["unsupported"].isNotNull() & F.lit(unsupported == "fail"),
            _error("UnsupportedAction", F.format_string(MSG_UNSUPPORTED, s["step"], s["unsupported"]), step=s["step"]),
        )
        .when(
            s["wait_xpath"].isNotNull() & ~shown(wait_status),
            _error("ElementNotFoundError", F.format_string(MSG_NOT_VISIBLE, s["wait_xpath"], row_url)),
        )
        .when(
            s["wait_url_contains"].isNotNull() & ~F.contains(row_url, s["wait_url_contains"]),
            _error(
                "TimeoutError",
                F.format_string(MSG_URL, s["wait_url_contains"], row_url),
                timeout=s["timeout_sec"],
            ),
        )
        .when(
            first_bad.isNotNull(),
            _error(
                "ExtractionError",
                F.format_string(MSG_FIELD, first_bad["field"]),
                step=s["step"],
                field=first_bad["field"],
                path=first_bad["xpath"],
            ),
        )
    )
    return F.struct(
        s["step_ord"].alias("step_ord"),
        s["step"].alias("step"),
        s["is_base"].alias("is_base"),
        row_url.alias("url"),
        F.when(s["unsupported"].isNotNull(), "unsupported")
        .when(error.isNull(), "success")
        .otherwise("failure")
        .alias("status"),
        error.alias("error"),
        fields.alias("fields"),
        F.coalesce(F.col("cut"), F.lit(False)).alias("cut"),
    )


def _reads_raw(templates: dict[int, list[xp.Probe]]) -> bool:
    return any(xp._reads_raw_text(probe) for probes in templates.values() for probe in probes)


def _dealt(rows: DataFrame, parts: list[list[int]]) -> list[DataFrame]:
    """The rows of each part of the templates.

    Rows with their documents are written once, dealt by part, and every part reads its own; on a stream, which
    cannot be written here, each part filters.
    """
    if rows.isStreaming:
        return [rows.where(F.col("template").isin(part)) for part in parts]
    spark = rows.sparkSession
    known = spark.createDataFrame([(name, n) for n, part in enumerate(parts) for name in part], "template bigint, part int")
    folder = f"{shared_dir(spark)}/documents-{uuid4().hex}"
    rows.join(broadcast_if_small(known), "template").write.partitionBy("part").parquet(folder)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])
    return [spark.read.schema(schema).parquet(folder).where(F.col("part") == n).drop("part") for n in range(len(parts))]


def _evaluate(
    rows: DataFrame,
    templates: dict[int, list[xp.Probe]],
    keys: list[str],
    visibility: str,
    unsupported: str,
) -> DataFrame:
    """Rows ``(keys, visit_url, doc_url, html, nav_error, steps, probes, template)`` -> outcomes per visit."""
    names = sorted(templates)
    if len(names) > TEMPLATES_PER_PASS:
        parts = [names[n : n + TEMPLATES_PER_PASS] for n in range(0, len(names), TEMPLATES_PER_PASS)]
        answered = [
            _evaluate(mine, {name: templates[name] for name in part}, keys, visibility, unsupported)
            for part, mine in zip(parts, _dealt(rows, parts), strict=True)
        ]
        return reduce(DataFrame.unionByName, answered)
    if "document" not in rows.columns:
        rows = with_document(rows, _reads_raw(templates))
    valued = _values(rows, templates, "document", "doc_url")
    outcomes = F.transform(
        "steps", lambda s: _outcome(s, F.col("visit_url"), F.col("nav_error"), visibility, unsupported)
    )
    return _computed_once(valued, "outcomes", outcomes).select(*keys, "outcomes")


def _frame_selectors(visits: DataFrame) -> list[list[tuple[str, str]]]:
    """Distinct frame selectors per depth; configuration that becomes part of the plan."""
    rows = visits.select(F.posexplode("chain").alias("level", "f")).select("level", "f.kind", "f.value").distinct().collect()
    levels: list[list[tuple[str, str]]] = [[] for _ in range(1 + max((r["level"] for r in rows), default=-1))]
    for row in rows:
        levels[row["level"]].append((row["kind"], row["value"]))
    return levels


def _descend(rows: DataFrame, visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Replace each row's document by the frame its chain points to, one depth at a time.

    A frame that cannot be entered keeps the row, with ``frame_desc`` set on its steps. Each
    depth is written out once, so that only the pages it links to have to be fetched. The rows bring the
    document of their page along; below it, a page is read into one only where a chain goes on.
    """
    if rows.isStreaming:
        raise ValueError("frames are looked up among captured pages: use a batch of pages")
    spark = rows.sparkSession
    current = rows.withColumn("frame_failed", F.lit(None).cast("string"))
    for level, selectors in enumerate(_frame_selectors(visits)):
        here = F.get(F.col("chain"), F.lit(level))
        wants = F.coalesce((F.size("chain") > level) & F.col("frame_failed").isNull(), F.lit(False))
        answers = found = F.lit(None)
        for kind, value in selectors:
            path = xp.of_frame(kind, value)
            if path is None or xp.not_elements(spark, [path]):
                continue
            probes = [xp.Probe(path, "srcdoc"), xp.Probe(path, "src")]
            read, shaped = xp.evaluate(spark, F.col("document"), F.col("frame_answers"), F.col("doc_url"), probes)
            mine = wants & (here["kind"] == kind) & (here["value"] == value)
            answers = F.when(mine, read).otherwise(answers)
            found = F.when(mine, shaped).otherwise(found)
        opened = current.withColumn("document", repair(F.when(wants, F.col("html")))) if level else current
        located = _computed_once(opened, "frame_answers", answers.cast("array<string>")).withColumn("frame", found.cast(_VALUE))
        present = F.coalesce(F.col("frame")[0]["status"] != "missing", F.lit(False))
        srcdoc = F.when(present & (F.col("frame")[0]["value"] != ""), F.col("frame")[0]["value"])
        entry = _computed_once(
            located,
            "entry",
            F.struct(
                wants.alias("wants"),
                srcdoc.alias("srcdoc"),
                F.when(present & srcdoc.isNull(), urls.normalize(F.col("frame")[1]["value"])).alias("src"),
                F.concat_ws("=", here["kind"], here["value"]).alias("desc"),
            ),
        )
        # only a linked frame needs another page; other rows get a key that matches nothing but
        # spreads them, and a body is carried only where it is still the row's document
        keyed = entry.select(
            *[c for c in current.columns if c not in ("html", "document")],
            "entry",
            F.when(~F.col("entry.wants"), F.col("html")).otherwise(F.col("entry.srcdoc")).alias("own_html"),
            F.coalesce("entry.src", F.concat(F.lit("!"), F.xxhash64("visit_url", "template").cast("string"))).alias("src_key"),
        )
        keyed = durable(keyed)
        linked = keyed.where(F.col("entry.src").isNotNull()).select(F.col("entry.src").alias("norm_url"))
        frames = page_source.latest(pages, linked).select(
            F.col("norm_url").alias("src_key"), F.col("html").alias("src_html")
        )
        joined = keyed.join(frames, "src_key", "left")
        html = F.coalesce("own_html", "src_html")
        kept = [c for c in current.columns if c not in ("html", "document", "doc_url", "frame_failed")]
        current = joined.select(
            *kept,
            F.when(F.col("own_html").isNull() & F.col("src_html").isNotNull(), F.col("entry.src"))
            .otherwise(F.col("doc_url"))
            .alias("doc_url"),
            F.when(F.col("entry.wants") & html.isNull(), F.col("entry.desc"))
            .otherwise(F.col("frame_failed"))
            .alias("frame_failed"),
            F.coalesce(html, F.lit(_BLANK_PAGE)).alias("html"),
        )
    return current.withColumn(
        "steps", F.transform("steps", lambda s: s.withField("frame_desc", F.col("frame_failed")))
    ).drop("frame_failed")


def _with_frames(rows: DataFrame, compiled: Compiled, pages: DataFrame) -> DataFrame:
    """Enter frames only for the visits that have any; the others keep the document their page was read into."""
    if not compiled.framed:
        return rows.drop("chain")
    read = [c for c in ("document", "raw_document", "cut") if c in rows.columns]
    chained = rows.where(F.size("chain") > 0).drop(*(c for c in read if c != "document"))
    framed = with_document(_descend(chained, compiled.visits, pages).drop("chain"), "raw_document" in read)
    if not compiled.flat:  # nothing would come of a second reading of all pages
        return framed
    return rows.where(F.size("chain") == 0).drop("chain").unionByName(framed)


def _first_frame() -> Column:
    """What a page without any frame fails to offer; null for steps that enter none."""
    first = F.get(F.col("chain"), F.lit(0))
    return F.when(first.isNotNull(), F.concat_ws("=", first["kind"], first["value"]))


_RUN_KEYS = ["spec_id", "site"]
_PAGE_KEYS = ["spec_id", "site", "page_id"]
_VISIT = ["spec_id", "site", "steps", "probes", "template", "chain"]
# visits that a page carries at a time: with more, it is read into a document once more
VISITS_PER_READ = 256


def outcomes_by_target(
    pages: DataFrame,
    specs: DataFrame,
    visibility: str = "approx",
    unsupported: str = "fail",
) -> DataFrame:
    """``(spec_id, site, outcomes)``: every step of every site, answered on the capture it targets."""
    compiled = compile_visits(visits_by_target(specs))
    visits = compiled.visits
    wanted = visits.where(F.col("norm_url").isNotNull()).select("norm_url").distinct()
    # keys are paired first; page bodies are then read once, by id, and never leave their side
    # of a broadcast; visits without a capture need no body at all
    paired = visits.join(page_source.latest_ids(pages, wanted), "norm_url", "left").persist()
    found = paired.where(F.col("page_id").isNotNull())
    keys = page_source.capture_keys(pages)
    listed = compiled.for_join(_bundled(found.withColumnRenamed("norm_url", "visit_url"), [*keys, "visit_url"]))
    rows = _read_once(page_source.on_captures(pages.select(*keys, "html"), listed, keys), compiled, [])
    answered = _evaluate(
        _with_frames(rows, compiled, pages), compiled.templates, _RUN_KEYS, visibility, unsupported
    )
    absent = paired.where(F.col("page_id").isNull()).select(
        *_RUN_KEYS,
        F.coalesce("norm_url", F.lit(BLANK_URL)).alias("visit_url"),
        F.when(F.col("norm_url").isNotNull(), F.format_string(MSG_NOT_CAPTURED, F.col("norm_url"))).alias("nav_error"),
        F.transform("steps", lambda s: s.withField("frame_desc", _first_frame())).alias("steps"),
        "probes",
        F.array().cast(_VALUE).alias("found"),
        F.lit(False).alias("cut"),
    )
    empty = absent.select(
        *_RUN_KEYS,
        F.transform(
            "steps", lambda s: _outcome(s, F.col("visit_url"), F.col("nav_error"), visibility, unsupported)
        ).alias("outcomes"),
    )
    return (
        answered.unionByName(empty)
        .groupBy(*_RUN_KEYS)
        .agg(F.array_sort(F.flatten(F.collect_list("outcomes")), _by_step).alias("outcomes"))
    )


def _bundled(visits: DataFrame, by: list[str]) -> DataFrame:
    """The visits of a page, or of a join key, as lists of at most ``VISITS_PER_READ``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("spec_id", "template"))
    dealt = visits.withColumn("bundle", place).withColumn("bundle", F.expr(f"(bundle - 1) div {VISITS_PER_READ}"))
    return dealt.groupBy(*by, "bundle").agg(F.collect_list(F.struct(*_VISIT)).alias("visits")).drop("bundle")


def _read_once(paired: DataFrame, compiled: Compiled, keys: list[str]) -> DataFrame:
    """Pages with their lists of visits -> one row per visit: a page is read into a document before it meets them."""
    read = with_document(paired, _reads_raw(compiled.templates))
    kept = [c for c in ("document", "raw_document", "cut") if c in read.columns] + (["html"] if compiled.framed else [])
    return read.select(*keys, "visit_url", *kept, F.inline("visits")).select(
        *keys,
        "spec_id",
        "site",
        "visit_url",
        F.col("visit_url").alias("doc_url"),
        *kept,
        F.lit(None).cast("string").alias("nav_error"),
        "steps",
        "probes",
        "template",
        "chain",
    )


def _by_step(a: Column, b: Column) -> Column:
    return (a["step_ord"] - b["step_ord"]).cast("int")


def outcomes_by_page(
    pages: DataFrame,
    specs: DataFrame,
    visibility: str = "approx",
    unsupported: str = "fail",
    page_site: Column | None = None,
) -> DataFrame:
    """``(spec_id, site, page_id, outcomes)``: every page read with all steps of its site.

    A page belongs to the site whose base URL has the same host, or to the site named by
    ``page_site``. Without frames the plan has no shuffle after the scan, and ``pages`` may
    be a stream.
    """
    compiled = compile_visits(visits_by_page(specs))
    visits = compiled.visits
    if page_site is None:
        hosts = specs.select("spec_id", urls.host("base_url").alias("join_key"))
        visits = visits.join(hosts, "spec_id")
        key = urls.host("url")
    else:
        visits = visits.withColumn("join_key", F.col("site"))
        key = page_site
    if compiled.small:
        attached = F.broadcast(_bundled(visits, ["join_key"]))
        paired = pages.select("page_id", "url", "html", key.alias("join_key")).join(attached, "join_key")
    else:
        # keys are paired first, so that the bodies of a busy host are dealt by their own ids
        ids = page_source.capture_keys(pages)
        wanted = pages.select(*ids, key.alias("join_key")).join(visits, "join_key")
        paired = page_source.on_captures(pages.select(*ids, "url", "html"), _bundled(wanted, ids), ids)
    paired = paired.withColumn("visit_url", F.coalesce(urls.normalize("url"), F.col("url")))
    rows = _read_once(paired, compiled, ["page_id"])
    source = _with_frames(rows, compiled, pages)
    answered = _evaluate(source, compiled.templates, _PAGE_KEYS, visibility, unsupported)
    if not compiled.framed:
        return answered
    return answered.groupBy(*_PAGE_KEYS).agg(
        F.array_sort(F.flatten(F.collect_list("outcomes")), _by_step).alias("outcomes")
    )


# --- shapes of the result ----------------------------------------------------------------


def _keys(outcomes: DataFrame) -> list[str]:
    return [c for c in outcomes.columns if c != "outcomes"]


def _first_error(outcomes: Column) -> Column:
    return F.get(F.filter(outcomes, lambda o: o["error"].isNotNull()), F.lit(0))


def long(outcomes: DataFrame) -> DataFrame:
    """One row per field: status and value."""
    keys = _keys(outcomes)
    return (
        outcomes.select(*keys, F.explode("outcomes").alias("o"))
        .select(*keys, "o.step_ord", "o.step", "o.url", F.explode("o.fields").alias("f"))
        .select(*keys, "step_ord", "step", "url", "f.*")
    )


def steps(outcomes: DataFrame) -> DataFrame:
    """One row per step: success, failure or unsupported, with its error.

    ``reached`` is false after the first failing step, which a sequential run never starts;
    ``cut`` says that something is missing from the document the step was read from.
    """
    keys = _keys(outcomes)
    bad = _first_error(F.col("outcomes"))["step_ord"]
    return outcomes.select(*keys, bad.alias("failed_at"), F.explode("outcomes").alias("o")).select(
        *keys,
        "o.step_ord",
        "o.step",
        "o.is_base",
        "o.url",
        "o.status",
        "o.error",
        "o.cut",
        (F.col("failed_at").isNull() | (F.col("o.step_ord") <= F.col("failed_at"))).alias("reached"),
    )


def _repeated_name(outcomes: Column) -> Column:
    """A step name that two steps of a site share, or a field name that two fields of a step share."""

    def twice(names: Column) -> Column:
        return F.get(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1), F.lit(0))

    own = F.filter(outcomes, lambda o: ~o["is_base"])
    fields = F.transform(own, lambda o: twice(F.transform(o["fields"], lambda f: f["field"])))
    return F.coalesce(twice(F.transform(own, lambda o: o["step"])), F.get(F.array_compact(fields), F.lit(0)))


def _data(outcomes: Column) -> Column:
    own = F.filter(outcomes, lambda o: ~o["is_base"])
    return F.map_from_entries(
        F.transform(
            own,
            lambda o: F.struct(
                o["step"].alias("step"),
                F.map_from_entries(
                    F.transform(o["fields"], lambda f: F.struct(f["field"].alias("k"), f["value"].alias("v")))
                ).alias("data"),
            ),
        )
    )


def results(outcomes: DataFrame, mode: str = "run") -> DataFrame:
    """Records per site (and page).

    ``run``: ``data`` for a site whose steps all passed, else only ``error`` (fail-fast:
    the first failing step in order decides, earlier data is dropped).
    ``stream``: one row per step completed before the first failure.
    A spec that names two of its steps, or two fields of a step, alike has no results: ``run``
    gives it a ValueError, ``stream`` no rows.
    """
    keys = _keys(outcomes)
    outcomes = _computed_once(outcomes, "repeated", _repeated_name(F.col("outcomes")))
    failed = _first_error(F.col("outcomes"))
    unusable = F.col("repeated").isNotNull()
    if mode == "run":
        return outcomes.select(
            *keys,
            F.when(failed.isNull() & ~unusable, _data(F.col("outcomes"))).alias("data"),
            F.when(unusable, _error("ValueError", F.format_string(MSG_REPEATED, F.col("repeated"))))
            .otherwise(failed["error"])
            .alias("error"),
            F.when(~unusable, failed["step_ord"]).alias("failed_step_ord"),
            F.when(~unusable, failed["step"]).alias("failed_step"),
        )
    done = F.filter(
        "outcomes",
        lambda o: ~o["is_base"] & (failed["step_ord"].isNull() | (o["step_ord"] < failed["step_ord"])),
    )
    none = F.slice("outcomes", 1, 0)
    return outcomes.select(*keys, F.explode(F.when(unusable, none).otherwise(done)).alias("o")).select(
        *keys,
        "o.step_ord",
        "o.step",
        F.map_from_entries(
            F.transform("o.fields", lambda f: F.struct(f["field"].alias("k"), f["value"].alias("v")))
        ).alias("data"),
    )


def records(outcomes: DataFrame) -> DataFrame:
    """``(site, data, error)``: successes and errors in one table, ready for a JSON sink."""
    run = results(outcomes, "run")
    return run.select(*[c for c in _keys(outcomes) if c != "spec_id"], "data", "error")


def checks(pages: DataFrame, probes: list[tuple[str, str]], page_url: str = "url") -> DataFrame:
    """Presence, visibility and clickability of selectors on every page.

    ``probes`` are ``(name, xpath)`` pairs. Clickable means visible and not disabled.
    """
    wanted = [xp.Probe(path, "disabled") for _, path in probes]
    names = F.array(*[F.lit(name) for name, _ in probes])
    template = {0: wanted}
    rows = pages.select("page_id", F.col(page_url).alias("doc_url"), repair("html").alias("document")).withColumn(
        "template", F.lit(0).cast("long")
    )
    valued = _values(rows, template, "document", "doc_url")
    return valued.select("page_id", F.posexplode(F.arrays_zip(names.alias("name"), F.col("found")))).select(
        "page_id",
        F.col("col.name").alias("name"),
        (F.col("col.found.status").isin("found", "hidden")).alias("present"),
        (F.col("col.found.status") == "found").alias("visible"),
        ((F.col("col.found.status") == "found") & (F.col("col.found.value") != "true")).alias("clickable"),
    )
