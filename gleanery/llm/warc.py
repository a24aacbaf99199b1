"""WARC archives: writing segmented, chunk-framed captures, and reading and reassembling them.

Writing: a payload is framed in HTTP chunks; a block longer than ``SEGMENT`` bytes is cut into a first record
and continuation records, each naming the first one's id and its number, the last one the total length. Of
payloads that occur more than once, only the capture with the smallest key is stored; the others are revisit
records that refer to it. Spark's text writer ends every record with the blank lines that the format asks for;
the files are gzip-compressed, so that one task reads a file in order.

Reading: files are cut where a record can begin, and a piece that is shorter than its Content-Length is joined
to the pieces after it, so that a payload may hold another archive. Whole records are decoded where they are
read. Only segments are shuffled: by origin id, one record's segments together, ordered by number, their total
length verified and the transfer framing decoded.

Defined results: a null payload is the empty one. Nulls in the key or the URL leave out their header; a null key
is greater than any other. Rows that repeat key and payload are one capture stored more than once: they share
a record id, and each comes back. ``status`` says what is wrong with a record (``ok`` if nothing), whose payload
is then null: ``bad_length``, ``bad_chunk``, ``missing_segment``, ``conflict`` (different blocks for one number).
A revisit whose response is not in the archive has the status ``dangling``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = "WARC/1.1"
SEGMENT = 16_384
CHUNK = 4_096
#: shorter payloads are always stored
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
_START = f"{_CRLF}{_CRLF}{VERSION}{_CRLF}"
_HTTP = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"


def _record_id(key: str, digest: str):
    """The same id for the same key and payload."""
    x = F.sha2(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("none")), F.col(digest)), 256)
    parts = [F.substring(x, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(key, url, body, digest, first): first is the key of the capture that a revisit refers to, else null.

    Who comes first is decided on (key, digest) alone; bodies move once, dealt by both.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body")
    ).withColumn("digest", F.sha2("body", 256))
    slim = rows.where(F.length("body") >= REVISIT_BYTES).select("key", "digest").distinct()
    firsts = slim.groupBy("digest").agg(F.min("key").alias("first"))
    later = (
        slim.join(firsts, "digest")
        .where(F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first"))))
        .select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), "first")
    )
    match = F.col("key").eqNullSafe(F.col("__key")) & (F.col("digest") == F.col("__digest"))
    return rows.join(later, match, "left").drop("__key", "__digest")


def records(rows: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """(value): the records of captures, without the blank lines that end them."""
    n = F.length("body")
    pieces = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(
            F.lower(F.hex(F.least(F.lit(chunk), n - i * chunk).cast("long"))),
            F.lit(_CRLF),
            F.substring(F.col("body"), i * chunk + 1, F.lit(chunk)).cast("string"),
            F.lit(_CRLF),
        ),
    )
    is_revisit = F.col("first").isNotNull()
    framed = F.concat(
        F.lit(f"{_HTTP}Transfer-Encoding: chunked{_CRLF}{_CRLF}"), F.array_join(pieces, ""), F.lit(f"0{_CRLF}{_CRLF}")
    )
    made = (
        rows.withColumn("id", _record_id("key", "digest"))
        .withColumn("block", F.when(is_revisit, F.lit(f"{_HTTP}{_CRLF}")).otherwise(framed).cast("binary"))
        .withColumn("size", F.length("block"))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("size") / segment)).cast("int"))
        .withColumn("number", F.explode(F.sequence(F.lit(1), F.col("parts"))))
        .withColumn("part", F.substring(F.col("block"), (F.col("number") - 1) * segment + 1, F.lit(segment)))
    )
    first_part, cut = F.col("number") == 1, F.col("parts") > 1
    header = lambda name, value, when=F.lit(True): F.when(when & value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))
    segment_id = F.concat(F.substring("id", 1, F.length("id") - 1), F.lit(";"), F.col("number").cast("string"), F.lit(">"))
    lines = F.concat_ws(
        _CRLF,
        F.lit(VERSION),
        header("WARC-Type", F.when(~first_part, F.lit("continuation")).when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.when(first_part, F.col("id")).otherwise(segment_id)),
        F.lit(f"WARC-Date: {DATE}"),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "")),
        header("X-Key", F.col("key")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), first_part),
        header("WARC-Profile", F.lit(REVISIT_PROFILE), is_revisit),
        header("WARC-Refers-To", _record_id("first", "digest"), is_revisit),
        header("WARC-Segment-Number", F.col("number"), cut),
        header("WARC-Segment-Origin-ID", F.col("id"), ~first_part),
        header("WARC-Segment-Total-Length", F.col("size"), cut & (F.col("number") == F.col("parts"))),
        header("Content-Type", F.lit("application/http; msgtype=response"), first_part),
        header("Content-Length", F.length("part")),
    )
    return made.select(F.concat(lines, F.lit(_CRLF + _CRLF), F.col("part").cast("string")).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """Write :func:`records` as gzip-compressed archives."""
    rows.write.mode("overwrite").option("lineSep", _CRLF + _CRLF).option("compression", "gzip").text(path)


def _dechunk(body: bytes) -> bytes | None:
    """The content of chunked framing; null if it does not end as it should."""
    found, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            return None
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(found)
        start = stop + 2
        if size < 0 or body[start + size : start + size + 2] != b"\r\n":
            return None
        found.append(body[start : start + size])
        at = start + size + 2


def payload(block: bytes) -> bytes | None:
    """The body of an HTTP response block; null where the framing is broken."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        return None
    names = _fields(head)
    return _dechunk(body) if "chunked" in names.get("transfer-encoding", "").lower() else body


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


_READ = (
    "id string, type string, uri string, key string, refers_to string, number int, origin string, total long, "
    "status string, bytes long, digest string, block binary"
)


def _row(fields: dict[str, str], block: bytes, length: int) -> tuple:
    kind = fields.get("warc-type", "")
    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    number = int(number) if number and number.isdigit() else None
    status, size, digest = "ok", None, None
    if len(block) < length:
        status = "bad_length"
    elif number is None and kind == "response":
        content = payload(block)
        if content is None:
            status = "bad_chunk"
        else:
            size, digest = len(content), hashlib.sha256(content).hexdigest()
    own = fields.get("warc-record-id")
    return (
        own, kind, fields.get("warc-target-uri"), fields.get("x-key"), fields.get("warc-refers-to"), number,
        (fields.get("warc-segment-origin-id") or own) if number is not None else None,
        int(total) if total and total.isdigit() else None, status, size, digest, block if number is not None else None,
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from pieces of archives in order: (path, value)."""
    names = [part.split()[0] for part in _READ.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in _READ.split(", ")])
    start = _START.encode()
    rows, held = [], 0

    def flush():
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema)

    path, fields, parts, have, length = None, None, [], 0, 0
    for batch in batches:
        for where, piece in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if fields is not None and (where != path or have >= length):
                rows.append(_row(fields, b"".join(parts)[:length], length))
                held += min(have, length)
                fields = None
            if fields is not None:  # the start of a record inside a payload
                parts += [start, piece]
                have += len(start) + len(piece)
                continue
            path = where
            piece = piece.removeprefix(start[4:])
            head, blank, rest = piece.partition(b"\r\n\r\n")
            if not blank and not head.strip():
                continue
            fields = _fields(head)
            size = fields.get("content-length", "")
            length = int(size) if size.isdigit() else 0
            parts, have = [rest], len(rest)
        if len(rows) >= 500 or held > 1 << 22:
            yield flush()
            rows, held = [], 0
    if fields is not None:
        rows.append(_row(fields, b"".join(parts)[:length], length))
    if rows:
        yield flush()


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under a path; see ``_READ``. Blocks are kept for segments only."""
    pieces = spark.read.option("lineSep", _START).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_parse, _READ)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"origin": [], "status": [], "bytes": [], "digest": [], "copies": []}
        for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            parts = sorted(parts, key=lambda p: p["number"])
            numbers = [p["number"] for p in parts]
            status, size, digest = "ok", None, None
            block = b"".join(p["block"] for p in parts)
            if len(set(numbers)) < len(numbers):
                status = "conflict"
            elif any(p["status"] != "ok" for p in parts):
                status = "bad_length"
            elif numbers != list(range(1, len(numbers) + 1)) or parts[-1]["total"] is None:
                status = "missing_segment"
            elif parts[-1]["total"] != len(block):
                status = "bad_length"
            elif (content := payload(block)) is None:
                status = "bad_chunk"
            else:
                size, digest = len(content), hashlib.sha256(content).hexdigest()
            copies = max((p["copies"] for p in parts if p["number"] == numbers[0]), default=1)
            for name, value in zip(out, (origin, status, size, digest, copies), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["origin"], pa.string()), pa.array(out["status"], pa.string()), pa.array(out["bytes"], pa.int64()),
             pa.array(out["digest"], pa.string()), pa.array(out["copies"], pa.int64())],
            list(out),
        )


def reassemble(found: DataFrame) -> DataFrame:
    """(id, type, uri, key, refers_to, status, bytes, digest) per capture, from :func:`read`.

    A segment is counted once however often it is stored; a capture stored n times comes back n times.
    """
    cut = F.col("number").isNotNull()
    once = found.where(cut).groupBy("origin", "number", "block", "total", "status").agg(F.count("*").alias("copies"))
    joined = (
        once.groupBy("origin").agg(F.collect_list(F.struct("number", "block", "total", "status", "copies")).alias("parts"))
        .mapInArrow(_join_segments, "origin string, status string, bytes long, digest string, copies long")
    )
    heads = found.where(cut & (F.col("number") == 1)).groupBy("origin").agg(
        *[F.first(c).alias(c) for c in ("id", "type", "uri", "key", "refers_to")]
    )
    columns = ("id", "type", "uri", "key", "refers_to", "status", "bytes", "digest")
    # segments without their first one come back under the origin's id
    long = joined.join(heads, "origin", "left").withColumn("id", F.coalesce("id", "origin"))
    long = long.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)
    return found.where(~cut).select(*columns).unionByName(long)


def resolve(whole: DataFrame) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, status): revisits take all from their response.

    ``refers_to`` is the response's key.
    """
    responses = whole.where("type = 'response'")
    revisits = whole.where("type = 'revisit'").select("key", "refers_to")
    targets = responses.groupBy("id").agg(*[F.first(c).alias(c) for c in ("bytes", "digest", "status")], F.first("key").alias("target"))
    followed = revisits.join(targets, revisits["refers_to"] == targets["id"], "left").select(
        "key", "bytes", "digest", F.lit("revisit").alias("type"), F.col("target").alias("refers_to"),
        F.coalesce("status", F.lit("dangling")).alias("status"),
    )
    kept = responses.select("key", "bytes", "digest", "type", F.lit(None).cast("string").alias("refers_to"), "status")
    return kept.unionByName(followed).select(
        "key", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "status"
    )
