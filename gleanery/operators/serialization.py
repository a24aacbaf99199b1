"""JSON shapes of nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    MapType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_timestamp(ts: Column | str) -> Column:
    """ISO-8601 without zone; the fraction appears only when it is not zero, with six digits."""
    t = _c(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(t, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def text_keys(m: Column | str) -> Column:
    """JSON object keys are text."""
    return F.transform_keys(_c(m), lambda k, _: k.cast("string"))


def _differs(kind: DataType) -> bool:
    """Whether a value of this type, or one inside it, has another form in JSON."""
    if isinstance(kind, ArrayType):
        return _differs(kind.elementType)
    if isinstance(kind, MapType):
        return not isinstance(kind.keyType, StringType) or _differs(kind.valueType)
    if isinstance(kind, StructType):
        return any(_differs(f.dataType) for f in kind.fields)
    return isinstance(kind, (TimestampType, TimestampNTZType, DateType))


def _adapted(value: Column, kind: DataType) -> Column:
    if not _differs(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _adapted(x, kind.elementType))
    if isinstance(kind, MapType):
        values = F.transform_values(value, lambda _, x: _adapted(x, kind.valueType)) if _differs(kind.valueType) else value
        timed = isinstance(kind.keyType, (TimestampType, TimestampNTZType))
        return F.transform_keys(values, lambda k, _: iso_timestamp(k) if timed else k.cast("string"))
    if isinstance(kind, StructType):
        members = [_adapted(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*members))
    return value.cast("string") if isinstance(kind, DateType) else iso_timestamp(value)


def to_jsonable(df: DataFrame) -> DataFrame:
    """Columns adapted to JSON at any depth: timestamps to ISO text, dates and map keys to text."""
    return df.select(*[_adapted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def dumps(value: Column, pretty: bool = False) -> Column:
    """Compact or two-space indented JSON; null struct members are left out."""
    if not pretty:
        return F.to_json(value)
    # keys open a line of the indented form; drop the space the writer puts before the colon
    return F.regexp_replace(F.to_json(value, {"pretty": "true"}), r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")


def lines(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def array_document(df: DataFrame, key: str) -> DataFrame:
    """JSON array documents, one per ``key``: for bounded exports such as one site's results.

    The scalable form of the same content is ``lines``.
    """
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    return df.groupBy(key).agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(body)), ","), F.lit("]")).alias("document")
    )


def parse_array(documents: DataFrame, schema: str, column: str = "document") -> DataFrame:
    """The rows of JSON array documents."""
    keys = [c for c in documents.columns if c != column]
    return documents.select(*keys, F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def parse_lines(text: DataFrame, schema: str, column: str = "value") -> DataFrame:
    return text.select(F.from_json(column, f"struct<{schema}>").alias("r")).select("r.*")
