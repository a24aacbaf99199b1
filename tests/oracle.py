"""Compare a registered query with its SQL counterpart on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return sorted(
        (tuple(_plain(row[n]) for n in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def compare(df, db, sql) -> str | None:
    """None when equal, else what differs."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"got {a}\nwant {b}"
    differing = {c: (k, kinds[c]) for c, k in df.dtypes if k != kinds[c]}
    if differing:
        return f"types {differing}"
    return None
