"""Rows of a state variable as one value.

The state API moves values one at a time, so a row that is a value of its own costs far more than the row.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa

STATE = "rows binary"


def pack(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    """The rows as a state value of the schema ``STATE``."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def unpack(values: Iterable[tuple], schema: pa.Schema) -> pa.Table:
    """The rows of all values, in their order."""
    tables = [pa.ipc.open_stream(value[0]).read_all() for value in values]
    return pa.concat_tables(tables) if tables else schema.empty_table()
