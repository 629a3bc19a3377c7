"""Arrow-batched row maps shared by the Python-side text operators.

A map reads only the columns it names, so extra or clashing columns of the
input never reach the worker, and it holds a few hundred rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_ROWS = 256


def map_rows(df: DataFrame, inputs: list[Column], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Apply a per-chunk function to the given input columns.

    ``make()`` runs once per partition and returns ``f(*lists) -> lists``; it
    may return fewer or more rows than it got.  A function with a ``finish``
    attribute is asked for last rows at the end of its partition.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def batch(lists):
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(lists, arrow)], schema=arrow)

    def run(batches):
        f = make()
        for b in batches:
            for k in range(0, b.num_rows, CHUNK_ROWS):
                part = b.slice(k, CHUNK_ROWS)
                out = f(*(c.to_pylist() for c in part.columns))
                if out is not None:
                    yield batch(out)
        if hasattr(f, "finish"):
            yield batch(f.finish())

    named = [c.alias(f"in_{i}") for i, c in enumerate(inputs)]
    return df.select(*named).mapInArrow(run, schema)


def text_column(df: DataFrame, name: str = "text") -> Column:
    return df[name].cast("string")
