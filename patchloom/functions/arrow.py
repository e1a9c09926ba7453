"""Arrow helpers for operators that must run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.session import ship


def emit_rows(df: DataFrame, visit: Callable[..., Iterator[tuple]], schema: T.StructType, rows: int = 20_000) -> DataFrame:
    """Flat-map: `visit` gets the columns of a row and yields tuples of `schema`; batches out hold about `rows` rows."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def flush(out: list[tuple]) -> pa.RecordBatch:
        cols = zip(*out) if out else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):  # a slice at a time: long texts are not all held as Python objects
                part = batch.slice(start, 1000)
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    out.extend(visit(*row))
                    if len(out) >= rows:
                        yield flush(out)
                        out = []
        if out:
            yield flush(out)

    return df.mapInArrow(run, schema)
