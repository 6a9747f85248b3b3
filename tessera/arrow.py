"""Rows through plain Python in bounded Arrow batches, for streams of bytes, which no expression can follow."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, rows_of: Callable, ddl: str, step: int = 64) -> DataFrame:
    """rows_of takes a dictionary of column lists (at most `step` rows) and gives tuples in the order of ddl."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = list(rows_of(batch.slice(at, step).to_pydict()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return df.mapInArrow(run, ddl)
