"""Python over Arrow batches, a few rows at a time: what a task's Python holds does not grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at once.
ROWS = 64


def mapped(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str, rows: int = ROWS) -> DataFrame:
    """Rows of the schema that make gives for the columns of df, each a list of values of the same rows."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = list(make(*(c.to_pylist() for c in batch.slice(at, rows).columns)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
