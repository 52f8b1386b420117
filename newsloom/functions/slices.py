"""Vectorized functions whose memory doesn't grow with an Arrow batch: a slice of rows is read, worked on and given back at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows and bytes of a slice; a longer row is a slice of its own.
ROWS, BYTES = 256, 1 << 20


def cut(columns: list[pa.Array]) -> Iterator[list[list]]:
    """The columns' values as Python lists, a slice of rows at a time."""
    begin, end = 0, len(columns[0])
    while begin < end:
        size = min(ROWS, end - begin)
        while size > 1 and sum(c.slice(begin, size).nbytes for c in columns) > BYTES:
            size = (size + 1) // 2
        yield [c.slice(begin, size).to_pylist() for c in columns]
        begin += size


def sliced(kind: str) -> Callable:
    """Makes a function of lists (one a column, each with a value a row) that returns such a list a function of columns; `kind` is the result's DDL type."""
    result = to_arrow_type(StructType.fromDDL(f"x {kind}")[0].dataType)

    def made(function: Callable) -> Callable[..., Column]:
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                for values in cut([column]):
                    yield pa.array(function(*values), result)

        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                for values in cut(list(columns)):
                    yield pa.array(function(*values), result)

        return lambda *columns: F.arrow_udf(one if len(columns) == 1 else several, kind)(*columns)

    return made
