"""Pandas UDFs that are made when they are first applied, so modules import without a session; rows made of texts in small batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts, and their bytes, that a task reads and answers at once.
TEXTS, BYTES = 256, 1 << 20


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few texts and bytes; a longer text is a part of its own."""
    lo = held = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if i > lo and (i - lo == TEXTS or held + n > BYTES):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(batch):
        yield batch.slice(lo)


def exploded(df: DataFrame, key: str, content: Column | str, kind: str, f: Callable[[str], list[dict]]) -> DataFrame:
    """key, idx (from 0) and the columns of kind: a row for each of what f makes of the content. What a task holds does not grow with its batches."""
    columns = StructType.fromDDL(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = to_arrow_type(columns)
        for batch in batches:
            for part in pieces(batch, 1):
                made = [f(s or "") for s in part.column(1).to_pylist()]
                at = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64())
                idx = pa.array([n for rows in made for n in range(len(rows))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), idx, *pa.array([r for rows in made for r in rows], own).flatten()], names=[key, "idx", *columns.names])

    return df.select(key, F.col(content) if isinstance(content, str) else content).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, idx long, {kind}")


def pandas(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
