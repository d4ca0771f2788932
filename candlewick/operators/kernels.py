"""Running a vectorised numpy function over whole segments in Arrow batches.

Spark shuffles by (key, segment) and sorts; a task then sees its segments one
after the other.  Complete segments are handed to the function in blocks of a
few ten thousand rows, so many short histories share one vectorised call and a
long one never needs more memory than one segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_ROWS = 32_768
OUT_ROWS = 8_192

#: block -> named result columns (numpy arrays; NaN means NULL) and an optional
#: mask of the rows to keep
Kernel = Callable[["Block"], dict[str, np.ndarray]]


class Block:
    """Concatenated complete segments with row positions inside each segment."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.table = table
        self.rows = table.num_rows
        self.starts = starts
        lengths = np.diff(np.append(starts, self.rows))
        self.position = np.arange(self.rows) - np.repeat(starts, lengths)

    def floats(self, name: str) -> np.ndarray:
        column = self.table.column(name).combine_chunks()
        return column.to_numpy(zero_copy_only=False).astype("float64", copy=False)

    def ints(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype("int64", copy=False)

    def mask(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)

    def lag(self, values: np.ndarray, fill: float, steps: int = 1) -> np.ndarray:
        """Value ``steps`` rows earlier in the same segment, else ``fill``."""
        out = np.full(self.rows, fill, dtype="float64")
        if self.rows > steps:
            out[steps:] = values[:-steps]
        out[self.position < steps] = fill
        return out


def _differs(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; NULL is a value of its own, structs differ where a field does."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_differs(field) for field in column.flatten()])
    one_is_null = pc.xor(here.is_null(), before.is_null())
    differs = pc.if_else(one_is_null, True, pc.fill_null(pc.not_equal(here, before), False))
    return differs.to_numpy(zero_copy_only=False)


def _first_rows(table: pa.Table, groups: list[str]) -> np.ndarray:
    """Indices at which a new (key, segment) begins."""
    changed = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows:
        changed[0] = True
    for name in groups:
        if table.num_rows > 1:
            changed[1:] |= _differs(table.column(name).combine_chunks())
    return np.flatnonzero(changed)


def run_segments(df: DataFrame, groups: list[str], order: str, kernel: Kernel, fields: list[T.StructField]) -> DataFrame:
    """Append the kernel's columns to every row.

    ``df`` comes from ``segments.lay_out``: it is already partitioned by segment.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    arrow_fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    laid_out = df.sortWithinPartitions(*groups, order)

    def emit(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        results = kernel(Block(table, starts))
        for field in arrow_fields:
            values = results[field.name]
            floating = isinstance(values, np.ndarray) and values.dtype.kind == "f"
            column = pa.array(values, type=field.type, mask=np.isnan(values) if floating else None)
            table = table.append_column(field, column)
        yield from table.to_batches(max_chunksize=OUT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            starts = _first_rows(table, groups)
            cut = int(starts[-1])
            if cut == 0:
                continue  # one long segment: wait for its end
            yield from emit(table.slice(0, cut), starts[:-1])
            rest = table.slice(cut)
            waiting, held = rest.to_batches(), rest.num_rows
        if waiting:
            table = pa.Table.from_batches(waiting)
            yield from emit(table, _first_rows(table, groups))

    return laid_out.mapInArrow(run, schema)
