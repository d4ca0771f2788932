"""What the corpus operators share: reading tables, staging, Arrow row batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candlewick.session import shared_dir

#: characters that count as white space in every contract: space, tab, LF, VT, FF, CR
BLANKS = " \t\n\x0b\x0c\r"
ROWS_OUT = 4_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Write once as Parquet into the shared folder; the frame read back, and a call that deletes its files.

    Cuts the lineage and survives lost executors.  Files that are not deleted before go when the
    session's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path), lambda: store.delete(folder, True)


def staged(df: DataFrame) -> DataFrame:
    """A frame that is read more than once, or looped over, written once."""
    return written(df)[0]


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded length from row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def rows_in(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Row tuples; only a few hundred at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(c.to_pylist() for c in part.columns))


def give_back() -> None:
    """Freed memory returns to the system.  Python workers are reused, so what one stage has held in them would stand
    against the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, rows, schema: str | T.StructType, size: int = ROWS_OUT) -> DataFrame:
    """``rows`` maps an iterator of input tuples to an iterator of output tuples, sent ``size`` at a time."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        yield from batches_of(rows(rows_in(batches)), arrow, size)
        give_back()

    return df.mapInArrow(run, kind)
