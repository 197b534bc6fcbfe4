"""One-pass Arrow operators: add columns to a DataFrame batch by batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that an operator works on at a time, and about the bytes of their texts (one row at least).
ROWS, BYTES = 1024, 16 << 20

#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of at most ROWS rows and about BYTES of text, so what is built beside them stays small."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if any(f(c.type) for f in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right"))
        stop = min(max(at + 1, full), at + ROWS)
        yield batch.slice(at, stop - at)
        at = stop


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark send BATCH_BYTES at a time to Python workers, where the session allows more.

    Both sides hold whole batches, some of them twice, so these decide what an executor's tasks take beside the heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def field_types(ddl: str) -> list[T.StructField]:
    return T._parse_datatype_string(ddl).fields


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system: workers outlive their tasks and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def add_columns(df: DataFrame, ddl: str, make: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = (), done: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with the columns of ``ddl``, made by ``make`` for :func:`spans` of rows; ``drop`` columns end here.

    Columns of ``df`` that clash with the new names are replaced. ``make`` gets all columns, ``drop`` columns
    included. Column order: what is kept, then the new columns. ``done`` is called when a partition is finished.
    """
    bounded_batches(df.sparkSession)
    new = field_types(ddl)
    names = {f.name.lower() for f in new}
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    gone = {c.lower() for c in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType([*keep, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in spans(whole):
                kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n.lower() not in gone]
                yield pa.RecordBatch.from_arrays([*kept, *make(batch)], [f.name for f in schema.fields])
            give_back()
        whole = batch = kept = None
        if done is not None:
            done()
        give_back()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A batch's column by name, without regard to case, as Spark resolves names."""
    return batch.column([n.lower() for n in batch.schema.names].index(name.lower()))


def shielded(docs: DataFrame, used: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over ``docs`` with the columns of ``docs`` as they were, whatever columns ``run`` adds.

    Columns other than ``used`` go through ``run`` under names of their own, so an operator's new columns never
    replace them.
    """
    own = {c: c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()])
    return run(inner).select(*[F.col(name).alias(c) for c, name in own.items()])
