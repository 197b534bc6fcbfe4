"""Incremental exports with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from relslice.catalog import Database, TableDef
from relslice.functions.coerce import POSITION
from relslice.functions.redact import redact
from relslice.sources import fs, manifest, ndjson

#: Batches of one export, tasks of a batch, and rows of a task, that places in a dump have bits for.
MAX_BATCHES, MAX_TASKS, ROW_BITS = 1 << 20, 1 << 13, 30


def table_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream of rows."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def append_export(
    stream: DataFrame, table: TableDef, out: str, checkpoint: str, *, redacted: bool = False, transform: Callable[[DataFrame], DataFrame] | None = None, file_format: str = "parquet"
) -> StreamingQuery:
    """Append all rows not exported yet to ``out``, then stop; an interrupted or repeated run writes no row twice.

    What has been read and written is recorded in ``checkpoint`` and in the sink's log. Redaction and ``transform``
    are row-local and run within the stream.
    """
    rows = redact(table, stream) if redacted else stream
    rows = transform(rows) if transform else rows
    writer = rows.writeStream.format(file_format).option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def append_dump(
    stream: DataFrame, table: TableDef, out: str, checkpoint: str, *, redacted: bool = False, transform: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Append all rows not exported yet to the dump ``out`` of one table, then stop.

    After each batch ``out`` is a whole dump, with a manifest and an inventory, that can be loaded. A batch is a folder of
    its own, named by its number, and is put into place by one rename; the manifest says how many batches count.
    So a batch that is repeated, as it ended between any two steps, is taken from where it got to and has every
    row once. Places in the dump ascend by batch. An export with another ``checkpoint`` than the dump's is an error.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        told = manifest.read(spark, out) if fs.has_text(spark, f"{out}/metadata.json") else None
        record = told["stream"] if told else {"query": query, "batches": 0}
        if record["query"] != query:
            raise ValueError(f"{out} is another stream's export")
        if number >= MAX_BATCHES:
            raise ValueError(f"an export has {MAX_BATCHES} batches at most")
        if number < record["batches"]:
            return
        part = f"/batch-{number:07d}"
        folder = f"{out}/{manifest.data_file(table)}{part}"
        if not fs.exists(spark, folder):
            rows = redact(table, batch) if redacted else batch
            rows = (transform(rows) if transform else rows).select(*[c.name for c in table.columns])
            id_ = F.monotonically_increasing_id()
            place = (F.shiftright(id_, 33) * (1 << ROW_BITS) + id_.bitwiseAND((1 << 33) - 1)) + F.lit(number) * (MAX_TASKS << ROW_BITS)
            staged = f"{out}/_staged"
            fs.delete(spark, staged)
            ndjson.write(rows.coalesce(MAX_TASKS).withColumn(POSITION, place), staged, position=False)
            fs.rename(spark, staged, folder)
        n = ndjson.read_lines(spark, folder).count()
        manifest.take_inventory(spark, out, [table], {table.key: n}, part)
        total = (told["tables"][0]["row_count"] if told else 0) + n
        done = manifest.build(Database({table.key: table}), {table.key: total}, [table.key], [table.schema], {"redacted": redacted})
        manifest.write(spark, out, done | {"stream": {"query": query, "batches": number + 1}})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
