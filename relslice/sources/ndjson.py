"""NDJSON rows: one JSON object per line, all columns, dates and timestamps in ISO form, bytes in base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relslice.catalog import TableDef
from relslice.functions.coerce import POSITION, typed

#: Longest line in bytes.
MAX_LINE = 16 << 20

#: Row files of frames that Spark takes for larger than this many bytes are gzip files; readers tell by the name.
PLAIN_BYTES = 64 << 20

#: Rows in a gzip file at most, as such files can't be split.
ZIPPED_ROWS = 500_000

_WRITE = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
}


def write(df: DataFrame, path: str, position: bool = True, partition_by: list[str] | None = None, mode: str = "error", part_of: DataFrame | None = None) -> int:
    """Write rows and return their number, as the writing job has counted it.

    With ``position`` each line says its place in the dump, which loads follow for repeated keys. Large frames, or
    parts of a large frame ``part_of``, are compressed.
    """
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if position:
        out = out.withColumn(POSITION, F.monotonically_increasing_id())
    writer = out.write.mode(mode).options(**_WRITE)
    if _large(df if part_of is None else part_of):
        writer = writer.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": ZIPPED_ROWS})
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    # A frame that is known to be empty may be planned without the counting step.
    return seen.get.get("n", 0)


def _large(df: DataFrame) -> bool:
    """Whether the frame's size is known to be above PLAIN_BYTES."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return PLAIN_BYTES < size < 1 << 60


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of a row file that hold anything but white space of any kind."""
    return spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("value").rlike(r"(?U)\S"))


def digest_of_lines() -> list[Column]:
    """Aggregates of lines that don't depend on their order: number, and digest of all contents."""
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


def read(spark: SparkSession, path: str, table: TableDef, infinities: bool = False, seen: Observation | None = None) -> DataFrame:
    """Typed rows with __pos and __problems; a line over MAX_LINE bytes is a problem, too. ``seen`` observes the lines."""
    lines = read_lines(spark, path)
    if seen is not None:
        lines = lines.observe(seen, *digest_of_lines())
    return typed(lines, table, infinities=infinities, longest=MAX_LINE, writer=_WRITE)


def rows_of(rows: DataFrame, table: TableDef) -> DataFrame:
    """The table's columns and place; any problem stops the job with its message.

    The check is part of every column, not a filter: a filter would be moved below the parsing steps and repeat
    them for each column it looks at.
    """
    sound = F.size("__problems") == 0
    message = F.concat(F.lit(f"{table.key}, row "), F.coalesce(F.col(POSITION).cast("string"), F.lit("?")), F.lit(": "), F.array_join("__problems", "; "))
    names = [f for f in rows.schema.fields if f.name != "__problems"]
    return rows.select(*[F.when(sound, F.col(f"`{f.name}`")).otherwise(F.raise_error(message).cast(f.dataType)).alias(f.name) for f in names])
