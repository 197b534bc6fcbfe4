"""Key-ordered chunks: their numbering in one pass, the next chunk after a key, and resumable chunked export."""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_right
from collections.abc import Callable, Iterable
from itertools import accumulate
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice.catalog import KeyChoice
from relslice.functions.coerce import POSITION
from relslice.scratch import discard, materialize
from relslice.sources import fs, ndjson

DEFAULT_CHUNK, MAX_CHUNK = 1_000, 1_000_000

#: A chunked export is about so many write jobs at most, besides the first ones, which double in size.
JOBS = 32

#: Rows in a folder of chunks, about, and chunks in it at most: the least that an interruption can cost.
FOLDER_ROWS, FOLDER_CHUNKS = 1_000_000, 1_000

#: Chunks of fewer rows cost their files more than their rows and are dealt evenly to the tasks that write them.
SMALL_CHUNK = 10_000

#: Rows in a file of ordered rows at most; a job over a range of ranks has a task for each file of its rows, or for some of them.
FILE_ROWS = 250_000


class Ordered:
    """``df`` range-partitioned and sorted by key once and written; nulls first, ties in any order.

    Each row's place is its partition (of 2**33 places) plus its place within; ``starts`` holds the first rank of
    each partition, added up on the driver from one count per partition. Places grow with ranks, and each written file holds
    a range of them, so :meth:`between` reads the files and row groups of its rows only.
    """

    def __init__(self, df: DataFrame, keys: Iterable[str]):
        keys = [F.col(f"`{k}`") for k in keys]
        self.rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()), "ranked", FILE_ROWS)
        counts = sorted((r["part"], r["n"]) for r in self.rows.groupBy(F.shiftright("__place", 33).alias("part")).agg(F.count("*").alias("n")).collect())
        self.starts = list(zip([p for p, _ in counts], accumulate([n for _, n in counts], initial=0), strict=False))
        self.count = sum(n for _, n in counts)
        firsts = self.rows.where("_metadata.row_index = 0").select("__place", "_metadata.file_path").collect()
        #: The first place of each file, and its path.
        self.files = sorted((r["__place"], unquote(r["file_path"])) for r in firsts)

    def ranked(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the written table with the column rank: 0 for the smallest key, and so on, without gaps."""
        offsets = rows.sparkSession.createDataFrame(self.starts, "__part long, __start long")
        found = rows.withColumn("__part", F.shiftright("__place", 33)).join(F.broadcast(offsets), "__part")
        return found.withColumn("rank", F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__place", "__start")

    def place(self, rank: int) -> int:
        """The place of a rank; that behind the last row for larger ones."""
        i = bisect_right([start for _, start in self.starts], rank) - 1
        return (self.starts[i][0] << 33) + rank - self.starts[i][1] if self.starts else 0

    def between(self, first: int, stop: int) -> DataFrame:
        """The rows whose ranks are from ``first`` to before ``stop``, with their ranks."""
        places, low, high = F.col("__place"), self.place(first), self.place(min(stop, self.count))
        behind = [*self.files[1:], (math.inf, "")]
        files = [path for (place, path), (following, _) in zip(self.files, behind, strict=False) if place < high and low < following]
        rows = self.rows.sparkSession.read.schema(self.rows.schema).parquet(*files) if files else self.rows
        return self.ranked(rows.where((places >= low) & (places < high)))


def with_rank(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df`` with the column rank: 0 for the smallest key, and so on, without gaps; nulls first, ties in any order."""
    ordered = Ordered(df, keys)
    return ordered.ranked(ordered.rows)


def with_chunk(df: DataFrame, keys: Iterable[str], size: int = DEFAULT_CHUNK) -> DataFrame:
    """``df`` with chunk_id: the key's rank divided by the chunk size."""
    if not 1 <= size <= MAX_CHUNK:
        raise ValueError(f"a chunk has 1 to {MAX_CHUNK} rows")
    return with_rank(df, keys).withColumn("chunk_id", F.floor(F.col("rank") / size).cast("long")).drop("rank")


def next_chunk(df: DataFrame, keys: Iterable[str], after: tuple | None, size: int = DEFAULT_CHUNK) -> DataFrame:
    """The ``size`` rows with the smallest keys after the key ``after``; rows with a null in the key come before all others.

    The comparison is spelled out by column, with a bound of the first column by itself, so that scans can skip.
    """
    keys = list(keys)
    if after is not None:
        pairs = [(F.col(f"`{k}`"), F.lit(v).cast(df.schema[k].dataType)) for k, v in zip(keys, after, strict=True)]
        later = F.lit(False)
        for c, v in reversed(pairs):
            later = (c > v) | ((c == v) & later)
        df = df.where(pairs[0][0] >= pairs[0][1]).where(later)
    return df.orderBy(*[F.col(f"`{k}`") for k in keys]).limit(size)


def data_state(df: DataFrame) -> list:
    """What tells one state of a frame's data from another, in one row: of files their number and a digest of names,
    sizes and times; of other frames the number and a digest of all rows."""
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        digest = F.xxhash64("file_path", "file_size", "file_modification_time")
        found = files.agg(F.count("*").alias("n"), F.bit_xor(digest).alias("a"), F.sum(digest.cast("decimal(38,0)")).alias("b"))
    except AnalysisException:
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        found = df.agg(F.count("*").alias("n"), F.bit_xor(digest).alias("a"), F.sum(digest.cast("decimal(38,0)")).alias("b"))
    return [str(x) for x in found.first()]


def files_state(spark: SparkSession, files: list[str]) -> list:
    """Number and digest of the names, sizes and times of some files as the file system has them now; of files that are gone, nothing."""
    try:
        now = spark.read.format("binaryFile").load([unquote(f) for f in files])
    except AnalysisException:
        return []
    digest = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return [str(x) for x in now.agg(F.count("*"), F.sum(digest)).first()]


def fingerprint(table: str, choice: KeyChoice, size: int, state: list, options: dict) -> str:
    """What a chunked export depends on, as a SHA-256 digest; a resumed run must have the same."""
    plan = {"table": table, "strategy": choice.strategy, "keys": list(choice.columns), "size": size, "data": state, "options": options}
    return hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()


def export_chunks(df: DataFrame, out: str, table: str, choice: KeyChoice, size: int, options: dict, columns: list[str], finish: Callable[[DataFrame], DataFrame] = lambda d: d, per_job: int | None = None) -> int:
    """Write ``df`` in chunks below ``out`` and return its number of rows; a rerun writes only what is missing.

    ``per_job`` chunks (by default those of about FOLDER_ROWS rows) are one folder, staged and then renamed into place,
    so a folder is there whole or not at all. The first job writes one folder and each further one up to twice as
    many, to a share of 1 / JOBS of all: so the number of jobs is bounded, and an interruption loses at most that share.
    ``out``/_plan.json holds the fingerprint, the chunks of a folder and the number of rows; an export with another
    fingerprint or number is an error. Where all folders are there, the rows of ``df`` are counted and not ordered again.
    ``finish`` (redaction, say) is applied after rows are numbered by their true keys.
    """
    if not 1 <= size <= MAX_CHUNK:
        raise ValueError(f"a chunk has 1 to {MAX_CHUNK} rows")
    spark = df.sparkSession
    mark, plan, staged = fingerprint(table, choice, size, data_state(df), options), f"{out}/_plan.json", f"{out}/_staged"
    known, other = json.loads(fs.read_text(spark, plan)) if fs.has_text(spark, plan) else {}, ValueError(f"{out} holds chunks of another export of {table}")
    if known.get("fingerprint", mark) != mark:
        raise other
    if known:
        # Exports begun before folders were bounded by their rows don't say how many chunks these have.
        per_job = known.get("per_job", per_job or FOLDER_CHUNKS)
    per_job = per_job or max(1, min(FOLDER_CHUNKS, FOLDER_ROWS // size))
    done = set(fs.listdir(spark, out))

    def missing(n_rows: int) -> list[int]:
        # An empty table has one folder without chunks.
        return [i for i in range(max(1, math.ceil(n_rows / (size * per_job)))) if f"chunks-{i * per_job:09d}" not in done]

    finished = "n_rows" in known and not missing(known["n_rows"])
    ordered = None if finished else Ordered(df, choice.columns)
    count = df.count() if finished else ordered.count
    if known.get("n_rows", count) != count:
        raise other
    fs.delete(spark, staged)
    if finished:
        return count
    if "n_rows" not in known:
        fs.write_text(spark, plan, json.dumps({"fingerprint": mark, "table": table, "strategy": choice.strategy, "keys": list(choice.columns), "size": size, "per_job": per_job, "n_rows": count}))
    for run in _runs(missing(count), math.ceil(count / (size * per_job * JOBS))):
        part = ordered.between(run[0] * per_job * size, (run[-1] + 1) * per_job * size)
        part = part.withColumn("chunk_id", F.floor(F.col("rank") / size).cast("long")).withColumn(POSITION, F.col("rank"))
        part = finish(part).select(*columns, POSITION, "chunk_id", F.floor(F.col("chunk_id") / per_job).cast("long").alias("__folder"))
        if size < SMALL_CHUNK:
            tasks = 4 * spark.sparkContext.defaultParallelism
            part = part.repartition(min(tasks, len(run) * per_job), "__folder" if len(run) >= tasks else "chunk_id")
        ndjson.write(part, staged, position=False, partition_by=["__folder", "chunk_id"], part_of=ordered.rows)
        for i in run:
            fs.rename(spark, f"{staged}/__folder={i}" if count else staged, f"{out}/chunks-{i * per_job:09d}")
        fs.delete(spark, staged)
    discard(ordered.rows)
    return count


def _runs(missing: list[int], most: int) -> list[list[int]]:
    """Ascending numbers in runs without gaps: of one number, then of up to twice as many as the one before, to ``most``."""
    runs, size = [], 1
    for i in missing:
        if runs and len(runs[-1]) < size and runs[-1][-1] == i - 1:
            runs[-1].append(i)
            continue
        if runs:
            size = min(2 * size, most)
        runs.append([i])
    return runs
