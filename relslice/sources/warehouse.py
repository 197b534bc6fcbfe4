"""A target database: one Parquet folder per table, with a list of the files that are live.

A load writes new files only and is published by swapping the list, which names the loads it holds. So a load that
is interrupted anywhere can be repeated: a table whose list names it is done, and files that no list names are
not seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relslice.catalog import Database, TableDef, base_type, spark_type
from relslice.operators.verify import MARKS
from relslice.sources import fs


def table_schema(table: TableDef) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in table.columns])


#: Types of key columns whose ranges are kept per file.
RANGED = ("smallint", "integer", "bigint", "smallserial", "serial", "bigserial", "numeric", "date", "text", "varchar", "character varying", "uuid")

#: Ranges by which incoming keys are described when files are looked up.
SPANS = 32


class Warehouse:
    """Tables of a catalog below a folder, and their id high-water marks."""

    def __init__(self, spark: SparkSession, path: str, db: Database):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), db.tables

    def location(self, key: str) -> str:
        t = self.tables[key]
        return f"{self.path}/{t.schema.encode().hex()}.{t.name.encode().hex()}"

    def live(self, key: str) -> dict:
        """A table's live files with the ranges of their keys, and the loads that made them."""
        where = self.location(key)
        if fs.has_text(self.spark, f"{where}/_live.json"):
            return json.loads(fs.read_text(self.spark, f"{where}/_live.json"))
        # A folder that something else has written has no list: all of its files are live.
        return {"loads": [], "files": [{"path": f, "rows": None, "low": None, "high": None} for f in fs.files(self.spark, where)]}

    def frame(self, key: str, files: Iterable[str] | None = None) -> DataFrame:
        """A table's rows, or those in some of its live ``files``; none if it was never written."""
        schema = table_schema(self.tables[key])
        named = [f["path"] for f in self.live(key)["files"]] if files is None else list(files)
        if not named:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.location(key)}/{f}" for f in named])

    def file_of(self, key: str) -> Column:
        """The live file that a row of :meth:`frame` is in."""
        return F.substring_index("_metadata.file_path", f"/{self.location(key).rsplit('/', 1)[1]}/", -1)

    def database(self) -> Database:
        return Database(dict(self.tables), {k: self.frame(k) for k in self.tables})

    def _ranged(self, key: str) -> str | None:
        """The column whose ranges are kept: the first of the primary key, else of the first unique key by name."""
        t = self.tables[key]
        columns = t.pk or next((u.columns for u in sorted(t.uniques, key=lambda u: u.name) if u.eligible), None)
        return columns[0] if columns and base_type(t.column(columns[0]).type) in RANGED else None

    def meeting(self, key: str, rows: DataFrame) -> list[str]:
        """The live files that may hold keys of ``rows``: those whose range meets one of the SPANS ranges that the rows' keys fill."""
        files, column = self.live(key)["files"], self._ranged(key)
        if column is None or all(f["low"] is None for f in files):
            return [f["path"] for f in files]
        kind = table_schema(self.tables[key])[column].dataType
        by = rows.select(F.col(f"`{column}`").cast(kind).alias("k")).dropna().repartitionByRange(SPANS, "k").groupBy(F.spark_partition_id())
        spans = by.agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()
        known = self.spark.createDataFrame([(f["path"], f["low"], f["high"]) for f in files], "path string, low string, high string")
        low, high = F.col("low").cast(kind), F.col("high").cast(kind)
        meets = reduce(lambda a, b: a | b, [(low <= F.lit(s["high"]).cast(kind)) & (high >= F.lit(s["low"]).cast(kind)) for s in spans], F.lit(False))
        return [r["path"] for r in known.where(low.isNull() | meets).collect()]

    def stage(self, key: str, rows: DataFrame, append: bool = False, instead_of: Iterable[str] = ()) -> None:
        """Write rows beside a table: all of its rows or, with ``append``, those to add, also instead of the live files named; generated columns are computed here."""
        t = self.tables[key]
        types = table_schema(t)
        for c in t.columns:
            if c.generated is not None:
                rows = rows.withColumn(c.name, F.expr(c.generated))
        staged = f"{self.location(key)}.__staged"
        fs.delete(self.spark, staged)
        rows.select(*[rows[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in types.fields]).write.parquet(staged)
        fs.write_text(self.spark, f"{staged}/_stage.json", json.dumps({"append": append, "instead_of": sorted(instead_of)}))

    def place(self, key: str, load: str | None = None) -> None:
        """Publish what is staged for a table as ``load``; again, it does what is missing of it, or nothing.

        The staged folder is renamed to one of the load's own name, then the list of live files is swapped.
        """
        where, load = self.location(key), load or uuid.uuid4().hex
        staged, folder = f"{where}.__staged", f"load-{load}"
        live = self.live(key)
        if load in live["loads"]:
            return
        if not fs.exists(self.spark, f"{where}/{folder}"):
            if not fs.has_text(self.spark, f"{staged}/_stage.json"):
                return
            if not fs.has_text(self.spark, f"{where}/_live.json"):
                fs.write_text(self.spark, f"{where}/_live.json", json.dumps(live))
            fs.rename(self.spark, staged, f"{where}/{folder}")
        how = json.loads(fs.read_text(self.spark, f"{where}/{folder}/_stage.json"))
        gone = {f["path"] for f in live["files"]} if not how["append"] else set(how["instead_of"])
        files = [f for f in live["files"] if f["path"] not in gone] + self._described(key, folder)
        fs.write_text(self.spark, f"{where}/_live.json", json.dumps({"loads": [*live["loads"], load], "files": files}))
        for f in gone:
            fs.delete(self.spark, f"{where}/{f}")

    def _described(self, key: str, folder: str) -> list[dict]:
        """The files of a folder with their rows and the range of their keys; reads the key column only."""
        named = [f"{folder}/{f}" for f in fs.files(self.spark, f"{self.location(key)}/{folder}")]
        if not named:
            return []
        column = self._ranged(key)
        value = F.col(f"`{column}`") if column else F.lit(None)
        rows = self.frame(key, named).groupBy(self.file_of(key).alias("path")).agg(F.count("*").alias("rows"), F.min(value).cast("string").alias("low"), F.max(value).cast("string").alias("high"))
        found = {r["path"]: r.asDict() for r in rows.collect()}
        return [found[f] for f in named if f in found]  # files without rows needn't be read

    def publish(self, keys: list[str], load: str | None = None) -> None:
        """Publish staged tables one after the other; a note names those still to come, so a broken run can be finished by calling this again."""
        note, load = f"{self.path}/_publish.json", load or uuid.uuid4().hex
        fs.write_text(self.spark, note, json.dumps({"pending": keys, "load": load}))
        for i, key in enumerate(keys):
            self.place(key, load)
            fs.write_text(self.spark, note, json.dumps({"pending": keys[i + 1 :], "load": load}))
        fs.delete(self.spark, note)

    def recover(self) -> list[str]:
        """Finish a publication that was interrupted; returns the tables that were put into place."""
        note = f"{self.path}/_publish.json"
        if not fs.has_text(self.spark, note):
            return []
        told = json.loads(fs.read_text(self.spark, note))
        self.publish(told["pending"], told.get("load"))
        return told["pending"]

    def holds(self, key: str, load: str) -> bool:
        """Whether a load has been published in a table."""
        return load in self.live(key)["loads"]

    def marks(self) -> DataFrame:
        path = f"{self.path}/_marks.json"
        rows = json.loads(fs.read_text(self.spark, path)) if fs.has_text(self.spark, path) else []
        names = [p.split()[0] for p in MARKS.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MARKS)

    def write_marks(self, marks: DataFrame) -> None:
        fs.write_text(self.spark, f"{self.path}/_marks.json", json.dumps([r.asDict() for r in marks.orderBy("schema", "table", "column").collect()]))

