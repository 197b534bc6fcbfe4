"""The manifest of a dump, its row files, and the history of runs."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relslice.catalog import ColumnDef, Database, FkDef, TableDef, UniqueDef
from relslice.sources import fs, ndjson

#: Newest manifest layout that is read.
SCHEMA_VERSION = 3


def data_file(table: TableDef) -> str:
    """A table's row folder below the dump: hexadecimal UTF-8 of schema and name, so any name is a safe file name."""
    return f"data/{table.schema.encode().hex()}.{table.name.encode().hex()}.ndjson"


def build(db: Database, counts: dict[str, int], order: list[str], schemas: list[str], provenance: dict, subset: dict | None = None, sequences: list[dict] | None = None) -> dict:
    tables = []
    for key in order:
        t = db.tables[key]
        tables.append({"key": key, "schema": t.schema, "name": t.name, "file": data_file(t), "row_count": counts[key], "kind": t.kind, "columns": [asdict(c) for c in t.columns], "fks": [asdict(f) for f in t.fks], "uniques": [asdict(u) for u in t.uniques]})
    out = {"schema_version": SCHEMA_VERSION, "generated_at": dt.datetime.now(dt.UTC).isoformat(), "schema": ",".join(schemas), "tables": tables}
    out["provenance"] = provenance | {"table_count": len(tables), "total_rows": sum(counts[k] for k in order)}
    return out | ({"subset": subset} if subset else {}) | ({"sequences": sequences} if sequences else {})


def write(spark: SparkSession, path: str, manifest: dict) -> None:
    fs.write_text(spark, f"{path}/metadata.json", json.dumps(manifest, indent=2))


def read(spark: SparkSession, path: str) -> dict:
    """A dump's manifest; one of a newer layout, or without a schema, is an error."""
    found = json.loads(fs.read_text(spark, f"{path}/metadata.json"))
    if found.get("schema_version", 1) > SCHEMA_VERSION:
        raise ValueError(f"manifest version {found['schema_version']} is newer than {SCHEMA_VERSION}")
    if not found.get("schema"):
        raise ValueError("the manifest names no schema")
    return found


def database(manifest: dict) -> Database:
    """The table definitions of a manifest, without data."""
    tables = [
        TableDef(
            t["name"], tuple(ColumnDef(**c) for c in t["columns"]), t["schema"],
            tuple(FkDef(tuple(f["columns"]), f["parent"], tuple(f["parent_columns"]), f["name"]) for f in t["fks"]),
            tuple(UniqueDef(u["name"], tuple(u["columns"]), u["eligible"]) for u in t["uniques"]), kind=t["kind"],
        )
        for t in manifest["tables"]
    ]
    return Database({t.key: t for t in tables})


def check_files(spark: SparkSession, path: str, manifest: dict) -> None:
    """Each table must have its own row folder below the dump, and it must be there."""
    files = [t["file"] for t in manifest["tables"]]
    if twice := sorted({f for f in files if files.count(f) > 1}):
        raise ValueError(f"row files named twice: {', '.join(twice)}")
    if outside := [f for f in files if f.startswith("/") or ".." in f.split("/") or ":" in f]:
        raise ValueError(f"row files outside the dump: {', '.join(outside)}")
    missing = [f for f in files if not fs.exists(spark, f"{path}/{f}")]
    if missing and len(missing) == len(files):
        raise ValueError("the dump holds no row files at all")
    if missing:
        raise ValueError(f"row files are missing: {', '.join(missing)}")


_INVENTORY = "folder string, file string, n_rows long, n_bytes long, digest string"


def _files_below(spark: SparkSession, path: str, tables: Iterable[TableDef], part: str = "") -> DataFrame:
    """folder, file and n_bytes of every row file of some tables, or of a part of each, as they are on the file system; nothing is read."""
    folders = [f"{path}/{data_file(t)}{part}" for t in tables]
    there = [f for f in folders if fs.exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "folder string, file string, n_bytes long")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    return listed.select(*_named("path"), F.col("length").alias("n_bytes"))


def _named(path: str) -> list[Column]:
    """The table's folder and the file's name below it, from a file's path."""
    return [F.regexp_extract(path, r".*/([0-9a-f]*\.[0-9a-f]*\.ndjson)/(.+)$", i).alias(n) for i, n in ((1, "folder"), (2, "file"))]


def take_inventory(spark: SparkSession, path: str, tables: list[TableDef], counts: dict[str, int], part: str = "") -> None:
    """Read a dump's row files once and record each file's rows, bytes, and digest of its lines in any order, below the dump.

    ``part`` (/name) is a subfolder of each table, for dumps that grow. A table that doesn't have the rows that its job
    has counted is an error.
    """
    lines = ndjson.read_lines(spark, [f"{path}/{data_file(t)}{part}" for t in tables])
    read = lines.select("value", F.col("_metadata.file_path").alias("path")).groupBy("path").agg(*ndjson.digest_of_lines())
    read = read.select(*_named("path"), F.col("n").alias("n_rows"), "digest")
    whole = _files_below(spark, path, tables, part).join(read, ["folder", "file"], "left").na.fill({"n_rows": 0, "digest": "0"})
    fs.delete(spark, f"{path}/inventory{part}")
    whole.select("folder", "file", "n_rows", "n_bytes", "digest").write.json(f"{path}/inventory{part}")
    written = {r["folder"]: r["n"] for r in inventory(spark, path, part).groupBy("folder").agg(F.sum("n_rows").alias("n")).collect()}
    if bad := [t.key for t in tables if written.get(data_file(t).rsplit("/", 1)[1], 0) != counts[t.key]]:
        raise OSError(f"row files don't hold the rows that were written: {', '.join(bad)}")


def inventory(spark: SparkSession, path: str, part: str = "") -> DataFrame:
    """folder, file, n_rows, n_bytes and digest of each row file of a dump (or of a part of it), as it was written."""
    return spark.read.schema(_INVENTORY).option("recursiveFileLookup", "true").json(f"{path}/inventory{part}")


def file_problems(spark: SparkSession, path: str, tables: Iterable[TableDef]) -> DataFrame:
    """key, file and problem of every row file that was lost or added since the dump, or whose size has changed."""
    tables = list(tables)
    names = spark.createDataFrame([(data_file(t).rsplit("/", 1)[1], t.key) for t in tables], "folder string, key string")
    was = inventory(spark, path).join(F.broadcast(names), "folder").select("folder", "file", "key", F.col("n_bytes").alias("was"))
    now = _files_below(spark, path, tables).join(F.broadcast(names), "folder").select("folder", "file", F.col("key").alias("now_key"), F.col("n_bytes").alias("now"))
    problem = F.when(F.col("now").isNull(), "is missing").when(F.col("was").isNull(), "is not of this dump").when(F.col("now") != F.col("was"), "has another size")
    found = was.join(now, ["folder", "file"], "full_outer")
    return found.select(F.coalesce("key", "now_key").alias("key"), "file", problem.alias("problem")).where("problem is not null")


def check_inventory(spark: SparkSession, path: str, db: Database) -> dict[str, tuple[int, str]]:
    """Compare a dump's row files with its inventory; returns the lines and digest that each table must have. A dump without an inventory (of an older layout) has none to give."""
    if not fs.exists(spark, f"{path}/inventory"):
        return {}
    if bad := file_problems(spark, path, db.tables.values()).orderBy("key", "file").limit(20).collect():
        raise ValueError("the dump isn't whole: " + "; ".join(f"{r['key']}: {r['file']} {r['problem']}" for r in bad))
    sums = inventory(spark, path).groupBy("folder").agg(F.sum("n_rows").alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("digest"))
    by_folder = {r["folder"]: (r["n"], r["digest"]) for r in sums.collect()}
    return {k: by_folder.get(data_file(t).rsplit("/", 1)[1], (0, "0")) for k, t in db.tables.items()}


def check_lines(spark: SparkSession, path: str, table: TableDef, expected: tuple[int, str] | None, seen: Observation) -> None:
    """Compare the lines that a load has read with the inventory; if they differ (a task that ran twice may have counted twice), once more by a job of its own."""
    if expected is None:
        return
    got = seen.get
    if (got.get("n", 0), got.get("digest", "0")) != expected:
        got = ndjson.read_lines(spark, f"{path}/{data_file(table)}").agg(*ndjson.digest_of_lines()).first()
        if (got["n"], got["digest"]) != expected:
            raise ValueError(f"the dump isn't whole: the lines of {table.key} are not those that were written ({got['n']} of {expected[0]})")


_RUN = "path string, seq long, created string, source string, n_tables long, n_rows long"


def register_run(spark: SparkSession, base: str, path: str, seq: int, source: str = "") -> None:
    """Record a finished dump in the history of ``base``."""
    m = read(spark, path)
    record = {"path": path, "seq": seq, "created": m["generated_at"], "source": source, "n_tables": len(m["tables"]), "n_rows": m["provenance"]["total_rows"]}
    fs.write_text(spark, f"{base}/.runs/{seq:08d}.json", json.dumps(record))


def merge_runs(registered: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Registered runs and those found on disk only, the newest first."""
    extra = on_disk.join(registered.select("path"), "path", "left_anti")
    return registered.unionByName(extra).orderBy(F.desc("seq"), F.desc("created"))


def list_runs(spark: SparkSession, base: str) -> DataFrame:
    """All runs of ``base``: the registered ones, and numbered folders that hold a manifest."""
    records = [json.loads(fs.read_text(spark, f"{base}/.runs/{f}")) for f in fs.listdir(spark, f"{base}/.runs") if f.endswith(".json")]
    disk = []
    for name in fs.listdir(spark, base):
        if name.isdigit() and fs.has_text(spark, f"{base}/{name}/metadata.json"):
            m = read(spark, f"{base}/{name}")
            disk.append({"path": f"{base}/{name}", "seq": int(name), "created": m["generated_at"], "source": "", "n_tables": len(m["tables"]), "n_rows": m["provenance"]["total_rows"]})
    fields = [p.split()[0] for p in _RUN.split(", ")]
    frames = [spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], _RUN) for rows in (records, disk)]
    return merge_runs(*frames)
