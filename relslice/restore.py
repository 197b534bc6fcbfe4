"""Restores: a dump's rows into a warehouse, in foreign key order, under a conflict policy."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relslice.catalog import Database, TableDef, schema_violations
from relslice.functions.coerce import POSITION
from relslice.operators import verify as marks
from relslice.operators.closure import orphans
from relslice.operators.conflict import ConflictError, appended, conflict_key, inbound_fks, merged
from relslice.plans.graph import fk_levels, fk_order
from relslice.plans.selection import exclude_for_restore
from relslice.scratch import discard, materialize
from relslice.sources import fs, manifest, ndjson
from relslice.sources.warehouse import Warehouse, table_schema

MAX_WORKERS = 16


@dataclass
class Report:
    """What a restore did: tables in the order they were loaded, and warnings."""

    tables: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def check_options(on_conflict: str, replace: bool, workers: int) -> None:
    if replace and on_conflict != "error":
        raise ValueError("replace can't be combined with a conflict policy")
    if not 1 <= workers <= MAX_WORKERS:
        raise ValueError(f"workers must be from 1 to {MAX_WORKERS}")
    if workers > 1 and (replace or on_conflict != "error"):
        raise ValueError("several workers can neither replace tables nor resolve conflicts")


def _incoming(spark: SparkSession, path: str, table: TableDef, seen: Observation) -> DataFrame:
    rows = ndjson.rows_of(ndjson.read(spark, f"{path}/{manifest.data_file(table)}", table, seen=seen), table)
    return rows.select(*[c for c in table.writable], POSITION) if table.writable else rows.select(POSITION)


def _full(rows: DataFrame, target: TableDef) -> DataFrame:
    """Rows with all columns of the target; those that the dump lacks, and generated ones, are null for now."""
    types = table_schema(target)
    return rows.select(*[F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in types.fields], POSITION)


def restore(
    spark: SparkSession,
    path: str,
    target: Warehouse,
    *,
    on_conflict: str = "error",
    replace: bool = False,
    exclude: Iterable[str] = (),
    workers: int = 1,
    strict: bool = False,
    inventory: bool = True,
) -> Report:
    """Load a dump into ``target``.

    The manifest, the row files (against the dump's inventory) and the target's schema are checked first; then every
    row is typed strictly, and one that doesn't fit stops the load. With one worker all tables are staged and put into
    place at the end, so an error changes nothing. With more, tables of one dependency level are loaded together
    and each is put into place when done. A load has a name, which is noted before it begins and which each table's
    list of live files keeps; so a call after an interruption goes on with the tables that don't have it yet, and
    no row is loaded twice. Orphans are warnings, with ``strict`` errors. ``inventory=False`` loads a dump whose row files
    were edited on purpose.
    """
    check_options(on_conflict, replace, workers)
    target.recover()
    spec = manifest.read(spark, path)
    dumped = exclude_for_restore(manifest.database(spec), exclude)
    manifest.check_files(spark, path, spec | {"tables": [t for t in spec["tables"] if t["key"] in dumped.tables]})
    written = manifest.check_inventory(spark, path, dumped) if inventory else {}
    goal = Database({k: t for k, t in target.tables.items() if k in dumped.tables})
    if bad := schema_violations(spark, dumped, goal).orderBy("key", "column").limit(20).collect():
        raise ValueError("the target doesn't fit: " + "; ".join(f"{r['key']}.{r['column']}: {r['problem']}" for r in bad))
    if not replace:
        for t in goal.tables.values():
            conflict_key(t, on_conflict)
    elif inbound := inbound_fks(Database(target.tables), set(dumped.tables)):
        raise ConflictError("tables that stay reference replaced ones: " + ", ".join(f"{c} -> {p}" for c, p in inbound))

    def load(key: str) -> None:
        table, seen = target.tables[key], Observation()
        # Typed once; the conflict policies look at incoming rows several times.
        rows = materialize(_full(_incoming(spark, path, dumped.tables[key], seen), table), "incoming")
        manifest.check_lines(spark, path, dumped.tables[key], written.get(key), seen)
        if replace:
            target.stage(key, rows.drop(POSITION))
        else:
            _stage_rows(target, key, rows, on_conflict)
        discard(rows)

    report = Report()
    if workers == 1:
        report.tables = fk_order(dumped)
        state = _Once(target, path, spec, dumped, on_conflict, replace)
        try:
            for key in [k for k in report.tables if not target.holds(k, state.load)]:
                load(key)
        except Exception:
            state.done()  # nothing has been put into place
            raise
        target.publish(report.tables, state.load)
    else:
        state = _load_levels(spark, path, target, dumped, workers, load, report)
    _marks(spark, spec, target, dumped)
    state.done()
    for t in goal.tables.values():
        for f in t.fks:
            if f.parent in target.tables and orphans(target.frame(t.key), f, target.frame(f.parent)).limit(1).count():
                report.warnings.append(f"{t.key} has rows without a parent in {f.parent}")
    if strict and report.warnings:
        raise ValueError("; ".join(report.warnings))
    return report


def _stage_rows(target: Warehouse, key: str, rows: DataFrame, policy: str) -> None:
    """Stage what a policy makes of incoming rows. Only files that may hold their keys are read; an upsert writes those
    anew that do hold one, with the rows that are new, and leaves all others."""
    table = target.tables[key]
    near = target.meeting(key, rows) if conflict_key(table, policy) else []
    known = target.frame(key, near)
    if (more := appended(known, rows, table, policy)) is not None:
        target.stage(key, more, append=True)
        return
    keys = conflict_key(table, policy)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(keys)])
    wanted = rows.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    held = known.withColumn("__file", target.file_of(key)).join(wanted, same, "left_semi") if near else None
    touched = [r["__file"] for r in held.select("__file").distinct().collect()] if near else []
    target.stage(key, merged(target.frame(key, touched), rows, table, policy), append=True, instead_of=touched)


class _Once:
    """The name of a load with one worker, noted in the target until all of it is done."""

    def __init__(self, target: Warehouse, path: str, spec: dict, dumped: Database, *options):
        self.target, self.note = target, f"{target.path}/_load.json"
        of = hashlib.sha256(json.dumps([path, spec, sorted(dumped.tables), *options], sort_keys=True).encode()).hexdigest()
        old = json.loads(fs.read_text(target.spark, self.note)) if fs.has_text(target.spark, self.note) else {}
        self.load = old["load"] if old.get("of") == of else uuid.uuid4().hex
        fs.write_text(target.spark, self.note, json.dumps({"of": of, "load": self.load}))

    def done(self) -> None:
        fs.delete(self.target.spark, self.note)


class _Levels:
    """The state of a load with several workers, kept in the dump: the load's name, and its tables as they are put into place."""

    def __init__(self, spark: SparkSession, path: str, target: Warehouse, dumped: Database):
        self.spark, self.path, self.lock, self.order = spark, f"{path}/_load_state.json", Lock(), fk_order(dumped)
        mark = hashlib.sha256(json.dumps(sorted(dumped.tables)).encode()).hexdigest()
        self.state = {"target": target.path, "table_set": mark, "load": uuid.uuid4().hex, "committed": [], "failed": []}
        if fs.has_text(spark, self.path):
            old = json.loads(fs.read_text(spark, self.path))
            if (old["target"], old["table_set"]) != (target.path, mark):
                raise ValueError("an unfinished load of this dump has another target or table set")
            self.state["load"] = self.load = old.get("load") or self.state["load"]
            # A table may have been put into place without its note.
            self.state["committed"] = [k for k in self.order if k in old["committed"] or target.holds(k, self.load)]
        self.load = self.state["load"]
        self.save()

    def save(self) -> None:
        known = {*self.state["committed"], *self.state["failed"]}
        fs.write_text(self.spark, self.path, json.dumps(self.state | {"pending": [k for k in self.order if k not in known]}))

    def note(self, key: str, failed: bool) -> None:
        with self.lock:
            self.state["failed" if failed else "committed"].append(key)
            self.save()

    def done(self) -> None:
        fs.delete(self.spark, self.path)


def _load_levels(spark: SparkSession, path: str, target: Warehouse, dumped: Database, workers: int, load, report: Report) -> _Levels:
    levels, state = fk_levels(dumped), _Levels(spark, path, target, dumped)
    for level in levels:

        def one(key: str) -> Exception | None:
            try:
                load(key)
                target.place(key, state.load)
                state.note(key, failed=False)
                return None
            except Exception as e:  # noqa: BLE001  kept for the caller, after the level has ended
                state.note(key, failed=True)
                return e

        todo = [k for k in level if k not in state.state["committed"]]
        with ThreadPoolExecutor(workers) as pool:
            errors = [e for e in pool.map(one, todo) if e]
        report.tables += [k for k in todo if k in state.state["committed"]]
        if errors:
            raise errors[0]
    return state


def _marks(spark: SparkSession, spec: dict, target: Warehouse, dumped: Database) -> None:
    names = [p.split()[0] for p in marks.MARKS.split(", ")]
    captured = spark.createDataFrame([tuple(s.get(n) for n in names) for s in spec.get("sequences", [])], marks.MARKS)
    everything = manifest.database(spec).tables_frame(spark).select("schema", F.col("name").alias("table"))
    restored = dumped.tables_frame(spark).select("schema", F.col("name").alias("table"))
    own = marks.owned_marks(captured, restored, everything)
    current = target.marks()
    tables = {r["schema"] + "\0" + r["table"]: r["column"] for r in [*own.collect(), *current.collect()]}
    by_key = {t.key: tables[f"{t.schema}\0{t.name}"] for t in target.tables.values() if f"{t.schema}\0{t.name}" in tables and t.key in dumped.tables}
    if not by_key:
        return
    ids = marks.max_ids(Database(target.tables, {k: target.frame(k) for k in by_key}), by_key)
    target.write_marks(marks.synced(current, ids, own))

