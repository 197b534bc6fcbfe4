"""Dumps: whole tables or closed subsets as NDJSON row files with a manifest."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from relslice.catalog import Database, TableDef, Transformed, apply_transform, key_or_row_id, with_row_id
from relslice.functions.redact import redacted as redacted_column
from relslice.functions.redact import sensitive_columns
from relslice.operators.chunks import DEFAULT_CHUNK, MAX_CHUNK, export_chunks, files_state
from relslice.operators.closure import Plan, check_integrity, closure_of_percent, closure_of_seeds, exported
from relslice.operators.predicates import Limits, Seed
from relslice.plans.graph import fk_order
from relslice.plans.selection import schema_scope, select_tables
from relslice.sources import fs, manifest, ndjson

#: Tables exported at the same time at most.
MAX_WORKERS = 16


@dataclass
class Strategy:
    """How one table is exported; a plan validator sees these before anything is written."""

    table: str
    kind: str
    keys: tuple[str, ...] = ()


def check_options(percent: int | None, seeds: Iterable[Seed] | None, chunk: Iterable[str], chunk_size: int, workers: int) -> None:
    """Refuse combinations that can't be run, before any job starts."""
    if percent is not None and seeds:
        raise ValueError("give a percentage or seeds, not both")
    if percent is not None and not 1 <= percent <= 100:
        raise ValueError("the percentage must be from 1 to 100")
    subset = percent is not None or bool(seeds)
    if not 1 <= workers <= MAX_WORKERS:
        raise ValueError(f"workers must be from 1 to {MAX_WORKERS}")
    if workers > 1 and (subset or chunk):
        raise ValueError("workers can't be combined with a subset or chunks")
    if chunk and subset:
        raise ValueError("chunks can't be combined with a subset")
    if not 1 <= chunk_size <= MAX_CHUNK:
        raise ValueError(f"a chunk has 1 to {MAX_CHUNK} rows")


def dump(
    db: Database,
    out: str,
    *,
    schemas: Iterable[str] = (),
    exclude_schemas: Iterable[str] = (),
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    seeds: Iterable[Seed] | None = None,
    percent: int | None = None,
    limits: Limits | None = None,
    redacted: bool = False,
    transform: Callable[[TableDef, DataFrame], Transformed] | None = None,
    chunk: Iterable[str] = (),
    chunk_size: int = DEFAULT_CHUNK,
    require_safe_key: bool = False,
    workers: int = 1,
    sequences: list[dict] | None = None,
    on_plan: Callable[[list[Strategy]], None] | None = None,
    strict: bool = False,
) -> dict:
    """Export tables below ``out`` and return the manifest, which is written last.

    Each table is one Spark job over the files its DataFrame was defined on; if any of these has changed by the end, the
    dump is an error and gets no manifest, so all tables are of one state. The written files are read once for the
    dump's inventory. Subset exports are in key order.
    Chunked tables resume after an interruption when ``out`` and all options are the same; other tables are
    written anew. ``transform`` changes rows after redaction, keeping the columns (see
    :func:`~relslice.catalog.apply_transform`). ``strict`` refuses a subset with orphans (possible below tables
    without a single-column key).
    """
    seeds, chunk = list(seeds or ()), list(chunk)
    check_options(percent, seeds, chunk, chunk_size, workers)
    spark = next(iter(db.frames.values())).sparkSession
    started = time.time()
    if fs.has_text(spark, f"{out}/metadata.json"):
        raise ValueError(f"{out} holds a finished dump")
    scope = schema_scope([t.schema for t in db.tables.values()], schemas or (), exclude_schemas)
    picked, selection = select_tables(db.only(k for k, t in db.tables.items() if t.schema in scope), include, exclude)
    plan: Plan | None = None
    if percent is not None:
        plan = closure_of_percent(picked, percent, limits)
    elif seeds:
        plan = closure_of_seeds(picked, seeds, limits)
    order = plan.order if plan else fk_order(picked)
    if plan and strict and (bad := [k for k, o in check_integrity(picked, plan).items() if o.limit(1).count()]):
        raise ValueError(f"the subset has orphans: {', '.join(f'{c} -> {p}' for c, p in bad)}")
    chunked = {picked.resolve(n).key for n in chunk}
    strategies = [Strategy(k, "subset" if plan else "chunk" if k in chunked else "stream", key_or_row_id(picked.tables[k], require_safe_key).columns if k in chunked else picked.tables[k].pk) for k in order]
    if on_plan:
        on_plan(strategies)
    # What all tables are read from, before the first job; frames keep to the files they were defined on.
    snapshot = {k: (files, files_state(spark, files)) for k in order if (files := sorted(picked.frames[k].inputFiles()))}

    def finished(table: TableDef, df: DataFrame) -> DataFrame:
        """Redacted and transformed rows; columns that aren't the table's own (places, chunks) go along."""
        types = {c.name: c.type for c in table.columns}
        if redacted:
            df = df.select(*[redacted_column(df[c], c, types[c]).cast(df.schema[c].dataType).alias(c) if c in types else df[c] for c in df.columns])
        return apply_transform(table, df, transform)

    def export(key: str) -> tuple[str, int]:
        table, df = picked.tables[key], picked.frames[key].select(*[c.name for c in picked.tables[key].columns])
        path = f"{out}/{manifest.data_file(table)}"
        if key in chunked:
            choice = key_or_row_id(table, require_safe_key)
            rows = with_row_id(picked.frames[key]) if choice.strategy == "row_id" else df
            names = [c.name for c in table.columns]
            return key, export_chunks(rows, path, key, choice, chunk_size, {"redacted": redacted}, names, lambda part: finished(table, part))
        rows = exported(picked, plan, key).select(*df.columns) if plan else df
        staged = f"{path}.__staged"
        fs.delete(spark, staged)
        fs.delete(spark, path)
        if plan and table.pk:
            keys = list(table.pk)
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        n = ndjson.write(finished(table, rows), staged)
        fs.rename(spark, staged, path)
        return key, n

    if workers > 1:
        with ThreadPoolExecutor(workers) as pool:
            counts = dict(pool.map(export, order))
    else:
        counts = dict(map(export, order))
    subset = None
    if plan:
        subset = {"percent": percent, "seeds": [asdict(s) for s in seeds], "limits": asdict(limits or Limits()), "rows_exported": counts, "rows_read": plan.rows_read}
    warned = {k: sensitive_columns(picked.tables[k]) for k in order if sensitive_columns(picked.tables[k])} if redacted else {}
    provenance = {"selection": selection, "strategies": [asdict(s) for s in strategies], "redacted_columns": warned, "elapsed_s": round(time.time() - started, 3)}
    manifest.take_inventory(spark, out, [picked.tables[k] for k in order], counts)
    if changed := [k for k, (files, state) in snapshot.items() if files_state(spark, files) != state]:
        raise ValueError(f"tables changed while they were dumped: {', '.join(changed)}")
    done = manifest.build(picked, counts, order, scope, provenance, subset, sequences)
    manifest.write(spark, out, done)
    return done
