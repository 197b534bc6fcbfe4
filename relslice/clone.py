"""Clones: a database's rows into a warehouse, directly, by dump and restore, or unchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from relslice.catalog import Database, TableDef, Transformed, apply_transform
from relslice.dump import dump
from relslice.functions.redact import redact
from relslice.operators import verify as marks
from relslice.plans.graph import fk_order, view_order
from relslice.plans.selection import row_tables
from relslice.restore import Report, restore
from relslice.scratch import fresh_path
from relslice.sources import fs
from relslice.sources.warehouse import Warehouse, table_schema

STRATEGIES = ("stream", "replay", "copy_as_is")


def clone(
    spark: SparkSession,
    db: Database,
    target: Warehouse,
    strategy: str = "stream",
    *,
    redacted: bool = False,
    transform: Callable[[TableDef, DataFrame], Transformed] | None = None,
    views: Mapping[str, tuple[str, set[str]]] | None = None,
    source_marks: DataFrame | None = None,
    statistics: str | None = None,
    **subset,
) -> Report:
    """Copy the row-carrying tables of ``db`` into ``target``.

    stream: each table is read, redacted, transformed and appended, parents first; ids' high-water marks never go
    down. replay: dump (``subset`` takes its seeds, percentage and limits), restore, recomputation of views
    (name -> SQL and the views it reads), statistics (in the session catalog's database ``statistics``, if named),
    verification. copy_as_is: rows unchanged; refused with redaction.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "copy_as_is" and (redacted or transform):
        raise ValueError("an unchanged copy can't redact or transform rows")
    if strategy != "replay" and (subset or views or statistics):
        raise ValueError("subsets, views and statistics need the strategy replay")
    rows = row_tables(db)
    if strategy == "replay":
        return _replay(spark, rows, target, redacted, transform, views or {}, source_marks, statistics, subset)
    report = Report(tables=fk_order(rows))
    for key in report.tables:
        table, df = rows.tables[key], rows.frames[key]
        if strategy == "stream":
            df = apply_transform(table, redact(table, df) if redacted else df, transform)
        target.stage(key, df.select(*[c.name for c in table.columns]), append=True)
    target.publish(report.tables)
    if source_marks is not None:
        columns = {t.key: r["column"] for r in source_marks.collect() for t in rows.tables.values() if (t.schema, t.name) == (r["schema"], r["table"])}
        ids = marks.max_ids(Database(target.tables, {k: target.frame(k) for k in columns}), columns)
        target.write_marks(marks.synced(target.marks(), ids, source_marks))
    return report


def _replay(spark, db, target, redacted, transform, views, source_marks, statistics, subset) -> Report:
    path = fresh_path(spark, "clone")
    sequences = [r.asDict() for r in source_marks.collect()] if source_marks is not None else None
    dump(db, path, redacted=redacted, transform=transform, sequences=sequences, **subset)
    report = restore(spark, path, target)
    refresh_views(spark, target, views)
    if statistics:
        analyze(spark, target, db.tables, statistics)
    if not subset:
        report.warnings += marks.verify(spark, db, target.database().only(db.tables), source_marks, target.marks() if source_marks is not None else None)[1]
    fs.delete(spark, path)
    return report


def analyze(spark: SparkSession, target: Warehouse, keys: Iterable[str], database: str) -> dict[str, str]:
    """Register loaded tables in the session catalog's ``database`` and compute table and column statistics.

    Returns the registered names, by key. A name that stands for another location is an error.
    """
    names = {}
    for key in keys:
        t, place = target.tables[key], target.location(key)
        name = f"`{database}`.`{t.name if t.schema == 'public' else f'{t.schema}_{t.name}'}`"
        if not fs.exists(spark, place):
            continue
        if spark.catalog.tableExists(name.replace("`", "")):
            known = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}.get("Location", "")
            if known.split(":", 1)[-1].lstrip("/") != place.split(":", 1)[-1].lstrip("/"):
                raise ValueError(f"{name} is another table, at {known}")
            spark.sql(f"REFRESH TABLE {name}")
        else:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table_schema(t).fields)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true') LOCATION '{place}'")
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
        names[key] = name
    return names


def refresh_views(spark: SparkSession, target: Warehouse, views: Mapping[str, tuple[str, set[str]]]) -> list[str]:
    """Recompute materialized views over the target, each after those it reads; returns them in that order.

    A view's SQL sees the target's tables and earlier views by their bare names. The results are written below
    the warehouse as views/<name>.
    """
    if not views:
        return []
    for key, t in target.tables.items():
        target.frame(key).createOrReplaceTempView(t.name)
    order = view_order({v: reads for v, (_, reads) in views.items()}, set(views))
    for name in order:
        path = f"{target.path}/views/{name}"
        fs.delete(spark, f"{path}.__staged")
        spark.sql(views[name][0]).write.parquet(f"{path}.__staged")
        fs.replace(spark, f"{path}.__staged", path)
        spark.read.parquet(path).createOrReplaceTempView(name)
    return order
