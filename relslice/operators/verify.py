"""Comparison of two databases by row counts and id high-water marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice.catalog import INTEGERS, Database, base_type

MARKS = "schema string, table string, column string, last_value long, is_called boolean, min_value long, max_value long"


def row_counts(db: Database) -> DataFrame:
    """key, n_rows of every table."""
    frames = [df.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("key"), "n_rows") for k, df in db.frames.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def count_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    """key, source_rows, target_rows where two count tables differ; a missing table has null."""
    s, t = source.withColumnRenamed("n_rows", "source_rows"), target.withColumnRenamed("n_rows", "target_rows")
    return s.join(t, "key", "full_outer").where(~F.col("source_rows").eqNullSafe(F.col("target_rows")))


def max_ids(db: Database, columns: dict[str, str] | None = None) -> DataFrame:
    """schema, table, column, max_id: the largest value of each id column.

    ``columns`` names one id column per table; by default it is each identity or serial column, or else the
    integer single-column primary key.
    """
    frames = []
    for key, df in db.frames.items():
        t = db.tables[key]
        names = [columns[key]] if columns and key in columns else [] if columns else [c.name for c in t.columns if c.identity or "serial" in c.type.lower()]
        if not names and not columns and t.single_pk and base_type(t.column(t.single_pk).type) in INTEGERS:
            names = [t.single_pk]
        frames += [df.agg(F.max(F.col(f"`{n}`")).cast("long").alias("max_id")).select(F.lit(t.schema).alias("schema"), F.lit(t.name).alias("table"), F.lit(n).alias("column"), "max_id") for n in names]
    return reduce(lambda a, b: a.unionByName(b), frames)


_BY = ["schema", "table", "column"]


def synced(current: DataFrame, ids: DataFrame, captured: DataFrame | None = None) -> DataFrame:
    """Marks after a load: the greatest of the current, the captured and the largest loaded value, so none goes down.

    Bounds that would exclude the new value are dropped. Marks of tables without a row in ``current`` start from
    the other two.
    """
    keys = current.select(*_BY).unionByName(ids.select(*_BY)).distinct()
    joined = keys.join(current, _BY, "left").join(ids.select(*_BY, "max_id"), _BY, "left")
    got = captured.select(*_BY, F.col("last_value").alias("captured"), F.col("is_called").alias("captured_called")) if captured is not None else None
    joined = joined.join(got, _BY, "left") if got is not None else joined.withColumn("captured", F.lit(None).cast("long")).withColumn("captured_called", F.lit(None).cast("boolean"))
    value = F.greatest("last_value", "captured", "max_id")
    called = F.coalesce((F.col("max_id") == value), F.lit(False)) | F.coalesce((F.col("last_value") == value) & F.col("is_called"), F.lit(False)) | F.coalesce((F.col("captured") == value) & F.col("captured_called"), F.lit(False))

    def kept(bound: str, fits: Column) -> Column:
        return F.when(fits, F.col(bound)).alias(bound)

    return joined.select(*_BY, value.alias("last_value"), called.alias("is_called"), kept("min_value", F.col("min_value") <= value), kept("max_value", F.col("max_value") >= value))


def owned_marks(captured: DataFrame, restored: DataFrame, in_dump: DataFrame) -> DataFrame:
    """Captured marks of restored tables; those of tables left out are skipped, those of no table of the dump an error."""
    stray = captured.join(in_dump.select("schema", "table"), ["schema", "table"], "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"the mark of {stray[0]['schema']}.{stray[0]['table']} belongs to no table of the dump")
    return captured.join(restored.select("schema", "table"), ["schema", "table"], "left_semi")


def mark_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per mark of the source that the target has otherwise, with a message; a missing one counts as 0, not called."""
    t = target.select(*_BY, F.col("last_value").alias("t_value"), F.col("is_called").alias("t_called"))
    both = source.join(t, _BY, "left").withColumn("t_value", F.coalesce("t_value", F.lit(0))).withColumn("t_called", F.coalesce("t_called", F.lit(False)))
    problem = (
        F.when(F.col("last_value").isNull(), "unavailable")
        .when(F.col("last_value") != F.col("t_value"), F.concat(F.lit("last value "), F.col("last_value"), F.lit(" and "), F.col("t_value")))
        .when(F.col("is_called") != F.col("t_called"), "is_called differs")
    )
    return both.withColumn("problem", problem).where("problem is not null").select(*_BY, "problem")


def verify(spark: SparkSession, source: Database, target: Database, source_marks: DataFrame | None = None, target_marks: DataFrame | None = None, strict: bool = False) -> tuple[int, list[str]]:
    """(number of tables compared, warnings); with ``strict`` a warning is an error."""
    warnings = [f"{r['key']}: {r['source_rows']} rows in the source, {r['target_rows']} in the target" for r in count_mismatches(row_counts(source), row_counts(target)).orderBy("key").collect()]
    if source_marks is not None and target_marks is not None:
        warnings += [f"{r['schema']}.{r['table']}.{r['column']}: {r['problem']}" for r in mark_mismatches(source_marks, target_marks).orderBy(*_BY).collect()]
    if strict and warnings:
        raise ValueError("; ".join(warnings))
    return len(set(source.frames) & set(target.frames)), warnings
