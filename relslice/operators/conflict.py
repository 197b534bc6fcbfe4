"""What a load does with rows whose key is already there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relslice.catalog import Database, TableDef
from relslice.functions.coerce import POSITION

POLICIES = ("error", "skip", "upsert")


class ConflictError(ValueError):
    """Rows that a load may not write."""


def conflict_key(table: TableDef, policy: str) -> tuple[str, ...] | None:
    """The primary key, else the first unique key by name; none is an error but under the policy error."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    found = table.pk or next((u.columns for u in sorted(table.uniques, key=lambda u: u.name) if u.eligible), None)
    if not found and policy != "error":
        raise ValueError(f"table {table.key} has no key to {policy} by")
    return found or None


def _on(a: DataFrame, b: DataFrame, keys: tuple[str, ...]):
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def one_per_key(rows: DataFrame, keys: tuple[str, ...], keep: str) -> DataFrame:
    """The first or last row of each key by its place in the dump; rows with a null in the key all stay.

    Repeated keys in rows without a place are an error when the frame is read.
    """
    solid = reduce(lambda x, y: x & y, [F.col(f"`{k}`").isNotNull() for k in keys])
    pick = F.min_by if keep == "first" else F.max_by
    # Each task keeps one row per key, so the rows of a key never meet.
    row = pick(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce(F.col(POSITION), F.lit(0)))
    by = rows.where(solid).groupBy(*[F.col(f"`{k}`") for k in keys])
    found = by.agg(row.alias("__row"), F.count("*").alias("__n"), F.bool_or(F.col(POSITION).isNull()).alias("__unplaced"))
    message = F.raise_error(F.lit("a key repeats in rows without a place")).cast("boolean")
    checked = found.where(F.when((F.col("__n") > 1) & F.col("__unplaced"), message).otherwise(True))
    return checked.select("__row.*").unionByName(rows.where(~solid))


def conflicts(target: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys (with a column ``problem``) that incoming rows share with the target or among themselves."""
    shared = incoming.join(target.select(*keys), list(keys), "left_semi").select(*keys).distinct().withColumn("problem", F.lit("exists"))
    twice = incoming.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1").select(*keys).withColumn("problem", F.lit("repeats"))
    return shared.unionByName(twice)


def appended(target: DataFrame, incoming: DataFrame, table: TableDef, policy: str) -> DataFrame | None:
    """The rows that a load adds to the target; None where it changes rows that are there (upsert)."""
    keys = conflict_key(table, policy)
    if policy == "error":
        if keys and (bad := conflicts(target, incoming, keys).limit(1).collect()):
            raise ConflictError(f"{table.key}: key {tuple(bad[0][k] for k in keys)} {bad[0]['problem']}")
        return incoming.select(*target.columns)
    if policy == "upsert" and _settable(target, table, keys):
        return None
    new = one_per_key(incoming, keys, "first")
    known = target.select(*[F.col(f"`{k}`").alias(f"__t{i}") for i, k in enumerate(keys)])
    on = reduce(lambda x, y: x & y, [new[k] == known[f"__t{i}"] for i, k in enumerate(keys)])
    return new.join(known, on, "left_anti").select(*target.columns)


def _settable(target: DataFrame, table: TableDef, keys: tuple[str, ...]) -> list[str]:
    return [c for c in target.columns if c not in keys and (d := table.column(c)) is not None and d.generated is None and d.identity != "ALWAYS"]


def merged(target: DataFrame, incoming: DataFrame, table: TableDef, policy: str) -> DataFrame:
    """The target's rows after loading ``incoming`` (which may have a place, __pos).

    error: any shared or repeated key is a ConflictError (checked here). skip: rows already there stay, of
    repeated keys the first counts. upsert: rows already there get the last incoming row's values but for the key,
    ALWAYS identity and generated columns; with no column left to set it is skip.
    """
    if (more := appended(target, incoming, table, policy)) is not None:
        return target.unionByName(more)
    keys, columns = conflict_key(table, policy), target.columns
    settable = _settable(target, table, keys)
    new = one_per_key(incoming, keys, "last").select(*[F.col(f"`{c}`").alias(f"__new_{i}") for i, c in enumerate(columns)], F.lit(True).alias("__in"))
    old = target.withColumn("__there", F.lit(True))
    on = reduce(lambda x, y: x & y, [old[k] == new[f"__new_{columns.index(k)}"] for k in keys])
    both = old.join(new, on, "full_outer")
    use_new = {c: F.col("__there").isNull() | (F.col("__in").isNotNull() if c in settable else F.lit(False)) for c in columns}
    return both.select(*[F.when(use_new[c], F.col(f"__new_{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)])


def inbound_fks(db: Database, replaced: set[str]) -> list[tuple[str, str]]:
    """(child, parent) of foreign keys that lead from tables that stay into tables that are replaced."""
    return sorted((t.key, f.parent) for t in db.tables.values() if t.key not in replaced for f in t.fks if f.parent in replaced)
