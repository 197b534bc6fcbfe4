"""Seed predicates: validation against the catalog and translation to columns."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relslice.catalog import INTEGERS, NUMBERS, Database, TableDef, base_type, is_text, spark_type

#: Longer IN lists become a join.
IN_LIST = 500

_COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
OPERATORS = (*_COMPARE, "in", "is_null", "like", "ilike")


class SeedError(ValueError):
    """A seed that doesn't fit the catalog."""


@dataclass(frozen=True)
class Seed:
    """``table``.``column`` ``op`` value(s): the rows a subset starts from."""

    table: str
    column: str
    op: str
    values: tuple = ()


@dataclass
class Limits:
    """Bounds of a closure; ``max_rows`` counts rows read while planning, ``max_rows_per_table`` 0 is none.

    ``max_in_list_size`` is accepted for seed files and has no effect: keys are joined, not listed.
    """

    max_depth: int = 10
    max_tables: int = 50
    max_rows: int = 100_000
    max_rows_per_table: int = 0
    max_in_list_size: int = 500


@dataclass
class SeedFile:
    seeds: list[Seed] = field(default_factory=list)
    limits: Limits = field(default_factory=Limits)


def read_seed_file(text: str, **overrides: int) -> SeedFile:
    """Seeds and limits from JSON; limits not given have their defaults, ``overrides`` win over both."""
    spec = json.loads(text)
    seeds = [Seed(s["table"], s["column"], s["op"], tuple(s["values"]) if "values" in s else (s["value"],) if "value" in s else ()) for s in spec.get("seeds", [])]
    limits = {k: v for k, v in spec.get("limits", {}).items() if v}
    return SeedFile(seeds, Limits(**(limits | {k: v for k, v in overrides.items() if v is not None})))


def _literal_fits(kind: str, value: Any) -> bool:
    name = base_type(kind)
    if name in INTEGERS:
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if name in NUMBERS:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if name in ("boolean", "bool"):
        return isinstance(value, bool)
    if name == "uuid":
        try:
            return bool(uuid.UUID(value)) if isinstance(value, str) else False
        except ValueError:
            return False
    if name == "date" or name.startswith("timestamp"):
        if isinstance(value, (dt.date, dt.datetime)):
            return True
        try:
            dt.datetime.fromisoformat(value)
            return True
        except (TypeError, ValueError):
            return False
    return isinstance(value, str)


def check_seed(db: Database, seed: Seed) -> TableDef:
    """The seed's table, or a SeedError that says what is wrong with the seed."""
    try:
        table = db.resolve(seed.table)
    except ValueError as e:
        raise SeedError(str(e)) from None
    if table.single_pk is None:
        raise SeedError(f"seed table {table.key} has no single-column primary key")
    column = table.column(seed.column)
    if column is None:
        raise SeedError(f"table {table.key} has no column {seed.column!r}")
    if seed.op not in OPERATORS:
        raise SeedError(f"unknown operator {seed.op!r}")
    n = len(seed.values)
    if seed.op == "is_null" and n:
        raise SeedError("is_null takes no value")
    if seed.op == "in" and not n:
        raise SeedError("in takes one value at least")
    if seed.op not in ("in", "is_null") and n != 1:
        raise SeedError(f"{seed.op} takes exactly one value")
    if seed.op in ("like", "ilike"):
        if not is_text(column.type) and base_type(column.type) != "name":
            raise SeedError(f"{seed.op} needs a text column; {seed.column} is {column.type}")
        if not isinstance(seed.values[0], str):
            raise SeedError(f"{seed.op} takes a string")
    for v in seed.values:
        if v is None or not _literal_fits(column.type, v):
            raise SeedError(f"{v!r} is no value of {seed.column} ({column.type})")
    return table


def check_seeds(db: Database, seeds: Iterable[Seed]) -> list[tuple[TableDef, Seed]]:
    seeds = list(seeds)
    if not seeds:
        raise SeedError("a subset needs one seed at least")
    return [(check_seed(db, s), s) for s in seeds]


def condition(table: TableDef, seed: Seed) -> Column:
    """The seed as a boolean column; rows with a null only match is_null."""
    kind = spark_type(table.column(seed.column).type)
    column = F.col(f"`{seed.column}`")
    if seed.op == "is_null":
        return column.isNull()
    if seed.op in ("like", "ilike"):
        return getattr(column, seed.op)(seed.values[0])
    values = [F.lit(v).cast(kind) for v in seed.values]
    if seed.op == "in":
        return column.isin(*values)
    return _COMPARE[seed.op](column, values[0])


def any_of(conditions: Iterable[Column]) -> Column:
    """Conditions joined by OR; none is false."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def select_keys(df: DataFrame, table: TableDef, seed: Seed) -> DataFrame:
    """The primary keys of the seed's rows; a long IN list is joined."""
    pk = table.single_pk
    if seed.op == "in" and len(seed.values) > IN_LIST:
        kind = spark_type(table.column(seed.column).type)
        listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(seed.values)], ["__v"]).select(F.col("__v").cast(kind).alias("__v"))
        return df.join(listed, df[seed.column] == listed["__v"], "left_semi").select(pk)
    return df.where(condition(table, seed)).select(pk)


def filtered(df: DataFrame, conditions: Iterable[Column], order_by: Iterable[str] = ()) -> DataFrame:
    """The rows that any condition accepts, none if there are no conditions, in a total order if one is named."""
    out = df.where(any_of(conditions))
    order_by = list(order_by)
    return out.orderBy(*order_by) if order_by else out
