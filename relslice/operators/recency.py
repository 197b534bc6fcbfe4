"""Which rows count as recent, and how many of them a percentage takes."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relslice.catalog import NUMBERS, TableDef, base_type

#: Column names that tell when a row was made, the best first; compared without case.
RECENCY_COLUMNS = ("created_at", "creation_date", "createdat", "created_on", "createdon", "date", "timestamp", "updated_at", "updatedat")


def recency_column(table: TableDef) -> str | None:
    """The first recency column by priority, else a numeric single-column primary key, else none."""
    by_name = {c.name.lower(): c.name for c in table.columns}
    for name in RECENCY_COLUMNS:
        if name in by_name:
            return by_name[name]
    pk = table.single_pk
    # Key columns of serial types are numeric, too.
    if pk and (base_type(table.column(pk).type) in (*NUMBERS, "smallserial", "serial", "bigserial")):
        return pk
    return None


def recency_order(order_by: str, pk: str) -> list[Column]:
    """Most recent first, nulls last, ties by descending key: a total order."""
    first = F.col(f"`{order_by}`").desc_nulls_last()
    return [first] if order_by == pk else [first, F.col(f"`{pk}`").desc()]


#: Rows that one task may be asked to sort; of more, the last one is looked for first.
SORTED = 10_000

#: Values in about which a pass looks for the last one.
SAMPLE = 20_000


def most_recent(df: DataFrame, pk: str, order_by: str, n: int) -> DataFrame:
    """The keys of the ``n`` most recent rows.

    Up to SORTED rows come from a top-n sort. Of more, the n-th value in the order is found by :func:`nth_value`, and
    every task keeps its own rows down to that value; nothing is sorted or gathered.
    """
    if n <= SORTED:
        return df.orderBy(*recency_order(order_by, pk)).limit(n).select(pk)
    names = list(dict.fromkeys([order_by, pk]))
    last = nth_value(df, names, n)
    if last is None:
        return df.select(pk)
    kinds = [df.schema[c].dataType for c in names]
    reached = _struct(names) >= _literal(names, kinds, last)
    # Also as a plain comparison, by which files can be skipped; the ranges that they keep of floats leave NaN out.
    if last[0] is not None and not isinstance(kinds[0], (T.FloatType, T.DoubleType)):
        reached = (F.col(f"`{order_by}`") >= _value(kinds[0], last[0])) & reached
    return df.where(reached).select(pk)


def nth_value(df: DataFrame, names: list[str], n: int) -> tuple | None:
    """The ``n``-th greatest combination of some columns, nulls least; None if there are no more than ``n`` rows.

    Each pass draws about SAMPLE of the rows that may still hold it, picks two values around its expected place, and
    counts exactly on which side it is, so the rows left shrink about fiftyfold, until one more sample can hold them all.
    Values go to and from the driver in a form that keeps them exactly.
    """
    kinds = [df.schema[c].dataType for c in names]
    left, rows = n, df.select(*[F.col(f"`{c}`") for c in names])
    size = rows.count()
    if n >= size:
        return None
    v, seed = _struct(names), 0
    while True:
        seed += 1
        part = rows if size <= SAMPLE else rows.sample(SAMPLE / size, seed=seed)
        drawn = part.orderBy(v.desc()).limit(2 * SAMPLE).select(*[_plain(c, k).alias(f"c{i}") for i, (c, k) in enumerate(zip(names, kinds, strict=True))])
        found = [tuple(r) for r in drawn.collect()]
        if size <= SAMPLE:
            return found[left - 1]
        place, slack = left / size * len(found), 3 * math.sqrt(len(found)) / 2 + 1
        first, second = math.floor(place - slack), math.ceil(place + slack)
        high = found[first] if 0 <= first < len(found) else None
        low = found[second] if second < len(found) else None
        above = F.lit(False) if high is None else v > _literal(names, kinds, high)
        down_to = F.lit(True) if low is None else v >= _literal(names, kinds, low)
        a, b = rows.agg(F.count_if(above), F.count_if(down_to)).first()
        if left <= a:
            rows, size = rows.where(above), a
        elif left > b:
            rows, size, left = rows.where(~down_to), size - b, left - b
        elif high is not None and high == low:
            return high
        else:
            rows, size, left = rows.where(~above & down_to), b - a, left - a


def _struct(names: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])


def _literal(names: list[str], kinds: list[T.DataType], values: tuple) -> Column:
    return F.struct(*[_value(k, x).alias(f"c{i}") for i, (k, x) in enumerate(zip(kinds, values, strict=True))])


def _plain(name: str, kind: T.DataType) -> Column:
    """A column in a form that no time zone changes on its way to the driver."""
    c = F.col(f"`{name}`")
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("string") if isinstance(kind, T.TimestampNTZType) else c


def _value(kind: T.DataType, value) -> Column:
    """What :func:`_plain` has brought to the driver, as a value of its own type."""
    if isinstance(kind, T.TimestampType) and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def most_recent_per_parent(df: DataFrame, pk: str, order_by: str, parent: Iterable[str], n: int) -> DataFrame:
    """The keys of the ``n`` most recent rows of each parent."""
    by = Window.partitionBy(*parent).orderBy(*recency_order(order_by, pk))
    return df.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= n).select(pk)


def percent_limit(count: int, percent: int) -> int:
    """``percent`` of ``count`` rows, rounded up; 1 at least, but 0 of nothing."""
    return max(1, math.ceil(count * percent / 100)) if count else 0


def is_pure_join_table(table: TableDef) -> bool:
    """Whether a table only joins others: a composite key made of foreign key columns, and no recency column."""
    if len(table.pk) < 2 or any(c.name.lower() in RECENCY_COLUMNS for c in table.columns):
        return False
    referencing = {c for f in table.fks for c in f.columns}
    return set(table.pk) <= referencing
