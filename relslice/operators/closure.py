"""Referentially closed subsets: breadth-first closure over foreign keys in both directions, by set joins.

Each level joins whole frontiers, one join per foreign key, and writes the new keys to the shared folder, so the
plan of a level never contains the levels before it. Keys stay DataFrames; the driver sees counts only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relslice.catalog import Database, FkDef, TableDef
from relslice.operators.predicates import Limits, Seed, check_seeds, select_keys
from relslice.operators.recency import is_pure_join_table, most_recent, percent_limit, recency_column
from relslice.plans.graph import fk_order
from relslice.plans.selection import foreign_keys
from relslice.scratch import discard, materialize, materialize_bucketed, materialize_counted

#: Hops of one level that run at the same time.
HOPS = 8

#: Key and foreign key columns of so many bytes at least are kept in buckets once they are used again.
EDGE_BYTES = 256 << 20

#: Sizes from here on are what Spark says of frames whose size it doesn't know.
UNKNOWN_BYTES = 1 << 60


class SubsetLimitError(ValueError):
    """A closure went over one of its limits."""

    def __init__(self, limit: str, message: str):
        super().__init__(f"{limit}: {message}")
        self.limit = limit


@dataclass
class Plan:
    """The keys a subset exports, by table.

    ``keys`` holds a one-column frame per table with a single-column primary key. Other tables aren't traversed:
    ``members`` names, for those reached as children, the foreign keys whose parents are in the plan, and takes the
    rows whose parents all are; ``required`` holds, for those that rows of the plan refer to, the values of the
    referenced columns, and takes the rows that have them. ``order`` lists the tables, parents first.
    """

    keys: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    members: dict[str, list[FkDef]] = field(default_factory=dict)
    required: dict[str, dict[tuple[str, ...], DataFrame]] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    rows_read: int = 0


def _semi(left: DataFrame, left_on: Iterable[str], right: DataFrame, right_on: Iterable[str], how: str = "left_semi") -> DataFrame:
    renamed = {c: f"__k{i}" for i, c in enumerate(right_on)}
    keys = right.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    on = reduce(lambda a, b: a & b, [left[a] == keys[b] for a, b in zip(left_on, renamed.values(), strict=True)])
    return left.join(keys, on, how)


class _Closure:
    def __init__(self, db: Database, limits: Limits):
        self.db, self.limits, self.plan = db, limits, Plan()
        self.as_child: set[str] = set()
        self.needed: set[tuple[str, str]] = set()
        #: Rows added to each table at the level before.
        self.new_rows: Counter = Counter()
        self.hops: Counter = Counter()
        self.adjacent: dict[tuple, DataFrame] = {}
        found = foreign_keys(db)
        self.parents = {k: [f for child, f in found if child == k] for k in db.tables}
        self.children = {k: [(child, f) for child, f in found if f.parent == k] for k in db.tables}

    def charge(self, rows: int) -> None:
        self.plan.rows_read += rows
        if self.plan.rows_read > self.limits.max_rows:
            raise SubsetLimitError("max_rows", f"more than {self.limits.max_rows} rows were read")

    def enter(self, table: str, depth: int) -> None:
        """Check the limits for a row of ``table`` at ``depth``."""
        plan = self.plan
        if table not in plan.counts and len(plan.counts) >= self.limits.max_tables:
            raise SubsetLimitError("max_tables", f"table {table} would be one more than {self.limits.max_tables}")
        if depth > self.limits.max_depth:
            raise SubsetLimitError("max_depth", f"table {table} lies deeper than {self.limits.max_depth}")

    def register(self, table: str, depth: int) -> None:
        """Put a table that was reached as a child into the plan, without rows yet."""
        self.enter(table, depth)
        self.plan.counts.setdefault(table, 0)
        self.as_child.add(table)

    def require(self, child: str, rows: DataFrame, depth: int) -> Iterator[tuple[str, DataFrame]]:
        """Put the rows of tables that aren't traversed to which ``rows`` of ``child`` refer into the plan; they count as read.

        Yields (table, keys) of the traversed tables that these rows refer to in turn.
        """
        for f in self.parents[child]:
            if self.traversed(f.parent):
                continue
            values = rows.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(f.columns, f.parent_columns, strict=True)]).dropna().distinct()
            known = self.plan.required.setdefault(f.parent, {})
            old = known.get(f.parent_columns)
            if old is not None:
                values = _semi(values, f.parent_columns, old, f.parent_columns, "left_anti")
            values, n = materialize_counted(values, "required")
            if not n:
                continue
            self.needed.add((child, f.parent))
            self.enter(f.parent, depth)
            self.plan.counts.setdefault(f.parent, 0)
            known[f.parent_columns] = values if old is None else old.unionByName(values)
            found = _semi(self.db.frames[f.parent], f.parent_columns, values, f.parent_columns)
            self.charge(found.count())
            for g in self.parents[f.parent]:
                if self.traversed(g.parent):
                    yield g.parent, self.referenced(g, found)
            yield from self.require(f.parent, found, depth + 1)

    def add(self, table: str, reached: DataFrame, depth: int, most: int | None = None) -> DataFrame | None:
        """Add reached keys to the plan; returns the new ones (None if there are none).

        ``most`` cuts the new keys to the most recent so many.
        """
        pk = self.db.tables[table].single_pk
        new = reached.where(F.col(pk).isNotNull()).distinct()
        if table in self.plan.keys:
            new = _anti(new, self.plan.keys[table], pk)
        if most is not None:
            new = most_recent(_semi(self.db.frames[table], [pk], new, [pk]), pk, recency_column(self.db.tables[table]) or pk, most)
        new, n = materialize_counted(new, "keys")
        if not n:
            return None
        self.enter(table, depth)
        old = self.plan.keys.get(table)
        self.plan.keys[table] = new if old is None else old.unionByName(new)
        self.plan.counts[table] = self.plan.counts.get(table, 0) + n
        self.new_rows[table] += n
        return new

    def edges(self, child: str, fk: FkDef, by: tuple[str, ...]) -> DataFrame | None:
        """The key and foreign key columns of all rows of a large ``child``, in buckets of the columns ``by``.

        Written at the second hop that asks for it, so that a closure of one level doesn't pay for it; from then on,
        hops shuffle only their frontiers. Smaller tables have none: their frontiers or they themselves are broadcast.
        """
        self.hops[child, fk, by] += 1
        if self.hops[child, fk, by] == 2:
            df, pk = self.db.frames[child], self.db.tables[child].single_pk
            narrow = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([pk, *fk.columns])]).dropna(subset=list(fk.columns))
            size = int(narrow._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
            if EDGE_BYTES < size < UNKNOWN_BYTES:
                buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                self.adjacent[child, fk, by] = materialize_bucketed(narrow, list(by), buckets, "edges")
        return self.adjacent.get((child, fk, by))

    def parent_keys(self, child: str, fk: FkDef, frontier: DataFrame) -> DataFrame:
        """Primary keys of the parents of the frontier's rows, by the columns that the foreign key references."""
        pk = self.db.tables[child].single_pk
        if (edges := self.edges(child, fk, (pk,))) is not None:
            return self.referenced(fk, _semi(edges, [pk], frontier, [pk]))
        return self.referenced(fk, self.rows(child, frontier))

    def rows(self, table: str, keys: DataFrame) -> DataFrame:
        pk = self.db.tables[table].single_pk
        return _semi(self.db.frames[table], [pk], keys, [pk])

    def referenced(self, fk: FkDef, rows: DataFrame) -> DataFrame:
        """Primary keys of the traversed table that ``rows`` refer to by ``fk``."""
        parent = self.db.tables[fk.parent]
        pk = parent.single_pk
        values = rows.select(*[F.col(f"`{c}`") for c in fk.columns]).dropna().distinct()
        if fk.parent_columns == (pk,):
            return values.toDF(pk)
        return _semi(self.db.frames[fk.parent], fk.parent_columns, values, fk.columns).select(pk)

    def child_rows(self, child: str, fk: FkDef, frontier: DataFrame) -> DataFrame:
        """Rows of ``child`` whose parents are in the frontier."""
        parent = self.db.tables[fk.parent]
        if fk.parent_columns != (parent.single_pk,):
            frontier = _semi(self.db.frames[fk.parent], [parent.single_pk], frontier, [parent.single_pk])
        return _semi(self.db.frames[child], fk.columns, frontier, fk.parent_columns)

    def child_keys(self, child: str, fk: FkDef, frontier: DataFrame) -> DataFrame:
        """Primary keys of the rows of ``child`` whose parents are in the frontier."""
        parent, pk = self.db.tables[fk.parent], self.db.tables[child].single_pk
        if fk.parent_columns == (parent.single_pk,) and (edges := self.edges(child, fk, fk.columns)) is not None:
            return _semi(edges, fk.columns, frontier, fk.parent_columns).select(pk)
        return self.child_rows(child, fk, frontier).select(pk)

    def traversed(self, table: str) -> bool:
        return self.db.tables[table].single_pk is not None

    def finish(self) -> Plan:
        plan = self.plan
        for table in self.as_child:
            if not self.traversed(table):
                plan.members[table] = [f for f in self.parents[table] if f.parent in plan.counts]
        for child, parent in sorted(self.needed):
            if parent not in plan.counts:
                raise ValueError(f"closure integrity: rows of {child} refer to {parent}, which is not in the plan")
        plan.order = [k for k in fk_order(self.db) if k in plan.counts]
        return plan

    def close(self) -> None:
        for edges in self.adjacent.values():
            discard(edges)


def _anti(new: DataFrame, old: DataFrame, pk: str) -> DataFrame:
    known = old.select(F.col(pk).alias("__known"))
    return new.join(known, new[pk] == known["__known"], "left_anti")


def _counts(frames: dict) -> dict:
    """Row counts of several frames in one job."""
    if not frames:
        return {}
    names = list(frames)
    all_ = reduce(lambda a, b: a.unionByName(b), [frames[n].agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n") for i, n in enumerate(names)])
    return {names[r["i"]]: r["n"] for r in all_.collect()}


def closure_of_seeds(db: Database, seeds: Iterable[Seed], limits: Limits | None = None) -> Plan:
    """All rows that foreign keys lead to from the seeds' rows, in both directions.

    Rows read count towards ``max_rows``: the seeds' matches, one per visited row and foreign key, and every
    child of a visited row. A row at ``max_depth`` that leads anywhere, even back, is an error. With
    ``max_rows_per_table`` each level takes the most recent new children as far as the table has room; parents
    are always taken. Tables without a single-column primary key join the plan but their children aren't followed:
    as parents with the rows that are referred to, whose own parents are followed, as children with the rows whose
    planned parents all are in the plan.
    """
    run = _Closure(db, limits or Limits())
    try:
        return _from_seeds(run, db, seeds)
    finally:
        run.close()


def _from_seeds(run: _Closure, db: Database, seeds: Iterable[Seed]) -> Plan:
    frontier: dict[str, DataFrame] = {}
    checked = check_seeds(db, seeds)
    matches = {i: select_keys(db.frames[t.key], t, s) for i, (t, s) in enumerate(checked)}
    run.charge(sum(_counts(matches).values()))
    for key in dict.fromkeys(t.key for t, _ in checked):
        reached = reduce(lambda a, b: a.union(b), [m for i, m in matches.items() if checked[i][0].key == key])
        if (new := run.add(key, reached, 0)) is not None:
            frontier[key] = new
    depth, cap = 0, run.limits.max_rows_per_table
    while frontier:
        depth += 1
        sizes = {t: run.new_rows[t] for t in frontier}
        up = [(f.parent, run.parent_keys(t, f, front)) for t, front in frontier.items() for f in run.parents[t] if run.traversed(f.parent)]
        for t, front in frontier.items():
            up += run.require(t, run.rows(t, front), depth)
        # Each hop's join runs once; the budget is charged and keys are added from what it has written.
        down = {(c, f, t): f for t in frontier for c, f in run.children[t] if run.traversed(c) and not (cap and run.plan.counts.get(c, 0) >= cap)}
        # Hops of a level don't depend on each other, so their jobs run at the same time.
        down = {(c, f, t): run.child_keys(c, f, frontier[t]) for c, f, t in down}
        with ThreadPoolExecutor(HOPS) as pool:
            written = dict(zip(down, pool.map(lambda d: materialize_counted(d, "hop"), down.values()), strict=True))
        down, n_down = {k: w[0] for k, w in written.items()}, {k: w[1] for k, w in written.items()}
        if not cap:
            run.charge(sum(sizes[t] * len(run.parents[t]) for t in frontier) + sum(n_down.values()))
        if depth > run.limits.max_depth:
            n_up = _counts(dict(enumerate(d for _, d in up)))
            for table in [up[i][0] for i, n in n_up.items() if n] + [c for (c, _, _), n in n_down.items() if n]:
                run.enter(table, depth)
        for t in frontier:
            for c, _ in run.children[t]:
                if not run.traversed(c):
                    run.register(c, depth)
        following: dict[str, DataFrame] = {}
        run.new_rows = Counter()
        for table in sorted({p for p, _ in up} | {c for c, _, _ in down}):
            new = None
            parents = [d for p, d in up if p == table]
            if parents:
                new = run.add(table, reduce(lambda a, b: a.unionByName(b), parents), depth)
            kids = [d for (c, _, _), d in down.items() if c == table]
            if kids:
                room = cap - run.plan.counts.get(table, 0) if cap else None
                before = run.new_rows[table]
                more = run.add(table, reduce(lambda a, b: a.unionByName(b), kids), depth, room) if room is None or room > 0 else None
                if cap and more is not None:
                    run.charge(run.new_rows[table] - before)
                new = more if new is None else new if more is None else new.unionByName(more)
            if new is not None:
                following[table] = new
        if cap:
            run.charge(sum(sizes[t] * len(run.parents[t]) for t in frontier))
        for hop in down.values():
            discard(hop)
        frontier = following
    return run.finish()


def percent_roots(db: Database, percent: int) -> list[tuple[TableDef, str, int]]:
    """(table, recency column, row limit) of the tables that a percentage starts from.

    A root has a single-column primary key, rows, a recency column, no foreign key into the selection, and isn't
    a pure join table. Having none is an error.
    """
    fit = []
    for t in db.tables.values():
        order_by = recency_column(t)
        if t.single_pk and order_by and not is_pure_join_table(t) and not any(f.parent in db.tables for f in t.fks):
            fit.append((t, order_by))
    counts = _counts({t.key: db.frames[t.key] for t, _ in fit})
    roots = [(t, o, percent_limit(counts[t.key], percent)) for t, o in fit if counts[t.key]]
    if not roots:
        raise ValueError("no table can be the root of a percentage: it needs rows, a recency column or numeric key, and no foreign keys into the selection")
    return roots


def closure_of_percent(db: Database, percent: int, limits: Limits | None = None) -> Plan:
    """The most recent ``percent`` of each root table, and level by level the same share of the children in scope.

    At each level the tables reached by the level before are followed: all parents of their rows, then, for every
    child table once, the most recent ``percent`` of the rows whose parents are in the plan. ``max_rows_per_table``
    bounds each table, the budget of ``max_rows`` each sample; the walk ends at ``max_depth`` without an error.
    """
    if not 1 <= percent <= 100:
        raise ValueError("the percentage must be from 1 to 100")
    run = _Closure(db, limits or Limits())
    try:
        return _from_percent(run, db, percent)
    finally:
        run.close()


def _from_percent(run: _Closure, db: Database, percent: int) -> Plan:
    limits, plan = run.limits, run.plan
    for t, order_by, n in percent_roots(db, percent):
        budget = limits.max_rows - plan.rows_read
        if budget <= 0:
            raise SubsetLimitError("max_rows", f"more than {limits.max_rows} rows would be read")
        n = min(n, budget, limits.max_rows_per_table or n)
        new = run.add(t.key, most_recent(db.frames[t.key], t.single_pk, order_by, n), 0)
        run.charge(plan.counts.get(t.key, 0) if new is not None else 0)
    level = set(plan.counts)
    for depth in range(limits.max_depth):
        if not level:
            break
        expand, added, sampled = set(level), set(), set()
        for table in sorted(t for t in level if run.traversed(t)):
            for f in run.parents[table]:
                run.charge(plan.counts[table])
                if run.traversed(f.parent) and run.add(f.parent, run.parent_keys(table, f, plan.keys[table]), depth + 1) is not None:
                    expand.add(f.parent)
                    added.add(f.parent)
            for parent, keys in list(run.require(table, run.rows(table, plan.keys[table]), depth + 1)):
                if run.add(parent, keys, depth + 1) is not None:
                    expand.add(parent)
                    added.add(parent)
            for child, _ in run.children[table]:
                if not run.traversed(child):
                    run.register(child, depth + 1)
        for parent in sorted(t for t in expand if plan.counts.get(t)):
            for child, f in run.children[parent]:
                if child in sampled or not run.traversed(child):
                    continue
                sampled.add(child)
                run.enter(child, depth + 1)
                order_by = recency_column(db.tables[child])
                room = limits.max_rows_per_table - plan.counts.get(child, 0) if limits.max_rows_per_table else None
                if order_by is None or (room is not None and room <= 0):
                    continue
                scope = materialize(run.child_rows(child, f, plan.keys[parent]).select(*dict.fromkeys([order_by, db.tables[child].single_pk])), "scope")
                in_scope = scope.count()
                if not in_scope:
                    run.register(child, depth + 1)
                    continue
                budget = limits.max_rows - plan.rows_read
                if budget <= 0:
                    raise SubsetLimitError("max_rows", f"more than {limits.max_rows} rows would be read")
                n = min(percent_limit(in_scope, percent), budget, room if room is not None else budget)
                run.charge(min(n, in_scope))
                pk = db.tables[child].single_pk
                if run.add(child, most_recent(scope, pk, order_by, n), depth + 1) is not None:
                    added.add(child)
                discard(scope)
        level = added
    return run.finish()


def exported(db: Database, plan: Plan, table: str, above: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a table that a plan exports.

    Those of its keys; or, without a single-column key, those that rows of the plan refer to and, where it was
    reached as a child, those whose planned parents all are exported. ``above`` names tables that are being looked
    at, so that foreign keys in a circle end.
    """
    df, t = db.frames[table], db.tables[table]
    if t.single_pk:
        return _semi(df, [t.single_pk], plan.keys[table], [t.single_pk]) if table in plan.keys else df.limit(0)
    required = plan.required.get(table, {})
    members = plan.members.get(table)
    bound = [(f.columns, _planned(db, plan, f, (*above, table)), f.parent_columns) for f in members or () if f.parent not in (*above, table)]
    if not required:
        for columns, keys, theirs in bound:
            df = _semi(df, columns, keys, theirs)
        return df if bound else df.limit(0)
    # Either kind of membership: a flag for each set of keys.
    flags = []
    for columns, keys, theirs in [*((c, v, c) for c, v in required.items()), *bound]:
        flag = f"__in{len(flags)}"
        values = keys.select(*[F.col(f"`{c}`").alias(f"{flag}_{i}") for i, c in enumerate(theirs)]).distinct().withColumn(flag, F.lit(True))
        df = df.join(values, reduce(lambda a, b: a & b, [df[c] == values[f"{flag}_{i}"] for i, c in enumerate(columns)]), "left")
        flags.append(F.col(flag).isNotNull())
    keep = reduce(lambda a, b: a | b, flags[: len(required)])
    if bound:
        keep = keep | reduce(lambda a, b: a & b, flags[len(required) :])
    return df.where(keep).select(*db.frames[table].columns)


def _planned(db: Database, plan: Plan, f: FkDef, above: tuple[str, ...]) -> DataFrame:
    """The values of the columns that ``f`` refers to, of all rows of its parent that the plan exports."""
    if f.parent in plan.keys and f.parent_columns == (db.tables[f.parent].single_pk,):
        return plan.keys[f.parent]
    return exported(db, plan, f.parent, above).select(*[F.col(f"`{c}`") for c in f.parent_columns])


def orphans(child: DataFrame, fk: FkDef, parent: DataFrame) -> DataFrame:
    """Rows of ``child`` whose foreign key is set in all columns and has no row in ``parent``."""
    keys = parent.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(fk.parent_columns)])
    on = reduce(lambda a, b: a & b, [child[c] == keys[f"__k{i}"] for i, c in enumerate(fk.columns)])
    return child.dropna(subset=list(fk.columns)).join(keys, on, "left_anti")


def check_integrity(db: Database, plan: Plan) -> dict[tuple[str, str], DataFrame]:
    """The orphans that the export of a plan would have, by (child, parent); empty frames for a closed plan.

    All foreign keys that are set count, also those to tables that the plan leaves out.
    """
    out: dict[tuple[str, str], DataFrame] = {}
    for child in plan.order:
        for f in db.tables[child].fks:
            parent = exported(db, plan, f.parent) if f.parent in plan.counts else db.frames[f.parent].limit(0)
            found = orphans(exported(db, plan, child), f, parent)
            out[child, f.parent] = out[child, f.parent].unionByName(found) if (child, f.parent) in out else found
    return out
