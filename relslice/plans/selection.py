"""Which schemas and tables a run works on."""

from __future__ import annotations

from collections.abc import Iterable

from relslice.catalog import Database, FkDef


def schema_scope(available: Iterable[str], include: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[str]:
    """The schemas in scope: those included (all, if none are named) less those excluded, in the order of naming.

    Names are trimmed and repeats dropped. Unknown names and an empty result are errors.
    """
    available = list(dict.fromkeys(available))
    wanted = list(dict.fromkeys(s.strip() for s in include if s.strip())) or available
    gone = {s.strip() for s in exclude if s.strip()}
    if unknown := [s for s in [*wanted, *sorted(gone)] if s not in available]:
        raise ValueError(f"unknown schemas: {', '.join(unknown)}")
    if not (left := [s for s in wanted if s not in gone]):
        raise ValueError("no schema is left after exclusions")
    return left


def partition_leaves(db: Database, parent: str) -> list[str]:
    """The tables without partitions of their own below ``parent``, at any depth, sorted."""
    below = [t.key for t in db.tables.values() if t.partition_of == parent]
    return sorted(leaf for k in below for leaf in (partition_leaves(db, k) or [k]))


def row_tables(db: Database) -> Database:
    """The database without partition parents: only leaves carry rows."""
    parents = {t.partition_of for t in db.tables.values() if t.partition_of}
    return db.only(k for k in db.tables if k not in parents)


def select_tables(db: Database, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> tuple[Database, dict]:
    """The selected tables, and the selection for the manifest (sorted lists, warnings).

    Includes narrow and excludes win. An unknown include is an error, an unknown exclude a warning. Including a
    partition parent is an error that names its leaves; excluding one excludes its leaves but those included by
    name.
    """
    parents = {t.partition_of for t in db.tables.values() if t.partition_of}
    include, exclude = list(include), list(exclude)
    wanted = [db.resolve(n).key for n in include]
    for key in wanted:
        if key in parents:
            raise ValueError(f"{key} is partitioned; include its partitions instead: {', '.join(partition_leaves(db, key))}")
    gone, warnings = set(), []
    for name in exclude:
        try:
            key = db.resolve(name).key
        except ValueError as e:
            if "ambiguous" in str(e):
                raise
            warnings.append(f"excluded table {name!r} does not exist")
            continue
        gone |= {leaf for leaf in partition_leaves(db, key) if leaf not in wanted} if key in parents else {key}
    keys = [k for k in row_tables(db).tables if (not wanted or k in wanted) and k not in gone]
    return db.only(keys), {"include": sorted(set(wanted)), "exclude": sorted(gone), "warnings": sorted(warnings)}


def exclude_for_restore(db: Database, exclude: Iterable[str]) -> Database:
    """The tables of a dump less those excluded; unknown or ambiguous names, and excluding all, are errors."""
    gone = {db.resolve(n).key for n in exclude}
    if gone and gone >= set(db.tables):
        raise ValueError("all tables are excluded")
    return db.only(k for k in db.tables if k not in gone)


def foreign_keys(db: Database, whole: bool = True) -> list[tuple[str, FkDef]]:
    """(child, foreign key) of all tables in a fixed order; with ``whole``, one that leaves the selection is an error."""
    found = sorted(((t.key, f) for t in db.tables.values() for f in t.fks), key=lambda x: (x[0], x[1].parent, x[1].columns, x[1].parent_columns, x[1].name))
    out = [(child, f) for child, f in found if f.parent in db.tables]
    if whole and len(out) < len(found):
        child, f = next(x for x in found if x[1].parent not in db.tables)
        raise ValueError(f"table {child} references {f.parent}, which is not selected; select it, too")
    return out
