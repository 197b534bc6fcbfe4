"""Orders of tables and views along their dependencies. These graphs are catalog-sized and live on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from relslice.catalog import Database
from relslice.plans.selection import foreign_keys


def _edges(db: Database) -> dict[str, set[str]]:
    parents: dict[str, set[str]] = {k: set() for k in db.tables}
    for child, f in foreign_keys(db, whole=False):
        parents[child].add(f.parent)
    return parents


def fk_order(db: Database) -> list[str]:
    """All tables, parents first, ties by name; tables on or behind a cycle come last, by name."""
    parents = {k: p - {k} for k, p in _edges(db).items()}
    children: dict[str, list[str]] = {k: [] for k in parents}
    for child, ps in parents.items():
        for p in ps:
            children[p].append(child)
    missing = {k: len(p) for k, p in parents.items()}
    ready = [k for k, n in missing.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        key = heapq.heappop(ready)
        out.append(key)
        for child in children[key]:
            missing[child] -= 1
            if not missing[child]:
                heapq.heappush(ready, child)
    return out + sorted(set(parents) - set(out))


def fk_levels(db: Database) -> list[list[str]]:
    """Levels that can be loaded one after the other, each of any order within; a cycle or self-reference is an error."""
    parents, done, levels = _edges(db), set(), []
    while len(done) < len(parents):
        level = sorted(k for k, p in parents.items() if k not in done and p <= done)
        if not level:
            raise ValueError(f"foreign keys form a cycle: {', '.join(sorted(set(parents) - done))}")
        levels.append(level)
        done |= set(level)
    return levels


def view_order(depends: Mapping[str, set[str]], populated: set[str]) -> list[str]:
    """The populated views in an order in which each comes after those it reads; a cycle, or reading a view that isn't populated, is an error."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(view: str) -> None:
        if view in out:
            return
        if view in open_:
            raise ValueError(f"views form a cycle at {view}")
        open_.add(view)
        for other in sorted(depends.get(view, set()) & set(depends)):
            if other not in populated:
                raise ValueError(f"view {view} reads {other}, which is not populated")
            visit(other)
        open_.discard(view)
        out.append(view)

    for view in sorted(populated):
        visit(view)
    return out
