"""Merkle manifests of a table: one tree per group of rows and one over the groups' roots, kept as a postorder log.

Leaves are numbered within their tree. Aligned builders each take a run of ARITY ** HEIGHT consecutive nodes of one
level and write the nodes above them in the order in which they are completed, each with its position in its
tree's postorder. That position has a closed form: what ``e`` leaves complete is, digit by digit of ``e`` to the base
ARITY, so many full subtrees, so a node's siblings are found by address and no pointers are kept. Builders
need nothing of each other but the top node of the run, from which the next layer is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relslice.scratch import materialize

#: Children of a node, and levels that one builder adds: a run is 729 nodes.
ARITY, HEIGHT = 3, 6

STEPS = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Hexadecimal SHA-256 of the values' own encodings: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    whole = F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    return F.sha2(whole.cast("binary"), 256)


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    level = 0
    while ARITY**level < leaves:
        level += 1
    return level


def positions(level: np.ndarray | int, at: np.ndarray, leaves: int) -> np.ndarray:
    """Postorder positions of the nodes ``at`` (from 0) of ``level`` in a tree of so many leaves.

    Before a node come the nodes that the leaves before its last leaf have completed, which is a sum of full
    subtree sizes, and its descendants that end with that leaf, one per level below.
    """
    last = np.minimum((np.asarray(at, np.int64) + 1) * ARITY ** np.int64(level), leaves) - 1
    before, rest, size = np.zeros_like(last), last.copy(), 1
    while (rest > 0).any():
        before += rest % ARITY * size
        rest //= ARITY
        size = ARITY * size + 1
    return before + level


def siblings(at: int, leaves: int) -> list[list[tuple[int, bool]]]:
    """For each level from a leaf to its root: the positions of the node's siblings, each with whether it is to the left."""
    out, level, count = [], 0, leaves
    while count > 1:
        run = [j for j in range(at // ARITY * ARITY, min(at // ARITY * ARITY + ARITY, count)) if j != at]
        out.append([(int(positions(level, np.array([j]), leaves)[0]), j < at) for j in run])
        level, at, count = level + 1, at // ARITY, -(-count // ARITY)
    return out


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with at (the row's place in its group by ``order``, from 0) and of (the group's rows), as a written table.

    One range partitioning and the counts of each partition give the places, so a group may be spread over any
    number of tasks. Rows that agree in ``order`` are placed in any order.
    """
    dealt = rows.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__salt")
    dealt = dealt.sortWithinPartitions(group, *order, "__salt").drop("__salt")
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    by = Window.partitionBy(group)
    upto = F.sum("__n").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    starts = counts.select(group, "__part", "__first", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(by).alias("of"))
    return dealt.join(starts, [group, "__part"]).withColumn("at", F.col("__row") - F.col("__first") + F.col("__before")).drop("__part", "__row", "__first", "__before")


@dataclass
class Log:
    """The written nodes of many trees, layer by layer: tree, of (leaves), level, at, pos, hash, top (a root), and the leaves' other columns."""

    layers: list[DataFrame]
    carry: list[str]

    def nodes(self) -> DataFrame:
        """All nodes; by tree and pos they are each tree's postorder."""
        out = self.layers[0]
        for layer in self.layers[1:]:
            out = out.unionByName(layer)
        return out

    def roots(self) -> DataFrame:
        return self.nodes().where("top").select("tree", F.col("hash").alias("root"))


def append_log(leaves: DataFrame, carry: Sequence[str] = ()) -> Log:
    """Build the trees of ``leaves``: tree (not null), at, of, hash, and ``carry`` columns that leaves keep."""
    fields = [f for f in leaves.schema.fields if f.name in carry]
    names = ["tree", "of", "level", "at", "pos", "hash", "top"]
    types = [T.StringType(), T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()]
    schema = T.StructType([*(T.StructField(n, t) for n, t in zip(names, types, strict=True)), *fields])
    layers, base = [], 0
    below = leaves.select("tree", "at", "of", "hash", *[f.name for f in fields])
    most = below.agg(F.max("of")).first()[0] or 0
    while True:
        run = F.expr(f"at div {ARITY**HEIGHT}").alias("run")
        layers.append(materialize(below.groupBy("tree", run).applyInArrow(_builder(base, [f.name for f in fields]), schema), f"log-{base}"))
        base += HEIGHT
        if ARITY**base >= most:
            return Log(layers, [f.name for f in fields])
        below = layers[-1].where((F.col("level") == base) & (F.col("of") > ARITY**base))


def _builder(base: int, carry: list[str]) -> Callable:
    """A function that writes the nodes above a run of nodes of level ``base``, and the run itself where it is leaves."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, of, first = table["tree"][0].as_py(), table["of"][0].as_py(), table["at"][0].as_py()
        level, hashes = base, table["hash"].to_pylist()
        made = [(level, first, hashes)] if base == 0 else []
        top = height(of)
        while level < min(base + HEIGHT, top):
            hashes = [hashlib.sha256("".join(hashes[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(hashes), ARITY)]
            level, first = level + 1, first // ARITY
            made.append((level, first, hashes))
        levels = np.concatenate([np.full(len(h), n) for n, _, h in made])
        ats = np.concatenate([np.arange(f, f + len(h)) for _, f, h in made])
        pos = np.concatenate([positions(n, np.arange(f, f + len(h)), of) for n, f, h in made])
        done = pa.array(np.argsort(pos))  # the order of completion
        rest = len(pos) - table.num_rows if base == 0 else len(pos)
        own = [pa.concat_arrays([*(table[c].chunks if base == 0 else []), pa.nulls(rest, table.schema.field(c).type)]) for c in carry]
        columns = [pa.array([tree] * len(pos)), pa.array(np.full(len(pos), of)), pa.array(levels.astype(np.int32)), pa.array(ats), pa.array(pos), pa.array([x for _, _, h in made for x in h]), pa.array(levels == top), *own]
        return pa.table(dict(zip(["tree", "of", "level", "at", "pos", "hash", "top", *carry], columns, strict=True))).take(done)

    return build


def proofs(log: Log, outer: DataFrame | None = None) -> DataFrame:
    """tree, at, hash, the log's carried columns, steps and root for every leaf; from ``outer`` (tree, root, steps), its root and steps follow.

    A step holds what is put before and after a node's hash to make its parent's: the left and the right siblings'
    hashes, found by their positions. From the top layer down, each run of nodes takes the steps of the node above it.
    """
    layers, carry = log.layers, log.carry
    roots = log.nodes().where("top").select("tree", "of", F.col("hash").alias("subroot"))
    if outer is None:
        ends = roots.select("tree", "of", "subroot", F.col("subroot").alias("root"), F.array().cast(STEPS).alias("steps"))
    else:
        ends = roots.join(outer.select("tree", "root", "steps"), "tree")
    ends = materialize(ends, "roots")
    above = None
    for i in reversed(range(len(layers))):
        base = i * HEIGHT
        whole = ends.where((F.col("of") <= ARITY ** (base + HEIGHT)) & ((F.col("of") > ARITY**base) | F.lit(base == 0)))
        upper = whole.select("tree", F.lit(0).cast("long").alias("run"), "subroot", "root", "steps")
        if above is not None:
            upper = upper.unionByName(above.select("tree", F.col("at").alias("run"), "subroot", "root", "steps"))
        nodes = layers[i].where(F.col("level") < base + HEIGHT)
        if i:
            nodes = layers[i - 1].where((F.col("level") == base) & (F.col("of") > ARITY**base)).unionByName(nodes)
        at_base = F.expr(f"at div cast(power({ARITY}, {base + HEIGHT} - level) AS bigint)")
        keep = carry if i == 0 else []
        segment = nodes.select("tree", at_base.alias("run"), "of", "level", "at", "pos", "hash", *keep)
        schema = T.StructType([segment.schema["tree"], segment.schema["at"], segment.schema["hash"], *[segment.schema[c] for c in keep], *T._parse_datatype_string(f"steps {STEPS}, subroot string, root string").fields])
        above = segment.groupBy("tree", "run").cogroup(upper.groupBy("tree", "run")).applyInArrow(_extractor(base, keep), schema)
        if i:
            above = materialize(above, f"proofs-{base}")
    return above


def _extractor(base: int, carry: list[str]) -> Callable:
    """A function from a run's nodes and the steps above it to the steps of each node of level ``base``."""

    def extract(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        pos, levels, hashes = nodes["pos"].to_numpy(), nodes["level"].to_numpy(), nodes["hash"].to_pylist()
        of = nodes["of"][0].as_py()
        leaves = nodes.filter(pa.array(levels == base))
        ats = leaves["at"].to_numpy()
        left, right, columns = [], [], []  # of each node that has a step; the step of each leaf, by level
        for level in range(base, min(base + HEIGHT, height(of))):
            mine = ats // ARITY ** (level - base)
            seen, step = np.unique(mine, return_inverse=True)
            columns.append(step + len(left))
            start = seen // ARITY * ARITY
            run = start[:, None] + np.arange(ARITY)
            there = run < -(-of // ARITY**level)
            where = np.searchsorted(pos, positions(level, np.where(there, run, start[:, None]), of))
            for i, j in enumerate(seen):
                kin = [hashes[w] for w, t in zip(where[i], there[i], strict=True) if t]
                left.append("".join(kin[: j - start[i]]))
                right.append("".join(kin[j - start[i] + 1 :]))
        for s in upper["steps"][0].as_py():
            columns.append(np.full(len(ats), len(left)))
            left.append(s["left"])
            right.append(s["right"])
        pick = pa.array(np.stack(columns, axis=1).reshape(-1) if columns else np.zeros(0, np.int64))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(pick), pa.array(right, pa.string()).take(pick)], ["left", "right"])
        steps = pa.ListArray.from_arrays(pa.array(np.arange(len(ats) + 1, dtype=np.int32) * len(columns)), steps)
        n = len(ats)
        same = [pa.array([upper[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        return pa.table([leaves["tree"], leaves["at"], leaves["hash"], *[leaves[c] for c in carry], steps, *same], names=["tree", "at", "hash", *carry, "steps", "subroot", "root"])

    return extract


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf's hash and the steps of its proof."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """Hexadecimal SHA-256 of all siblings' hashes, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


@dataclass
class Manifest:
    """The log of the groups' trees, and that of the tree over their roots, whose leaves carry the group as ``name``."""

    groups: Log
    top: Log

    def proofs(self) -> DataFrame:
        """tree, at, hash, carried columns, steps to the dataset's root, subroot and root for every row."""
        outer = proofs(self.top).select(F.col("name").alias("tree"), "root", "steps")
        return proofs(self.groups, outer)


def manifest(rows: DataFrame, group: str, order: Sequence[str], hashes: str, carry: Sequence[str] = ()) -> Manifest:
    """The trees of ``rows`` by ``group``, leaves ascending by ``order``, over the column of leaf hashes.

    Groups ascend bytewise, null first, and are leaves of the top tree in that order. Null orders come first; rows of one
    order ascend by hash, and equal ones are interchangeable. An empty table has no trees.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), *order, F.col(hashes).alias("hash"), *[c for c in carry if c not in order])
    groups = append_log(ranked(leaves, "tree", [*order, "hash"]), carry)
    roots = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("hash"))
    return Manifest(groups, append_log(ranked(roots, "tree", ["name"]), ["name"]))


def read_proof(log: Log, tree: str, at: int, leaves: int) -> list[tuple[str, str]]:
    """The steps of one leaf within its tree, read by position: a few rows of the log."""
    wanted = siblings(at, leaves)
    there = [p for level in wanted for p, _ in level]
    found = {r["pos"]: r["hash"] for r in log.nodes().where((F.col("tree") == tree) & F.col("pos").isin(there)).select("pos", "hash").collect()}
    return [tuple("".join(found[p] for p, before in level if before == side) for side in (True, False)) for level in wanted]
