"""Product codes of vectors by k-means with Drake and Hamerly's adaptive bounds, in integers.

Vectors are cut into parts, each with a codebook of its own. Every part keeps, from round to round, the entry it is
assigned to with an upper bound of its distance, the b entries closest to it besides, with lower bounds in rising order,
and one lower bound for all others. After entries have moved, the bounds are moved by as much; where the upper bound
stays below all lower bounds nothing is computed. Else exact integer distances are, of the listed entries whose
bounds don't exclude them, or of all entries where the outer bound doesn't exclude those. b shrinks to what parts
needed in the round before. Rounding only ever loosens bounds, so assignments equal those of a full search.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relslice.llm.arrowmap import add_columns, bounded_batches, column
from relslice.scratch import discard, materialize

#: Share of the parts that may need more than the b entries they keep.
BEYOND = 0.01

#: Rows that are compared at a time.
ROWS = 2048


def finite(vector: str) -> Column:
    """Vectors that are not null and hold neither nulls nor components that aren't finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64) * (1 + 1e-12), np.inf).astype(np.float32) * np.float32(1 + 2e-7)


def _down(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return np.where(np.isinf(x), x, x - np.abs(np.where(np.isinf(x), 0, x)) * 4e-7 - 1e-30).astype(np.float32)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of integer vectors."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        d = x[:, i, None] - entries[None, :, i]
        out += d * d
    return out


@dataclass
class Bounds:
    """Of each row: the entry assigned, an upper bound of its distance, close entries with rising lower bounds, and one for all others."""

    own: np.ndarray
    up: np.ndarray
    near: np.ndarray
    low: np.ndarray
    out: np.ndarray

    def take(self, rows: np.ndarray, new: Bounds) -> None:
        for name in ("own", "up", "near", "low", "out"):
            getattr(self, name)[rows] = getattr(new, name)


def searched(x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
    """Bounds from a full search; of equal distances the smaller index is the nearer."""
    d = squared(x, entries)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
    rest = far[:, b + 1] if len(entries) > b + 1 else np.full(len(x), np.inf)
    return Bounds(order[:, 0].astype(np.uint8), _up(far[:, 0]), order[:, 1 : b + 1].astype(np.uint8), _down(far[:, 1 : b + 1]), _down(rest))


def moved(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Bring ``bounds`` up to date for entries that have moved by ``moves``; the return value is how many of the close
    entries each row had to look at, and their number plus one where it had to look at all."""
    b = bounds.near.shape[1]
    moves = np.nextafter(moves * (1 + 1e-12), np.inf)
    bounds.up = _up(bounds.up.astype(np.float64) + moves[bounds.own])
    bounds.out = _down(bounds.out.astype(np.float64) - moves.max())
    low = _down(bounds.low.astype(np.float64) - moves[bounds.near])
    # In rising order again: a bound may always be lowered to a later one.
    bounds.low = np.minimum.accumulate(np.concatenate([low, bounds.out[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :b]
    looked = np.zeros(len(x), np.int64)
    least = bounds.low[:, 0] if b else bounds.out
    open_ = np.flatnonzero(bounds.up >= least)
    if not len(open_):
        return looked
    own = ((x[open_] - entries[bounds.own[open_]]) ** 2).sum(axis=1)
    bounds.up[open_] = _up(np.sqrt(own.astype(np.float64)))
    prefix = (bounds.low[open_] <= bounds.up[open_, None]).sum(axis=1)
    everything = bounds.out[open_] <= bounds.up[open_]
    looked[open_] = np.where(everything, b + 1, prefix)
    rows = open_[everything]
    if len(rows):
        bounds.take(rows, searched(x[rows], entries, b))
    for q in range(1, b + 1):
        pick = ~everything & (prefix == q)
        rows = open_[pick]
        if not len(rows):
            continue
        ids = np.concatenate([bounds.own[rows, None], bounds.near[rows, :q]], axis=1)
        d = np.concatenate([own[pick, None], np.stack([((x[rows] - entries[ids[:, j]]) ** 2).sum(axis=1) for j in range(1, q + 1)], axis=1)], axis=1)
        best = np.lexsort((ids, d), axis=1)  # by distance, then index
        ids, d = np.take_along_axis(ids, best, axis=1), np.take_along_axis(d, best, axis=1)
        bounds.own[rows], bounds.up[rows] = ids[:, 0], _up(np.sqrt(d[:, 0].astype(np.float64)))
        near = np.concatenate([ids[:, 1:], bounds.near[rows, q:]], axis=1)
        low = np.concatenate([_down(np.sqrt(d[:, 1:].astype(np.float64))), bounds.low[rows, q:]], axis=1)
        order = np.argsort(low, axis=1, kind="stable")
        bounds.near[rows] = np.take_along_axis(near, order, axis=1)
        bounds.low[rows] = np.minimum(np.take_along_axis(low, order, axis=1), bounds.out[rows, None])
    return looked


def shortened(bounds: Bounds, b: int) -> Bounds:
    """Bounds that keep ``b`` close entries; the first of the others gives the outer bound."""
    if b >= bounds.near.shape[1]:
        return bounds
    return Bounds(bounds.own, bounds.up, bounds.near[:, :b].copy(), bounds.low[:, :b].copy(), np.minimum(bounds.out, bounds.low[:, b]))


#: What a part keeps between rounds, as rows of bytes, and its kinds.
_KEPT = {"own": np.uint8, "up": np.float32, "near": np.uint8, "low": np.float32, "out": np.float32}


def _blob(values: np.ndarray) -> pa.Array:
    """Each row's values as bytes."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // max(1, len(values))
    ends = np.arange(len(values) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.reshape(-1))]).cast(pa.binary())


def _unblob(blobs: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), *shape).copy()


@dataclass
class Codes:
    """The coded rows as a written table, and the codebooks as integers (parts, entries, components of a part)."""

    rows: DataFrame
    codebooks: np.ndarray

    def codebooks_sha256(self) -> str:
        """Hexadecimal SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, carry: Sequence[str] = ()
) -> Codes:
    """Fit codebooks on all rows and code them: key, ``carry``, code (two hexadecimal digits a part) and error (squared distance).

    Rows whose vector isn't :func:`finite` are left out. Components become floor(scale * x). Codebooks start as the
    parts of the ``entries`` rows of smallest key (nulls last; equal keys by vector), fewer if there are fewer. Each
    round assigns all parts, ties to the lower index, and moves each entry to the floor of its parts' mean; unused
    entries stay. A last assignment gives the codes. Repeated rows count as often as they occur. Other columns are
    ignored; an empty table gives an empty result without codebooks. All vectors must have one length, a multiple of ``parts``, and
    components small enough for exact 64-bit sums; anything else is an error.

    Every round is one pass over a written table without a shuffle; the driver sees sums per entry and component.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits, for 1 to 256 entries")
    good = vectors.select(key, vector, *carry).where(finite(vector))
    first = good.orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    if not first:
        return Codes(good.select(key, *carry, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64))
    length = len(first[0][0])
    if not length or length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    width = length // parts
    limit = 1 << ((62 - width.bit_length()) // 2 - 1)

    if any(len(r[0]) != length for r in first):
        raise ValueError(f"not all vectors have {length} components")

    def integers(flat: np.ndarray, rows: int) -> np.ndarray:
        made = np.floor(np.asarray(flat, np.float64) * scale)
        if (np.abs(made) >= limit).any():
            raise ValueError(f"components of {limit / scale} or more can't be coded")
        return made.astype(np.int64).reshape(rows, parts, width)

    books = integers(np.array([c for r in first for c in r[0]], np.float64), len(first)).transpose(1, 0, 2)
    k = books.shape[1]
    kept = T.StructType([f for f in good.schema.fields if f.name != vector])
    tally = "tally array<struct<part:int,entry:int,component:int,n:long,total:long>>"
    schema = T.StructType([*kept.fields, *T._parse_datatype_string("ints binary, own binary, up binary, near binary, low binary, out binary").fields, *T._parse_datatype_string(tally).fields])
    names = [f.name for f in kept.fields]

    def one_round(table: DataFrame, b: int, keep: int, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
        """Rows with their bounds for the codebooks ``new``, and in one row of each task the task's sums."""
        moves = None if old is None else np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, looks = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), Counter()
            held = None
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    rows = batch.num_rows
                    if moves is None:
                        vectors_ = column(batch, vector)
                        if (pc.list_value_length(vectors_).to_numpy(zero_copy_only=False) != length).any():
                            raise ValueError(f"not all vectors have {length} components")
                        x = integers(vectors_.flatten().to_numpy(zero_copy_only=False), rows)
                        state = [searched(x[:, p], new[p], b) for p in range(parts)]
                    else:
                        x = _unblob(column(batch, "ints"), np.int32, parts, width).astype(np.int64)
                        shapes = {"near": (b,), "low": (b,)}
                        old_ = {c: _unblob(column(batch, c), kind, parts, *shapes.get(c, ())) for c, kind in _KEPT.items()}
                        state = [shortened(Bounds(**{c: v[:, p].copy() for c, v in old_.items()}), keep) for p in range(parts)]
                        for p in range(parts):
                            looks.update(moved(x[:, p], new[p], moves[p], state[p]).tolist())
                    for p in range(parts):
                        n[p] += np.bincount(state[p].own, minlength=k)
                        np.add.at(total[p], state[p].own, x[:, p])
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([*held, pa.nulls(len(held[-1]), sums)], schema=made)
                    held = [*(column(batch, c) for c in names), _blob(x.astype(np.int32)), *(_blob(np.stack([getattr(s, c) for s in state], axis=1)) for c in _KEPT)]
            if held is not None:
                own = [{"part": p, "entry": e, "component": c, "n": int(n[p, e]), "total": int(total[p, e, c])} for p in range(parts) for e in range(k) if n[p, e] for c in range(width)]
                own += [{"part": -1, "entry": q, "component": 0, "n": m, "total": 0} for q, m in looks.items()]
                yield pa.RecordBatch.from_arrays([*held, pa.array([own, *[None] * (len(held[-1]) - 1)], sums)], schema=made)

        bounded_batches(table.sparkSession)
        return materialize(table.mapInArrow(run, schema), "codes")

    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(schema)
    sums = made.field("tally").type
    b = keep = min(max(1, k // 4), k - 1)
    table, old = good, None
    for _ in range(rounds):
        after = one_round(table, b, keep, old, books)
        if table is not good:
            discard(table)
        table, old, b = after, books, keep
        told = after.where("tally is not null").select(F.inline("tally")).groupBy("part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        books = books.copy()
        for r in told:
            if r["part"] >= 0:
                books[r["part"], r["entry"], r["component"]] = r["total"] // r["n"]
        keep = needed({r["entry"]: r["n"] for r in told if r["part"] < 0}, b, k)
    final = one_round(table, b, keep, old, books)

    def finish(batch: pa.RecordBatch) -> list[pa.Array]:
        own = _unblob(column(batch, "own"), np.uint8, parts)
        x = _unblob(column(batch, "ints"), np.int32, parts, width).astype(np.int64)
        error = sum(((x[:, p] - books[p][own[:, p]]) ** 2).sum(axis=1) for p in range(parts))
        return [pa.array([bytes(o).hex() for o in own], pa.string()), pa.array(error, pa.int64())]

    coded = materialize(add_columns(final.select(*names, "ints", "own"), "code string, error long", finish, drop=("ints", "own")), "coded")
    discard(final)
    return Codes(coded, books)


def needed(looks: dict[int, int], b: int, entries: int) -> int:
    """The close entries to keep after a round in which so many parts had to look at so many: the fewest that suffice
    for all but a share BEYOND of the parts, an eighth of the entries at least, and never more than before."""
    total, seen = sum(looks.values()), 0
    if not total:
        return b
    for q in range(b + 1):
        seen += looks.get(q, 0)
        if total - seen <= BEYOND * total:
            return min(b, max(q, entries // 8))
    return b


def decoded(codes: Codes, scale: int = 4096) -> DataFrame:
    """The coded rows with the vector that each code stands for, as ``approximation``."""
    books = codes.codebooks

    def look_up(batch: pa.RecordBatch) -> list[pa.Array]:
        own = np.array([list(bytes.fromhex(c)) for c in column(batch, "code").to_pylist()], np.int64).reshape(batch.num_rows, len(books))
        made = np.concatenate([books[p][own[:, p]] for p in range(len(books))], axis=1) / scale
        return [pa.array(list(made), pa.list_(pa.float64()))]

    return add_columns(codes.rows, "approximation array<double>", look_up)


def with_label_error(rows: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """``rows`` with label_error, the sum of ``error`` over equal labels; nulls are one label.

    Sums of the fewer than 1,000 labels that hold more than a thousandth of all rows are broadcast, others are joined.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    marked = rows.withColumn("__label", named)
    sums = materialize(marked.groupBy("__label").agg(F.sum(error).alias("label_error"), F.count("*").alias("__n")), "label-sums")
    hot = (sums.agg(F.sum("__n")).first()[0] or 0) // 1000
    large = marked.join(F.broadcast(sums.where(F.col("__n") > hot).withColumnRenamed("label_error", "__sum").drop("__n")), "__label", "left")
    rest = large.where("__sum is null").drop("__sum").join(sums.where(F.col("__n") <= hot).drop("__n"), "__label")
    return large.where("__sum is not null").withColumnRenamed("__sum", "label_error").unionByName(rest).drop("__label")
