"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A text's set of word shingles is hashed once; each of 128 bins keeps its smallest hash, and an empty bin copies
that of a bin picked by its own hash sequence. Some bins make a band, texts with equal bands share a bucket, and
a bucket's candidates are the edges of a star from its most central text, so candidates grow with the texts, not
with their pairs. Texts that aren't linked with their centre get a new one among themselves, a few times over.
Links are confirmed on full sets.

So that no link hangs on the choice of centres, buckets whose texts are in several components by then are looked at
once more: the texts outside the bucket's largest component meet all its texts, in blocks of bounded size. Large
buckets are split before that by the texts' rarest shingles, of which linked texts have one in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relslice.llm.arrowmap import add_columns, column
from relslice.llm.components import connected_components
from relslice.llm.textcore import _STEP, distinct, mix, runs, shingles, space_words
from relslice.scratch import discard, materialize

BINS = 128

#: Stars that a bucket gets at most, each among the texts that the ones before haven't linked.
ROUNDS = 2

#: Texts on either side of a block comparison.
BLOCK = 1024

#: Blocks of a bucket from which on it is split by rarest shingles. A split multiplies a bucket's rows by the number of each
#: text's rare shingles, blocks multiply them by their own number.
SPLIT_BLOCKS = 4

#: Slots in which shingles are counted, a power of two.
SLOTS = 1 << 18

#: The chance at most that no band is shared by two texts that are just alike enough.
MISS = 1e-7

#: Parts that a large component is joined in.
SALTS = 32

_BITS = np.uint64(57)
_EDGES = np.arange(BINS, dtype=np.uint64) << _BITS
#: For each attempt, the bin that each empty bin looks at.
_DONORS = (mix(np.arange(4096 * BINS, dtype=np.uint64) + _STEP) >> _BITS).astype(np.int64).reshape(4096, BINS)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text; empty for null texts and texts without words."""
    out = []
    for _, b, offsets in runs(texts):
        text, h = space_words(b, offsets)
        ends, found = shingles(text, h, offsets.size - 1, k)
        out += [distinct(found[a:e]) for a, e in zip(ends, ends[1:], strict=False)]
    return out


def rows_per_band(percent: int) -> int:
    """The most bins per band (4, 2 or 1) with which a link at ``percent`` is missed with probability MISS at most."""
    for r in (4, 2, 1):
        if 0 < percent <= 100 and (1 - (percent / 100) ** r) ** (BINS // r) <= MISS:
            return r
    raise ValueError(f"similarities from 12 to 100 per cent are found, not {percent}")


def band_keys(sets: list[np.ndarray], rows: int = 4) -> np.ndarray:
    """One 64-bit key per band of ``rows`` bins (columns) for each non-empty sorted set (rows); the band's number is part of the key."""
    bands = BINS // rows
    if not sets:
        return np.zeros((0, bands), np.int64)
    least = np.empty((len(sets), BINS), np.uint64)
    full = np.empty((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _EDGES)
        full[i] = at < np.append(at[1:], s.size)
        least[i] = s[np.minimum(at, s.size - 1)]
    row, hole = np.nonzero(~full)
    for donors in _DONORS:
        if not row.size:
            break
        donor = donors[hole]
        found = full[row, donor]
        least[row[found], hole[found]] = least[row[found], donor[found]]
        row, hole = row[~found], hole[~found]
    for i, j in zip(row.tolist(), hole.tolist(), strict=True):  # one in 10**14: take the first full bin
        least[i, j] = least[i, int(full[i].argmax())]
    least = least.reshape(len(sets), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
    for j in range(rows):
        key = mix(key * _STEP + least[:, :, j])
    return key.view(np.int64)


def _set_ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.md5(s.tobytes()).digest() if s.size else None for s in sets], pa.binary())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def signatures(docs: DataFrame, k: int, text: str, rows: int = 4) -> DataFrame:
    """``docs`` without its text, with n_shingles, set_id (null for an empty set) and bands of ``rows`` bins (null likewise)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = shingle_sets(column(batch, text), k)
        size = np.array([s.size for s in sets], np.int64)
        keys = iter(band_keys([s for s in sets if s.size], rows))
        return [pa.array(size), _set_ids(sets), pa.array([next(keys) if n else None for n in size], pa.list_(pa.int64()))]

    return add_columns(docs, "n_shingles long, set_id binary, bands array<long>", make, drop=(text,))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, kept.

    Documents whose sets of ``k``-word shingles satisfy 100 * intersection >= percent * union are linked. Bands
    are as wide as ``percent`` allows: a link at just that similarity is missed once in 10**7 times at most; below 12
    per cent is an error.
    component_id is the smallest key that links lead to, the document's own included; kept says that it is the
    document's own. A text with fewer than ``k`` words has its whole sequence as one shingle; null texts, empty
    ones and those without words have no shingles and are linked with nothing. Equal texts are linked. Rows with
    a null key are linked like others but name no component, and are kept only in components without any key. Rows that
    repeat a key get a row each. Other columns are ignored. An empty table gives an empty result.
    """
    return _decided(docs, k, percent, key, text).select(F.col("key").alias(key), "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """key, set_id, n_shingles, component_id and kept of each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    signed = materialize(signatures(rows, k, "text", rows_per_band(percent)), "signatures")
    # Texts with equal sets count as one from here on.
    first = F.min(F.struct(F.col("key").isNull(), "key", "digest")).alias("first")
    sets = signed.where("set_id is not null").groupBy("set_id").agg(first, F.first("bands").alias("bands"))
    placed = sets.select("set_id", "first", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(placed.join(shared, "bucket"), "members")
    full = _full_sets(rows, members, k)
    stars, open_ = _stars(members, full, percent)
    links = materialize(stars.distinct(), "links")
    roots = connected_components(links, "a", "b")
    roots = _joined(roots, _rest(members, open_, roots, full, percent))
    firsts = signed.where("set_id is not null").groupBy("set_id").agg(F.min("key").alias("first_key"), F.count("*").alias("copies"))
    named = firsts.join(_named(roots, firsts), "set_id", "left").select("set_id", F.coalesce("least", "first_key").alias("component_id"), "copies")
    named = materialize(named, "named")
    for done in (members, full, links):
        discard(done)
    out = _join_by_set(signed.select("key", "n_shingles", "set_id"), named)
    component = F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select("key", "set_id", "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def _join_by_set(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with the component of their set.

    Sets of more than one thousandth of all rows, of which there are fewer than 1000, are broadcast, so that a set
    with very many copies doesn't land in one task.
    """
    total = named.agg(F.sum("copies")).first()[0] or 0
    hot = named.where(F.col("copies") * 1000 > total).select("set_id", F.col("component_id").alias("hot_component"), F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), "set_id", "left")
    cold = marked.where("hot is null").drop("hot_component", "hot").join(named.where(F.col("copies") * 1000 <= total).select("set_id", "component_id"), "set_id", "left")
    return cold.unionByName(marked.where("hot").drop("hot").withColumnRenamed("hot_component", "component_id"))


def _named(roots: DataFrame, firsts: DataFrame) -> DataFrame:
    """set_id and least, the smallest key of its component, for all sets that have a link.

    A component may hold much of the table, so the smallest keys go to its sets in SALTS parts.
    """
    linked = firsts.join(roots, firsts["set_id"] == roots["node"]).select("set_id", "first_key", "root")
    linked = materialize(linked.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int")), "linked")
    least = linked.groupBy("root").agg(F.min("first_key").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return linked.join(least, ["root", "salt"]).select("set_id", "least")


def _full_sets(rows: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """set_id and shingles of each text that shares a bucket, from the texts themselves: of each set its first key's."""
    wanted = members.select(F.col("first.key").alias("first_key"), F.col("first.digest").alias("first_digest")).distinct()
    some = rows.join(wanted, rows["key"].eqNullSafe(wanted["first_key"]) & (rows["digest"] == wanted["first_digest"]), "left_semi")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = shingle_sets(column(batch, "text"), k)
        return [_set_ids(sets), _lists(sets)]

    made = add_columns(some.select("text"), "set_id binary, shingles array<long>", make, drop=("text",))
    return materialize(made.where("set_id is not null").groupBy("set_id").agg(F.first("shingles").alias("shingles")), "sets")


def _stars(members: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links a, b; buckets of more than two texts, some of them without a link to their first centre).

    A bucket's centre is the text that shares most buckets with most others, first of all its texts, then of those
    that no centre of the bucket is linked with. A round's work is one comparison per text and bucket.
    """
    central = members.groupBy("set_id").agg(F.sum("size").alias("degree"))
    left = members.join(central, "set_id").select("bucket", "size", "set_id", "degree")
    links, open_, superseded = [], None, None
    for _ in range(ROUNDS):
        centres = left.groupBy("bucket").agg(F.max(F.struct("degree", "set_id")).alias("most"), F.count("*").alias("n")).where("n > 1")
        starred = left.join(centres.select("bucket", F.col("most.set_id").alias("centre")), "bucket").where("set_id != centre")
        starred = materialize(starred, "starred")
        star = _confirmed(starred.select("centre", "set_id").distinct(), full, percent)
        links.append(star.where("linked").select(F.col("centre").alias("a"), F.col("set_id").alias("b")))
        left = materialize(starred.join(star.where("not linked"), ["centre", "set_id"], "left_semi").select("bucket", "size", "set_id", "degree"), "outliers")
        discard(starred)
        if superseded is not None:
            discard(superseded)
        if open_ is None:
            open_ = materialize(left.where("size > 2").select("bucket").distinct(), "open")
        superseded = left
        if left.isEmpty():
            break
    return reduce(lambda x, y: x.unionByName(y), links), open_


def _alike(n_a: Column, n_b: Column, both: Column, percent: int) -> Column:
    return both.cast("long") * 100 >= (n_a.cast("long") + n_b - both) * percent


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """centre, set_id, linked for each pair, by the full sets."""
    b = full.select("set_id", F.col("shingles").alias("b"))
    a = full.select(F.col("set_id").alias("centre"), F.col("shingles").alias("a"))
    linked = _alike(F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b")), percent)
    return materialize(pairs.join(b, "set_id").join(a, "centre").select("centre", "set_id", linked.alias("linked")), "star")


def _mixed(some: DataFrame) -> DataFrame:
    """Buckets of ``some`` (bucket, set_id, root) with texts of several components, one of those with equal members: bucket, largest (component), n, n_out (texts outside it)."""
    same = [F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).alias("same1"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("same2")]
    sums = some.groupBy("bucket", "root").agg(F.count("*").alias("n"), *same)
    sums = sums.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.sum("same1").alias("same1"), F.bit_xor("same2").alias("same2"))
    mixed = sums.where("most.n < n").groupBy("n", "same1", "same2", "most").agg(F.min("bucket").alias("bucket"))
    return mixed.select("bucket", F.col("most.root").alias("largest"), "n", (F.col("n") - F.col("most.n")).alias("n_out"))


def _frequencies(full: DataFrame) -> np.ndarray:
    """About how often each shingle occurs, by SLOTS slots of hashes; the driver sees one number per slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(_slots(np.asarray(batch.column(0).flatten())), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in full.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles.astype(np.int64).view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)


def prefixes(sets: list[np.ndarray], often: np.ndarray, percent: int) -> list[np.ndarray]:
    """The rarest shingles of each set, so many that sets that are ``percent`` alike have one of theirs in common.

    Sets of n and m shingles that are alike share percent * n / 100 of the first set's at least, so the n - that + 1
    first ones of it, in an order that is the same for all sets, hold one that is among the first ones of the other, too.
    """
    out = []
    for s in sets:
        order = np.lexsort((s, often[_slots(s)]))
        out.append(s[order[: s.size - -(-percent * s.size // 100) + 1]])
    return out


def _by_rarest(some: DataFrame, large: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The texts of ``large`` buckets in a bucket for each of their rarest shingles, as a table: texts that are linked still share one.

    So texts that only have a template in common don't meet: what they share is what isn't rare.
    """
    wanted = some.join(large.select("bucket"), "bucket", "left_semi")
    sets = materialize(full.join(wanted.select("set_id").distinct(), "set_id", "left_semi"), "large-sets")
    often = _frequencies(sets)

    def rarest(batch: pa.RecordBatch) -> list[pa.Array]:
        found = prefixes([np.asarray(x.values) for x in column(batch, "shingles")], often, percent)
        return [_lists([f.astype(np.int64) for f in found])]

    first = add_columns(sets, "rarest array<long>", rarest, drop=("shingles",))
    spread = wanted.join(first, "set_id").select(F.col("bucket").alias("was"), "set_id", "root", F.explode("rarest").alias("shingle"))
    split = materialize(spread.select(F.xxhash64("was", "shingle").alias("bucket"), "set_id", "root"), "split")
    discard(sets)
    return split


def _rest(members: DataFrame, open_: DataFrame, roots: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, named by their roots, of texts that share an ``open_`` bucket.

    Buckets with the same members are looked at once; pairs within a component aren't. A bucket of more than
    SPLIT_BLOCKS blocks is split by its texts' rarest shingles first.
    """
    some = members.join(open_, "bucket", "left_semi").select("bucket", "set_id")
    some = some.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    some = materialize(some, "several")
    mixed = materialize(_mixed(some), "mixed")
    read = [some, mixed]
    large = mixed.where(F.col("n") > SPLIT_BLOCKS * BLOCK)
    if not large.isEmpty():
        split = _by_rarest(some, large, full, percent)
        mixed = mixed.where(F.col("n") <= SPLIT_BLOCKS * BLOCK).unionByName(_mixed(split))
        some = some.unionByName(split)
        read.append(split)
    blocks = [F.ceil(F.col(n) / BLOCK).cast("int").alias(b) for n, b in (("n", "blocks"), ("n_out", "out_blocks"))]
    mixed = mixed.select("bucket", "largest", *blocks)
    chosen = some.join(mixed, "bucket").withColumn("spot", F.xxhash64("set_id"))
    every, every_out = (F.explode(F.sequence(F.lit(0), F.col(b) - 1)) for b in ("blocks", "out_blocks"))
    block, out_block = (F.pmod("spot", b).cast("int") for b in ("blocks", "out_blocks"))
    all_ = chosen.select("bucket", "set_id", "root", block.alias("block"), every_out.alias("out_block"))
    outside = chosen.where("root != largest").select("bucket", "set_id", "root", every.alias("block"), out_block.alias("out_block"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        roots, sets = right["root"].to_pylist(), [np.asarray(x.values) for x in right["shingles"]]
        size = np.array([s.size for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        group: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while group.get(x, x) != x:
                x = group[x]
            return x

        found = []
        for a, s in zip(left["root"].to_pylist(), left["shingles"], strict=True):
            s = np.asarray(s.values)
            lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)])[:-1], hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for i in np.flatnonzero(100 * both >= percent * (size + s.size - both)).tolist():
                x, y = top(a), top(roots[i])
                if x != y:  # links that add nothing to the block's components are left out
                    group[x] = y
                    found.append((a, roots[i]))
        return pa.table([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], schema=schema)

    by = ["bucket", "block", "out_block"]
    names = [*by, "root", "shingles"]  # toDF gives either side columns of its own
    left = outside.join(full, "set_id").select(*names).toDF(*names)
    right = all_.join(full, "set_id").select(*names).toDF(*names)
    found = materialize(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "a binary, b binary"), "rest")
    for done in read:
        discard(done)
    return found


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``roots`` after further links between their roots."""
    if more.isEmpty():
        return roots
    above = connected_components(more, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # Roots that were components of their own have no row yet.
    alone = above.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return materialize(moved.unionByName(alone), "roots")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of :func:`near_duplicates`: the one with the smallest key.

    Rows with a null key stay; so do rows that repeat the kept key. Where a key repeats with texts of several
    components, each row goes or stays by its own.
    """
    decided = _decided(docs, k, percent, key, text).where("key is not null").select("key", "set_id", "kept")
    decided = materialize(decided.distinct(), "decided")
    judged = decided.groupBy(F.col("key").alias("__dropped")).agg(F.bool_or("kept").alias("__mixed"), F.bool_and("kept").alias("__all"))
    dropped = materialize(judged.where("not __all").select("__dropped", "__mixed"), "dropped")
    sure = docs.join(dropped, docs[key] == dropped["__dropped"], "left_anti")
    mixed = dropped.where("__mixed").select("__dropped")
    if mixed.isEmpty():
        return sure
    some = docs.join(mixed, docs[key] == mixed["__dropped"], "left_semi")
    some = add_columns(some, "__set_id binary", lambda b: [_set_ids(shingle_sets(column(b, text), k))])
    gone = decided.where("not kept").select(F.col("key").alias("__dropped"), F.col("set_id").alias("__gone"))
    stay = some.join(gone, (some[key] == gone["__dropped"]) & some["__set_id"].eqNullSafe(gone["__gone"]), "left_anti")
    return sure.unionByName(stay.drop("__set_id"))
