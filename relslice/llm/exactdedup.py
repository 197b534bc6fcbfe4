"""Exact deduplication as a Grace hash job.

Each task folds the copies among its own records in an open-addressing table that compares complete contents, and
spills one record per text. Spilled records are partitioned by a seeded hash of the content; a bucket that fits one
table is finished there. The records of a larger bucket are folded again in parts that fit, spilled, and
partitioned with another seed, until every bucket fits. So copies are combined before each shuffle, and no task
ever holds more than a table, however many copies a text has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relslice.llm.arrowmap import bounded_batches, column, give_back, spans
from relslice.scratch import materialize

#: Bytes of a bucket on average, and of the records that one table takes; several times as many, so that few buckets are too large.
BUCKET_BYTES, TABLE_BYTES = 512 << 10, 8 << 20

#: Rows that one table takes in the first pass; their keys stay with its records.
TABLE_ROWS = 1 << 16

#: Bytes that a record counts beside its text.
OVERHEAD = 64

#: Oversized buckets that are told to the tasks by broadcast at most; more are joined.
FEW = 100_000

#: Passes before giving up; each splits what is too large with a new seed.
MAX_LEVELS = 40

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class OpenTable:
    """Numbers texts by their complete contents: linear probing, doubled when it is two thirds full."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.hashes: list[int] = []
        self.slots = [-1] * 64

    def number(self, text: bytes) -> int:
        """The number of ``text``, from 0 in the order of first sight."""
        slots, hashes, h = self.slots, self.hashes, hash(text)
        mask = len(slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            if hashes[k] == h and self.texts[k] == text:
                return k
            at = (at + 1) & mask
        slots[at] = len(self.texts)
        self.texts.append(text)
        hashes.append(h)
        if 3 * len(hashes) > 2 * len(slots):
            self._double()
        return len(hashes) - 1

    def _double(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k


class Fold:
    """Records by text: how many rows each stands for, its largest key, where that row is, and its members."""

    def __init__(self) -> None:
        self.table, self.bytes = OpenTable(), 0
        self.rows: list[int] = []  # rows that the text stands for
        self.best: list[tuple] = []  # (has a key, key, record, place) of the row that stays
        self.numbers: list[int] = []  # of the texts, by member
        self.members: list = []

    def add(self, text: bytes, member, rows: int, best: tuple) -> None:
        """A member of a text; in the first pass its record and place in it aren't known yet."""
        k = self.table.number(text)
        if k == len(self.rows):
            self.rows.append(0)
            self.best.append(None)
            self.bytes += len(text) + OVERHEAD
        if best[2] is None:
            best = (*best[:3], self.rows[k])
        if self.best[k] is None or _later(best, self.best[k]):
            self.best[k] = best
        self.rows[k] += rows
        self.numbers.append(k)
        self.members.append(member)


def _later(a: tuple, b: tuple) -> bool:
    """Whether ``a`` is the row that stays: the larger key; of equal keys, that of the smaller record, or the earlier one."""
    if a[0] != b[0]:
        return a[0]
    if a[0] and a[1] != b[1]:
        return a[1] > b[1]
    return a[2] is not None and a[2] < b[2]


def _spilled(fold: Fold, records: list[int], schema: pa.Schema) -> pa.RecordBatch:
    """The table's records, with their members as lists in the order of arrival."""
    numbers = np.array(fold.numbers, np.int64)
    ends = np.cumsum(np.bincount(numbers, minlength=len(records)))
    members = pa.array(fold.members, schema.field("members").type.value_type).take(pa.array(np.argsort(numbers, kind="stable")))
    lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), members)
    texts = fold.table.texts
    best = [(b[1], records[k] if b[2] is None else b[2], b[3]) for k, b in enumerate(fold.best)]
    columns = [records, texts, [len(t) + OVERHEAD for t in texts], fold.rows, *([b[i] for b in best] for i in range(3))]
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)), lists.cast(schema.field("members").type)], schema=schema)


def _ddl(key: str, member: str) -> str:
    return f"record long, text binary, bytes long, n long, best {key}, best_record long, best_place int, members array<{member}>"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _lowered(texts: pa.Array) -> list[bytes]:
    """The texts in UTF-8 with A to Z in lower case; null is empty."""
    return [(t or b"").translate(_LOWER) for t in texts.cast(pa.binary()).to_pylist()]


def _first_pass(docs: DataFrame, key: str, text: str, member: str) -> DataFrame:
    """Records of the copies that each task finds among its rows, with the rows' ``member`` values."""
    ddl = _ddl(*(docs.schema[c].dataType.simpleString() for c in (key, member)))
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        fold = Fold()
        for whole in batches:
            for batch in spans(whole):
                for t, k, m in zip(_lowered(column(batch, text)), column(batch, key).to_pylist(), column(batch, member).to_pylist(), strict=True):
                    if fold.bytes + len(t) > TABLE_BYTES or len(fold.members) == TABLE_ROWS:
                        if fold.rows:
                            yield _spilled(fold, list(range(made, made + len(fold.rows))), schema)
                        made, fold = made + len(fold.rows), Fold()
                    fold.add(t, m, 1, (k is not None, k, None))
        if fold.rows:
            yield _spilled(fold, list(range(made, made + len(fold.rows))), schema)
        fold = None
        give_back()

    bounded_batches(docs.sparkSession)
    return docs.select(*dict.fromkeys([key, text, member])).mapInArrow(run, ddl)


def _merged(table: pa.Table) -> Fold:
    fold = Fold()
    names = ("text", "record", "n", "best", "best_record", "best_place")
    for t, r, n, best, record, place in zip(*(table[c].to_pylist() for c in names), strict=True):
        fold.add(t, r, n, (best is not None, best, record, place))
    return fold


def _fold_again(records: DataFrame, key: str) -> DataFrame:
    """Records of the groups (bucket, part); members are the records folded."""
    ddl = _ddl(key, "long")
    schema = _arrow(ddl)

    def run(table: pa.Table) -> pa.Table:
        fold, first = _merged(table), {}
        for k, r in zip(fold.numbers, fold.members, strict=True):
            first.setdefault(k, r)
        return pa.Table.from_batches([_spilled(fold, [first[k] for k in range(len(fold.rows))], schema)])

    return records.groupBy("bucket", "part").applyInArrow(run, ddl)


def _finished(records: DataFrame, key: str) -> DataFrame:
    """record, keep_id, best_record, best_place, group_size and digest for every record of buckets that fit."""
    ddl = f"record long, keep_id {key}, best_record long, best_place int, group_size long, text_sha256 binary"
    schema = _arrow(ddl)

    def run(table: pa.Table) -> pa.Table:
        fold = _merged(table)
        digest = [hashlib.sha256(t).digest() for t in fold.table.texts]
        rows = [(r, fold.best[k][1], fold.best[k][2], fold.best[k][3], fold.rows[k], digest[k]) for k, r in zip(fold.numbers, fold.members, strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return records.groupBy("bucket").applyInArrow(run, ddl)


def _grouped(records: DataFrame, key: str, level: int) -> DataFrame:
    """What :func:`_finished` says, for all spilled records, whatever the sizes of their buckets."""
    if level == MAX_LEVELS:
        raise RuntimeError(f"buckets don't fit after {MAX_LEVELS} passes")
    total = records.agg(F.sum("bytes")).first()[0] or 0
    bucket = F.pmod("spot", F.lit(max(1, -(-total // BUCKET_BYTES))))
    sizes = records.groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    # A bucket of one record can't be split. Of parts, each has two records or more on average.
    parts = F.least(F.ceil(F.col("bytes") / TABLE_BYTES), F.floor(F.col("n") / 2)).cast("long")
    large = materialize(sizes.where((F.col("bytes") > TABLE_BYTES) & (F.col("n") > 1)).select("bucket", parts.alias("parts")), "large")
    placed, many = records.withColumn("bucket", bucket).drop("members", "spot"), large.count()
    if not many:
        return _finished(placed, key)
    marked = placed.join(F.broadcast(large) if many <= FEW else large, "bucket", "left")
    apart = marked.where("parts is not null").withColumn("part", F.pmod(F.xxhash64(F.lit(level), "record"), "parts")).drop("parts")
    again = materialize(_fold_again(apart, key).withColumn("spot", F.xxhash64(F.lit(level + 1), "text")), f"spill-{level + 1}")
    up = _grouped(again, key, level + 1)
    back = again.select("record", "members").join(up, "record").drop("record").withColumn("record", F.explode("members")).drop("members")
    return _finished(marked.where("parts is null").drop("parts"), key).unionByName(back)


def _resolved(docs: DataFrame, key: str, text: str, member: str) -> DataFrame:
    """member, keep_id, group_size, kept and text_sha256 of every row."""
    spilled = materialize(_first_pass(docs, key, text, member).withColumn("spot", F.xxhash64(F.lit(0), "text")), "spill-0")
    groups = _grouped(spilled, docs.schema[key].dataType.simpleString(), 0)
    rows = spilled.select("record", "members").join(groups, "record").select("*", F.posexplode("members").alias("place", "member"))
    kept = (F.col("record") == F.col("best_record")) & (F.col("place") == F.col("best_place"))
    return rows.select("member", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: its key, keep_id, group_size, kept and text_sha256.

    Texts are equal if their bytes are after lower-casing A to Z only; null counts as empty. Of equal texts the row
    with the largest key stays; a null key is less than any other, and of rows that share that key exactly one is
    kept. ``text_sha256`` is the hexadecimal digest of the lower-cased text; equality is decided on complete
    contents, not on it. Other columns are ignored. An empty table gives an empty result. A few copies of a text must
    fit a task.
    """
    return _resolved(docs.select(key, text), key, text, key).withColumnRenamed("member", key)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were.

    Rows get numbers that are written with them, so of rows that share key and text one stays.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    numbered = materialize(docs.select(doc, F.monotonically_increasing_id().alias("row")), "numbered")
    rows = numbered.select(F.col("doc")[key].alias("key"), F.col("doc")[text].alias("text"), "row")
    stay = _resolved(rows, "key", "text", "row").where("kept").select(F.col("member").alias("row"))
    return numbered.join(stay, "row", "left_semi").select("doc.*")
