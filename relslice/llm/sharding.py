"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash of their key into buckets that fit a task's memory and shuffles
each bucket with Fisher and Yates' algorithm; the buckets are written. Pass two reads the written buckets one
after the other as one random order of all records and cuts it into shards whose record counts differ by one at
most.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relslice.scratch import materialize

#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 8 << 20

#: Buckets at most; their counts, 16 bytes each, pass through the driver.
MAX_BUCKETS = 1 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniformly random order of 0 to n - 1, the same for the same seed and bucket."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = list(range(n))
    swap = rng.integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = swap[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def external_shuffle(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` as written buckets of a seeded random order, with the columns bucket and place (0 from each bucket's start).

    The order depends on the seed, the rows and the bucket count only, so reruns agree: before a bucket is
    shuffled, its rows are put in the order of key, text digest and digest of all columns. Rows that share a key meet in one bucket;
    where that makes a bucket more than twice its memory (a key that holds much of the table), the bucket's rows
    are dealt to as many sub-buckets as it needs by the digest of all their columns and, where equal rows would fill
    one, in equal numbers (equal rows are interchangeable). Null keys and texts are values of their own. Clashing
    columns are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("bucket", "place")])
    weight = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64
    total = docs.agg(F.sum(weight).alias("bytes")).first()["bytes"] or 0
    buckets = min(MAX_BUCKETS, max(1, math.ceil(total / bucket_bytes)))
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets))
    heavy = docs.groupBy(spot.alias("bucket")).agg(F.sum(weight).alias("bytes")).where(F.col("bytes") > 2 * max(bucket_bytes, total / buckets)).collect()
    placed = docs.withColumn("bucket", spot * MAX_BUCKETS)
    if heavy:
        parts = docs.sparkSession.createDataFrame([(r["bucket"] * MAX_BUCKETS, math.ceil(r["bytes"] / bucket_bytes)) for r in heavy], "bucket long, __parts long")
        placed = placed.join(F.broadcast(parts), "bucket", "left").withColumn("__digest", F.when(F.col("__parts").isNotNull(), F.xxhash64(*docs.columns)))
        # Of equal rows that fill a bucket by themselves there are at most as many kinds as buckets.
        alike = placed.where("__digest is not null").groupBy("__digest").agg(F.sum(weight).alias("bytes")).where(F.col("bytes") > bucket_bytes)
        placed = placed.join(F.broadcast(alike.select("__digest", F.lit(True).alias("__alike"))), "__digest", "left")
        single = placed.where("__alike is null").withColumn("bucket", F.col("bucket") + F.coalesce(F.pmod("__digest", "__parts"), F.lit(0)))
        placed = single.select(*docs.columns, "bucket").unionByName(_evenly(placed.where("__alike"), docs.columns))
    schema = T.StructType([*placed.schema.fields, T.StructField("place", T.LongType())])
    placed = placed.withColumn("__row", F.xxhash64(*docs.columns))  # the last word on the order before the shuffle
    names = placed.columns

    def shuffle(table: pa.Table) -> pa.Table:
        digest = [-1 if t is None else zlib.crc32(t.encode()) for t in table.column(names.index(text)).to_pylist()]
        keys = table.column(names.index(key))
        whole = table.column(names.index("__row"))
        first = pc.sort_indices(pa.table({"k": keys, "d": pa.array(digest, pa.int64()), "w": whole}), sort_keys=[("k", "ascending"), ("d", "ascending"), ("w", "ascending")])
        order = fisher_yates(table.num_rows, seed, table.column(names.index("bucket"))[0].as_py())
        mixed = table.take(first.take(pa.array(order))).remove_column(names.index("__row"))
        return mixed.append_column("place", pa.array(np.arange(table.num_rows)))

    return materialize(placed.select(*names).groupBy("bucket").applyInArrow(shuffle, schema), "shuffled")


def _evenly(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows dealt to their bucket's parts by count, so it doesn't matter which of them is where; they are counted before they are shuffled."""
    kinds = rows.groupBy("bucket", "__parts", *[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("__n"))
    each = kinds.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    times = F.expr("__n div __parts + IF(__part < __n % __parts, 1, 0)")
    each = each.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return each.select(*[F.col(f"`{c}`") for c in columns], (F.col("bucket") + F.col("__part")).alias("bucket"))


def shard(docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot (its place in the shard, from 0 without gaps).

    Shard counts differ by one at most, whatever the texts' lengths; with fewer rows than shards some are empty.
    Columns, nulls and repeats as for :func:`external_shuffle`. The driver sees one count per bucket.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    mixed = external_shuffle(docs, seed, key, text, bucket_bytes)
    counts = sorted((r["bucket"], r["count"]) for r in mixed.groupBy("bucket").count().collect())
    n = sum(c for _, c in counts)
    starts = pd.DataFrame({"bucket": [b for b, _ in counts], "__start": np.cumsum([0, *[c for _, c in counts]])[:-1]}, dtype="int64")
    offsets = docs.sparkSession.createDataFrame(starts, "bucket long, __start long")
    at = mixed.join(F.broadcast(offsets), "bucket").withColumn("__at", F.col("__start") + F.col("place"))
    # Shard s holds the places from ceil(s * n / shards) on.
    at = at.withColumn("shard", F.expr(f"int((__at * {shards}L) div {max(n, 1)}L)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return at.withColumn("slot", F.col("__at") - first).drop("bucket", "place", "__start", "__at")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, **names: str) -> None:
    """Write the shards of ``docs`` under ``path`` as shard=N folders, each in slot order."""
    dealt = shard(docs, shards, seed, **names)
    dealt.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
