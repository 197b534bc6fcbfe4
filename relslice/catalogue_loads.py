"""Queries of the driver on loads that are interrupted, files that are lost, and what is read or written of a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice.catalog import Database, describe
from relslice.catalogue import query, shop, table
from relslice.dump import dump
from relslice.functions.redact import scrub
from relslice.operators import recency
from relslice.restore import restore
from relslice.scratch import fresh_path, materialize
from relslice.sources import fs, manifest
from relslice.sources.warehouse import Warehouse
from relslice.streaming.exports import append_dump, table_stream


class _Ended(BaseException):
    """The end of a driver: nothing that handles errors sees it."""


class _Ending(Warehouse):
    """A warehouse whose driver ends when some tables have just been put into place, before that is noted anywhere else."""

    ends: set[str] = set()

    def place(self, key: str, load: str | None = None) -> None:
        super().place(key, load)
        if key in self.ends:
            self.ends.remove(key)
            raise _Ended


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def restore_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load with several workers whose driver ends three times; every row is there once, also of a table without a key."""
    db, path = shop(spark, sf_dir, "nation", "customer"), fresh_path(spark, "dump")
    o = table(spark, sf_dir, "orders")
    db = Database.of(*[(t, db.frames[k]) for k, t in db.tables.items()], (describe(o, "orders"), o))
    dump(db, path, workers=3)
    target = _Ending(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    target.ends = {"public.nation", "public.customer", "public.orders"}
    for _ in range(4):
        try:
            restore(spark, path, target, workers=3)
            break
        except _Ended:
            pass
    return target.frame("public.orders").join(target.frame("public.customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_totalprice", "c_name")


@query(" UNION ALL ".join(f"SELECT 'public.{t}' AS key, count(*) AS n_rows, 0 AS n_problems FROM {t}" for t in ("nation", "customer", "orders")))
def dump_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a dump's inventory has of its files, and the files that differ from it; one that is lost stops a load."""
    db, path = shop(spark, sf_dir, "nation", "customer", "orders"), fresh_path(spark, "dump")
    db.frames["public.orders"] = db.frames["public.orders"].repartition(4)
    dump(db, path)
    names = spark.createDataFrame([(manifest.data_file(t).rsplit("/", 1)[1], k) for k, t in db.tables.items()], "folder string, key string")
    rows = manifest.inventory(spark, path).join(names, "folder").groupBy("key").agg(F.sum("n_rows").alias("n_rows"))
    wrong = manifest.file_problems(spark, path, db.tables.values()).groupBy("key").agg(F.count("*").cast("int").alias("n_problems"))
    told = rows.join(wrong, "key", "left").na.fill(0, ["n_problems"]).collect()
    folder = f"{path}/{manifest.data_file(db.tables['public.orders'])}"
    fs.delete(spark, f"{folder}/{fs.files(spark, folder)[0]}")
    try:
        restore(spark, path, Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables)))
        raise AssertionError("a dump without one of its files was loaded")
    except ValueError as e:
        if "public.orders" not in str(e):
            raise
    return spark.createDataFrame([tuple(r) for r in told], "key string, n_rows long, n_problems int")


@query("""SELECT * REPLACE (CASE WHEN o_orderkey <= 100 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders
UNION ALL SELECT * REPLACE (-1 - o_orderkey AS o_orderkey, o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderkey <= 10""")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of a few keys into a table of several files rewrites only those that hold one of them."""
    db = shop(spark, sf_dir, "orders")
    key, t = "public.orders", db.tables["public.orders"]
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    whole = db.frames[key]
    for part in (whole.where("o_orderkey % 2 = 0").repartitionByRange(3, "o_orderkey"), whole.where("o_orderkey % 2 = 1").repartitionByRange(3, "o_orderkey")):
        target.stage(key, part, append=True)
        target.place(key)
    before = {f["path"]: f["low"] for f in target.live(key)["files"]}
    few = whole.where("o_orderkey <= 100").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    few = few.unionByName(few.where("o_orderkey <= 10").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    path = fresh_path(spark, "dump")
    dump(Database.of((t, few)), path)
    restore(spark, path, target, on_conflict="upsert")
    after = {f["path"] for f in target.live(key)["files"]}
    if any(int(low) > 100 and f not in after for f, low in before.items()) or not any(f not in after for f in before):
        raise AssertionError("an upsert rewrites the files that hold its keys, and no others")
    return target.frame(key)


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) <= (SELECT ceil(count(*) * 80 / 100.0) FROM orders)")
def recent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent 80% of all orders; at size no task sorts them."""
    o = table(spark, sf_dir, "orders")
    return recency.most_recent(o, "o_orderkey", "o_orderdate", recency.percent_limit(o.count(), 80))


@query("SELECT event_id, ts, user_id, event_type, value, CASE WHEN props IS NOT NULL THEN '[REDACTED]' END AS api_token FROM events")
def stream_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events exported batch by batch to a dump that is loaded; the first run ends between a batch's files and its record."""
    source = materialize(table(spark, sf_dir, "events").withColumnRenamed("props", "api_token").repartition(3), "stream")
    t, out, checkpoint = describe(source, "events", ["event_id"]), fresh_path(spark, "stream-dump"), fresh_path(spark, "stream-state")
    calls = []

    def ending(rows: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("ended in the second batch")
        return rows

    for transform in (ending, None):
        stream = table_stream(spark, source._relslice_path, source.schema, max_files=1)
        try:
            append_dump(stream, t, out, checkpoint, redacted=True, transform=transform).awaitTermination()
        except Exception as e:
            if "ended in the second batch" not in str(e):
                raise
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database({t.key: t}))
    restore(spark, out, target)
    return target.frame(t.key)


# A connection text per document, with its number as the secret, and what must be left of it, written out one by one.
_CONNECTIONS = [
    ("postgres://app:s{}@db:5432/x", "postgres://app:***@db:5432/x"),
    ("postgres://app:pa/s{}@db/x", "postgresql://***"),
    ("postgres://app:pa#s{}@db/x", "postgresql://***"),
    ("postgres://app:pa?s{}@db/x", "postgresql://***"),
    ("postgresql://app@db/x?sslmode=prefer&password=s{}", "postgresql://app@db/x?sslmode=prefer&password=***"),
    ("postgres://a@b:s{}@db,db2:5433/x", "postgres://a@b:***@db,db2:5433/x"),
    ("postgres://app:%zs{}@db/x", "postgresql://***"),
    ("host=db password='s{} tail' dbname=x", "host=db password=*** dbname=x"),
    ("postgres://db:5432/x?application_name=app", "postgres://db:5432/x?application_name=app"),
    ("postgres://app:s{}@[::1]:5432 failed: timeout", "postgres://app:***@[::1]:5432 failed: timeout"),
    ("postgres://app:12/s{}@db/x", "postgresql://***"),
    ("no connection", "no connection"),
]


@query(f"SELECT doc_id, 'on ' || coalesce(lang, '-') || ' ' || CASE doc_id % {len(_CONNECTIONS)} " + " ".join(f"WHEN {i} THEN '{after}'" for i, (_, after) in enumerate(_CONNECTIONS)) + " END || ' end' AS message FROM documents")
def scrub_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection texts made from all documents, without their secrets."""
    texts = F.lit(None)
    for i, (before, _) in enumerate(_CONNECTIONS):
        ends = [F.lit(end) for end in before.split("{}")]
        texts = F.when(F.col("doc_id") % len(_CONNECTIONS) == i, F.concat(ends[0], F.col("doc_id").cast("string"), ends[1]) if ends[1:] else ends[0]).otherwise(texts)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scrub(F.concat(F.lit("on "), F.coalesce("lang", F.lit("-")), F.lit(" "), texts, F.lit(" end"))).alias("message"))
