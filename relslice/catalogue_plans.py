"""More queries of the driver: selection, orders, guards, typing and files, as rows counted from the given tables."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice import catalogue
from relslice.catalog import ColumnDef, Database, FkDef, TableDef, describe, schema_violations
from relslice.catalogue import ALL_TABLES, PERCENT_SQL, WIDE, query, read_back, shop, table
from relslice.clone import analyze, clone
from relslice.dump import dump
from relslice.functions.coerce import POSITION, sound, typed
from relslice.functions.redact import redact, scrub, sensitive_columns
from relslice.operators import chunks, closure, verify
from relslice.operators.predicates import Limits, Seed
from relslice.operators.recency import recency_column
from relslice.plans.graph import fk_order
from relslice.plans.selection import exclude_for_restore, partition_leaves, row_tables, schema_scope, select_tables
from relslice.restore import restore
from relslice.scratch import fresh_path, materialize
from relslice.sources import fs, manifest, ndjson
from relslice.sources.warehouse import Warehouse


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _counted(db: Database, rows: list[tuple]) -> DataFrame:
    """(place, key, n_rows) of tables of ``db`` in the given order."""
    spark = next(iter(db.frames.values())).sparkSession
    named = spark.createDataFrame(rows, "place int, key string")
    return named.join(verify.row_counts(db), "key").select("place", "key", "n_rows")


# Selection ----------------------------------------------------------------------------------------------------


@query("""SELECT 'selected' AS kind, 'public.customer' AS name, count(*) AS n_rows FROM customer
UNION ALL SELECT 'selected', 'public.orders', count(*) FROM orders
UNION ALL SELECT 'exclude', 'public.part', count(*) FROM part
UNION ALL SELECT 'warning', 'excluded table ''parts'' does not exist', 0""")
def table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes narrow, excludes win, an unknown exclude is a warning."""
    db = shop(spark, sf_dir, *ALL_TABLES)
    picked, told = select_tables(db, ["customer", "public.orders", "part"], ["part", "parts"])
    gone = verify.row_counts(db.only(told["exclude"])).withColumn("kind", F.lit("exclude"))
    kept = verify.row_counts(picked).withColumn("kind", F.lit("selected")).unionByName(gone).select("kind", F.col("key").alias("name"), "n_rows")
    warned = spark.createDataFrame([("warning", w, 0) for w in told["warnings"]], "kind string, name string, n_rows long")
    return kept.unionByName(warned)


_SCHEMAS = {"region": "geo", "nation": "geo", "customer": "shop", "orders": "shop", "events": "log"}


@query(" UNION ALL ".join(f"SELECT '{s}' AS schema, '{t}' AS name, count(*) AS n_rows FROM {t}" for t, s in _SCHEMAS.items() if s != "log"))
def schema_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in three schemas, of which one is excluded; names are trimmed and repeats dropped."""
    pairs = [(describe(df := table(spark, sf_dir, t), t, schema=s), df) for t, s in _SCHEMAS.items()]
    db = Database.of(*pairs)
    scope = schema_scope([t.schema for t in db.tables.values()], [" shop", "geo", "log", "geo "], ["log"])
    inside = db.tables_frame(spark).where(F.col("schema").isin(scope))
    return inside.join(verify.row_counts(db), "key").select("schema", "name", "n_rows")


@query("""SELECT 'public.orders_done' AS leaf, 'public.orders' AS parent, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'public.orders_open_big', 'public.orders_open', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 100000
UNION ALL SELECT 'public.orders_open_small', 'public.orders_open', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 100000""")
def partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in nested partitions, of which only the leaves carry rows."""
    o = table(spark, sf_dir, "orders")
    done, big = F.col("o_orderstatus") == "F", F.col("o_totalprice") >= 100000
    parts = {"orders": (None, None), "orders_done": ("orders", done), "orders_open": ("orders", None), "orders_open_big": ("orders_open", ~done & big), "orders_open_small": ("orders_open", ~done & ~big)}
    pairs = [(describe(o, n, ["o_orderkey"], partition_of=p and f"public.{p}"), o if where is None else o.where(where)) for n, (p, where) in parts.items()]
    db = Database.of(*pairs)
    leaves = row_tables(db)
    if partition_leaves(db, "public.orders") != sorted(leaves.tables):
        raise AssertionError("leaves at any depth are the tables that carry rows")
    named = leaves.tables_frame(spark).select("key", F.col("partition_of").alias("parent"))
    return named.join(verify.row_counts(leaves), "key").select(F.col("key").alias("leaf"), "parent", "n_rows")


@query("SELECT 'public.nation' AS key, count(*) AS n_rows FROM nation UNION ALL SELECT 'public.region', count(*) FROM region UNION ALL SELECT 'public.customer', 0")
def restore_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of three tables, loaded without one of them."""
    db, path = shop(spark, sf_dir, "region", "nation", "customer"), fresh_path(spark, "dump")
    dump(db, path)
    left = exclude_for_restore(db, ["customer"])
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    if restore(spark, path, target, exclude=["customer"]).tables != fk_order(left):
        raise AssertionError("the load keeps to what is left")
    return verify.row_counts(target.database())


_KINDS = "CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double precision' WHEN 'TIMESTAMP' THEN 'timestamp without time zone' ELSE 'text' END"
_COLUMNS = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
}


@query(" UNION ALL ".join(f"SELECT 'public.{t}' AS key, '{c}' AS \"column\", {i} AS ordinal, {_KINDS.format(c=c)} AS type, {str(i == 1).lower()} AS primary_key, count(*) - count({c}) AS n_null FROM {t}" for t, cs in _COLUMNS.items() for i, c in enumerate(cs, 1)))
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's columns, with the nulls that the data has in each."""
    db = shop(spark, sf_dir, *_COLUMNS)
    nulls = [df.select(F.lit(k).alias("key"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("long").alias("n")) for c in df.columns]))) for k, df in db.frames.items()]
    return db.columns_frame(spark).join(_union(nulls).groupBy("key", "column").agg(F.sum("n").alias("n_null")), ["key", "column"]).select("key", "column", "ordinal", "type", "primary_key", "n_null")


@query(" UNION ALL ".join(f"SELECT 'public.{c}' AS child, 'public.{p}' AS parent, '{f}' AS \"column\", count({f}) AS n_set FROM {c}" for c, fs in catalogue.FKS.items() for f, p in fs))
def catalog_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's foreign keys, with the rows in which each is set."""
    db = shop(spark, sf_dir, *ALL_TABLES)
    known = db.fks_frame(spark).select("child", "parent", F.col("columns")[0].alias("column"))
    found = _union([db.frames[t.key].agg(F.count(F.col(f.columns[0])).alias("n_set")).select(F.lit(t.key).alias("child"), F.lit(f.columns[0]).alias("column"), "n_set") for t in db.tables.values() for f in t.fks])
    return known.join(found, ["child", "column"]).select("child", "parent", "column", "n_set")


@query("""SELECT 'public.orders' AS key, unnest(['o_custkey', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
unnest(['type', 'nullability', 'ordinal', 'missing column']) AS problem, n AS n_rows FROM (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'public.customer', unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']), 'missing table', n FROM (SELECT count(*) AS n FROM customer)""")
def schema_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a target lacks or has otherwise, with the rows that this keeps from being loaded."""
    db = shop(spark, sf_dir, "customer", "orders")
    o = db.tables["public.orders"]
    changed = {"o_custkey": {"type": "text"}, "o_totalprice": {"nullable": False}}
    columns = [replace(c, **changed.get(c.name, {})) for c in o.columns if c.name != "o_orderpriority"]
    columns = [*columns[:4], ColumnDef("o_added", "text"), *columns[4:]]
    bad = schema_violations(spark, db, Database({o.key: replace(o, columns=tuple(columns))}))
    return bad.join(verify.row_counts(db), "key").select("key", "column", "problem", "n_rows")


# Orders -------------------------------------------------------------------------------------------------------

_ORDER = ("part", "region", "nation", "customer", "events", "orders", "supplier", "lineitem")


@query(" UNION ALL ".join(f"SELECT {i} AS place, 'public.{t}' AS key, count(*) AS n_rows FROM {t}" for i, t in enumerate(_ORDER)))
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, parents first, ties by name, with their rows."""
    db = shop(spark, sf_dir, *ALL_TABLES)
    return _counted(db, list(enumerate(fk_order(db))))


@query(PERCENT_SQL + "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM kids")
def subset_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a subset's row file: by primary key."""
    db, path = shop(spark, sf_dir, "customer", "orders"), fresh_path(spark, "dump")
    dump(db, path, percent=10, limits=WIDE)
    t = db.tables["public.orders"]
    rows = ndjson.rows_of(ndjson.read(spark, f"{path}/{manifest.data_file(t)}", t), t).select("o_orderkey", POSITION)
    return chunks.with_rank(rows, [POSITION]).select("o_orderkey", F.col("rank").alias("place"))


@query("SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT (SELECT cast(ceil(count(*) * 10 / 100.0) AS BIGINT) FROM events)")
def recency_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentage of events by the recency column that the catalog names, not by their key."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("Updated_At"), F.col("ts").alias("not_a_date"), "event_type")
    t = describe(e, "events", ["event_id"])
    if recency_column(t) != "Updated_At":
        raise AssertionError("a recency column by name, whatever its case")
    return closure.closure_of_percent(Database.of((t, e)), 10, WIDE).keys[t.key]


# Closures -----------------------------------------------------------------------------------------------------


@query("""SELECT l.* FROM lineitem l WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')
AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 2000)""")
def closure_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a key below three planned parents: its rows need all of them."""
    db = shop(spark, sf_dir, "customer", "orders", "lineitem", "part", "supplier")
    seeds = [Seed("customer", "c_mktsegment", "eq", ("BUILDING",)), Seed("part", "p_size", "gt", (20,)), Seed("supplier", "s_acctbal", "gte", (2000,))]
    return closure.exported(db, closure.closure_of_seeds(db, seeds, WIDE), "public.lineitem")


@query("""SELECT p.conv_id, p.turn, p.role FROM conversations p SEMI JOIN
(SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant') c USING (conv_id, turn)""")
def closure_composite_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a key of their own that refer to the turn before by two columns: these turns come along."""
    c = table(spark, sf_dir, "conversations")
    turns = c.select("conv_id", "turn", "role")
    answers = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "conv_id", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("before"))
    link = FkDef(("conv_id", "before"), "public.turns", ("conv_id", "turn"))
    db = Database.of((describe(turns, "turns", ["conv_id", "turn"]), turns), (describe(answers, "answers", ["id"], [link]), answers))
    plan = closure.closure_of_seeds(db, [Seed("answers", "role", "eq", ("assistant",))], WIDE)
    return closure.exported(db, plan, "public.turns")


@query("""SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY 1 DESC LIMIT 400""")
def closure_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 400 orders, the most recent ones, of the customers of a segment."""
    plan = closure.closure_of_seeds(shop(spark, sf_dir, "customer", "orders"), [Seed("customer", "c_mktsegment", "eq", ("BUILDING",))], replace(WIDE, max_rows_per_table=400))
    return plan.keys["public.orders"]


@query("""SELECT unnest(['max_rows', 'max_tables', 'max_depth']) AS "limit", unnest(['more than 10 rows were read', 'table public.orders would be one more than 1', 'table public.orders lies deeper than 0']) AS message, n AS n_seeds
FROM (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0)""")
def closure_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits that a closure of all customers in debt goes over, one by one, with its number of seeds."""
    db, found = shop(spark, sf_dir, "customer", "orders"), []
    for limits in (Limits(max_rows=10), replace(WIDE, max_tables=1), replace(WIDE, max_depth=0)):
        try:
            closure.closure_of_seeds(db, catalogue.SEEDS, limits)
        except closure.SubsetLimitError as e:
            found.append((e.limit, str(e).split(": ", 1)[1]))
    seeds = db.frames["public.customer"].where("c_acctbal < 0").agg(F.count("*").alias("n_seeds"))
    return spark.createDataFrame(found, "limit string, message string").join(F.broadcast(seeds))  # one row


# Files --------------------------------------------------------------------------------------------------------


@query(PERCENT_SQL + "SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT o_orderkey FROM kids)")
def dump_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of ten per cent, read back from its row file."""
    db, path = shop(spark, sf_dir, "customer", "orders"), fresh_path(spark, "dump")
    dump(db, path, percent=10, limits=WIDE, strict=True)
    return read_back(spark, path, db.tables["public.orders"])


@query("SELECT * FROM lineitem")
def dump_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunked dump of a table without a key, by physical rows, that is run again over its finished chunks.

    The first run is cut off at the table behind it and leaves no manifest; the second one, with the same options,
    writes no chunk again and gives the dump its manifest.
    """
    db, path = shop(spark, sf_dir, "lineitem", "region"), fresh_path(spark, "dump")
    lines, chosen, cuts, jobs = db.tables["public.lineitem"], [], [], []

    def cut(t: TableDef, _: DataFrame) -> dict:
        if t == lines:
            jobs.append(t)
        elif not cuts:
            cuts.append(t)
            raise InterruptedError("cut off")
        return {}

    def run() -> tuple:
        """Whether the dump has its manifest then, the jobs that have written chunks, and the state of their files."""
        try:
            dump(db, path, chunk=["lineitem"], chunk_size=50_000, on_plan=chosen.extend, transform=cut)
        except InterruptedError:
            pass
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{manifest.data_file(lines)}")
        return fs.has_text(spark, f"{path}/metadata.json"), len(jobs), chunks.data_state(files)

    (early, *first), (whole, *second) = run(), run()
    if early or not whole or first != second or not jobs:
        raise AssertionError("a dump that is run again keeps the chunks that it has finished, as they are")
    if [(s.kind, s.keys) for s in chosen if s.table == lines.key] != 2 * [("chunk", ("__file", "__row"))]:
        raise AssertionError("a table without a safe key is chunked by its physical rows")
    return read_back(spark, path, lines)


@query(f"SELECT {len(ALL_TABLES)}::BIGINT AS table_count, ({' + '.join(f'(SELECT count(*) FROM {t})' for t in ALL_TABLES)})::BIGINT AS total_rows")
def dump_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals that a dump of all tables records."""
    path = fresh_path(spark, "dump")
    dump(shop(spark, sf_dir, *ALL_TABLES), path, workers=8)
    return spark.read.option("multiLine", True).json(f"{path}/metadata.json").select("provenance.table_count", "provenance.total_rows")


@query("""SELECT 3::BIGINT AS seq, '' AS source, 1::BIGINT AS n_tables, (SELECT count(*) FROM nation) AS n_rows
UNION ALL SELECT 2, 'shop', 1, (SELECT count(*) FROM customer) UNION ALL SELECT 1, 'shop', 1, (SELECT count(*) FROM orders)""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered dumps, and one that is only there on disk."""
    base = fresh_path(spark, "runs")
    for seq, name in enumerate(("orders", "customer", "nation"), 1):
        dump(shop(spark, sf_dir, name), f"{base}/{seq}")
        if seq < 3:
            manifest.register_run(spark, base, f"{base}/{seq}", seq, "shop")
    return manifest.list_runs(spark, base).select("seq", "source", "n_tables", "n_rows")


@query("SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal * 2 AS c_acctbal, c_mktsegment FROM customer")
def dump_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform that changes two columns, adds one and leaves the others out: the column set stays."""
    db, path = shop(spark, sf_dir, "customer"), fresh_path(spark, "dump")
    dump(db, path, transform=lambda _, d: {"c_name": F.upper("c_name"), "c_acctbal": d["c_acctbal"] * 2, "added": F.lit(1)})
    return read_back(spark, path, db.tables["public.customer"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer")
def dump_transform_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform by frame that drops columns: they come back from the same rows."""
    db, path = shop(spark, sf_dir, "customer"), fresh_path(spark, "dump")
    dump(db, path, transform=lambda _, d: d.drop("c_name", "c_mktsegment").withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return read_back(spark, path, db.tables["public.customer"])


@query("""SELECT 'public.customer' AS "table", 'stream' AS kind, 'c_custkey' AS keys, count(*) AS n_rows FROM customer
UNION ALL SELECT 'public.orders', 'chunk', 'o_orderkey', count(*) FROM orders UNION ALL SELECT 'public.lineitem', 'stream', '', count(*) FROM lineitem""")
def dump_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan validator sees before anything is written; it stops the dump here."""
    db, path, seen = shop(spark, sf_dir, "customer", "orders", "lineitem"), fresh_path(spark, "dump"), []

    def stop(plan: list) -> None:
        seen.extend((s.table, s.kind, ",".join(s.keys)) for s in plan)
        raise InterruptedError

    try:
        dump(db, path, chunk=["orders"], on_plan=stop)
    except InterruptedError:
        pass
    return spark.createDataFrame(seen, "table string, kind string, keys string").join(verify.row_counts(db).withColumnRenamed("key", "table"), "table")


@query("SELECT p_partkey, p_size, p_size * 2 AS p_double FROM part")
def restore_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated column isn't loaded but computed again."""
    p, path = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(0).alias("p_double")), fresh_path(spark, "dump")
    t = TableDef("part", (ColumnDef("p_partkey", "bigint", False, True), ColumnDef("p_size", "integer"), ColumnDef("p_double", "integer", generated="p_size * 2")))
    dump(Database.of((t, p)), path)
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database({t.key: t}))
    restore(spark, path, target)
    return target.frame(t.key)


@query("SELECT * FROM orders")
def restore_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of disjoint rows: the second adds files and leaves the first one's."""
    db = shop(spark, sf_dir, "orders")
    target, whole = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables)), db.frames["public.orders"]
    for where in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        path = fresh_path(spark, "dump")
        dump(Database(db.tables, {"public.orders": whole.where(where)}), path)
        before = set(target.frame("public.orders").inputFiles())
        restore(spark, path, target)
        if not before <= set(target.frame("public.orders").inputFiles()):
            raise AssertionError("a load that changes no row rewrites none")
    return target.frame("public.orders")


@query("SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer")
def clone_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row counts that a replay's statistics hold."""
    db, place = shop(spark, sf_dir, "nation", "customer"), fresh_path(spark, "warehouse")
    name = "replay_" + place[-12:]
    spark.sql(f"CREATE DATABASE {name}")
    try:
        target = Warehouse(spark, place, Database(db.tables))
        clone(spark, db, target, "replay")
        told = []
        for key, registered in analyze(spark, target, db.tables, name).items():
            facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {registered}").collect()}
            told.append((db.tables[key].name, int(facts["Statistics"].split(", ")[1].split()[0])))
        return spark.createDataFrame(told, "name string, n_rows long")
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


# Values -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN TIMESTAMP '9999-12-31' WHEN 'O' THEN TIMESTAMP '0001-01-01' ELSE o_orderdate END AS o_orderdate,
CASE o_orderstatus WHEN 'F' THEN 'infinity' WHEN 'O' THEN '-infinity' END AS o_orderdate__inf FROM orders""")
def infinite_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose dates are infinite, by their status: sentinels, told apart by a flag column."""
    o = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderstatus") == "F", "Infinity").when(F.col("o_orderstatus") == "O", "-infinity").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    line = F.to_json(F.struct("o_orderkey", date.alias("o_orderdate")))
    rows = typed(o.select(line.alias("value")), describe(o.select("o_orderkey", "o_orderdate"), "orders", ["o_orderkey"]), infinities=True)
    return sound(rows).select("o_orderkey", "o_orderdate", "o_orderdate__inf")


@query("SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey * 86399999999 + 123456 AS micros FROM orders")
def temporal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and instants through row files."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.timestamp_micros(F.col("o_orderkey") * 86399999999 + 123456).alias("at"))
    t, path = describe(o, "orders", ["o_orderkey"]), fresh_path(spark, "rows")
    ndjson.write(o, path)
    return ndjson.rows_of(ndjson.read(spark, path, t), t).select("o_orderkey", "day", F.unix_micros("at").alias("micros"))


@query("""SELECT 'email' AS "column", count(c_name) AS n_set, count(c_name) AS n_redacted FROM customer UNION ALL SELECT 'pin_token', count(c_acctbal), 0 FROM customer""")
def redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that redaction changes, with the values set before and after."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("email"), F.col("c_acctbal").alias("pin_token"), "c_mktsegment")
    t = describe(c, "t")
    names = sensitive_columns(t)
    counts = [df.agg(*[F.count(F.col(n)).alias(n) for n in names]) for df in (c, redact(t, c))]
    long = [d.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias(what)) for n in names]))) for d, what in zip(counts, ("n_set", "n_redacted"), strict=True)]
    return long[0].join(long[1], "column")


_PAIRS = r"""(?is)(password|pass|pwd|sslpassword|sslcert|sslkey|passcode|secret|token|key|cert)=(?:'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$)|[^\s'"]*)"""


@query(rf"""SELECT doc_id, regexp_replace('login ' || source || '_token="' || lang || ' x" ' || text, '{_PAIRS.replace("'", "''")}', '\1=***', 'g') AS message FROM documents WHERE text IS NOT NULL""")
def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts behind a line with a quoted secret, without credentials."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", scrub(F.concat(F.lit("login "), "source", F.lit('_token="'), "lang", F.lit(' x" '), "text")).alias("message"))
