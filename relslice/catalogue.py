"""The queries that the driver runs over the star schema, and the SQL it holds them against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice.catalog import Database, FkDef, KeyChoice, TableDef, describe, key_violations, profile
from relslice.clone import clone, refresh_views
from relslice.dump import dump
from relslice.functions.coerce import POSITION, typed, violations
from relslice.functions.redact import redact, scrub_pairs, scrub_urls
from relslice.operators import chunks, closure, conflict, predicates, recency
from relslice.operators import verify as checks
from relslice.operators.predicates import Limits, Seed
from relslice.restore import restore
from relslice.scratch import fresh_path, materialize
from relslice.sources import manifest, ndjson
from relslice.sources.warehouse import Warehouse
from relslice.streaming.exports import append_export, table_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PK = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
FKS = {
    "nation": [("n_regionkey", "region")],
    "customer": [("c_nationkey", "nation")],
    "supplier": [("s_nationkey", "nation")],
    "orders": [("o_custkey", "customer")],
    "lineitem": [("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier")],
    "events": [("user_id", "customer")],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shop(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """The named tables with their keys, and the foreign keys among them."""
    pairs = []
    for n in names:
        df = table(spark, sf_dir, n)
        fks = [FkDef((c,), f"public.{p}", (PK[p],)) for c, p in FKS.get(n, []) if p in names]
        pairs.append((describe(df, n, [PK[n]] if n in PK else [], fks), df))
    return Database.of(*pairs)


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Predicates ---------------------------------------------------------------------------------------------------


def _predicate(name: str, seeds: list[Seed], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = shop(spark, sf_dir, "orders")
        checked = predicates.check_seeds(db, seeds)
        keep = predicates.any_of(predicates.condition(t, s) for t, s in checked)
        return predicates.filtered(db.frames["public.orders"], [keep]).select("o_orderkey")

    run.__name__ = name
    query(f"SELECT o_orderkey FROM orders WHERE {where}")(run)


for _name, _seeds, _where in (
    ("pred_eq", [("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'"),
    ("pred_in", [("o_orderpriority", "in", "1-URGENT", "5-LOW")], "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    ("pred_is_null", [("o_orderdate", "is_null")], "o_orderdate IS NULL"),
    ("pred_gt", [("o_totalprice", "gt", 150000)], "o_totalprice > 150000"),
    ("pred_gte", [("o_orderdate", "gte", "1996-07-01T12:00:00")], "o_orderdate >= TIMESTAMP '1996-07-01 12:00:00'"),
    ("pred_lt", [("o_totalprice", "lt", 50000.5)], "o_totalprice < 50000.5"),
    ("pred_lte", [("o_orderdate", "lte", "1995-06-17")], "o_orderdate <= TIMESTAMP '1995-06-17'"),
    ("pred_ne", [("o_orderstatus", "ne", "O")], "o_orderstatus <> 'O'"),
    ("pred_like", [("o_orderpriority", "like", "%U%")], "o_orderpriority LIKE '%U%'"),
    ("pred_ilike", [("o_orderpriority", "ilike", "%uRg%")], "o_orderpriority ILIKE '%uRg%'"),
    ("pred_or_seeds", [("o_orderstatus", "eq", "P"), ("o_totalprice", "gt", 200000)], "o_orderstatus = 'P' OR o_totalprice > 200000"),
):
    _predicate(_name, [Seed("orders", c, op, tuple(v)) for c, op, *v in _seeds], _where)


# Closure ------------------------------------------------------------------------------------------------------

SEEDS = [Seed("customer", "c_acctbal", "lt", (0,))]
WIDE = Limits(max_rows=10**12)
_CLOSURE = """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0),
o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c)),
r AS (SELECT 'public.customer' AS t, k FROM c UNION ALL SELECT 'public.orders', k FROM o)
"""


@query(_CLOSURE + "SELECT t AS table_name, k AS key FROM r")
def closure_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = closure.closure_of_seeds(shop(spark, sf_dir, "customer", "orders"), SEEDS, WIDE)
    frames = [plan.keys[t].toDF("key").select(F.lit(t).alias("table_name"), "key") for t in plan.order]
    return reduce(lambda a, b: a.unionByName(b), frames)


@query(_CLOSURE + "SELECT l.* FROM lineitem l WHERE l_orderkey IN (SELECT k FROM r WHERE t = 'public.orders')")
def closure_keyless_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir, "customer", "orders", "lineitem")
    return closure.exported(db, closure.closure_of_seeds(db, SEEDS, WIDE), "public.lineitem")


@query(_CLOSURE + "SELECT (SELECT count(*) FROM c) + 2 * (SELECT count(*) FROM o) AS rows_read")
def closure_row_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = closure.closure_of_seeds(shop(spark, sf_dir, "customer", "orders"), SEEDS, WIDE)
    keys = plan.keys["public.orders"].agg(F.count("*").alias("n"))
    return keys.select(F.lit(plan.rows_read).cast("long").alias("rows_read"))


@query(_CLOSURE + "SELECT t AS table_name, count(*) AS n_rows FROM r GROUP BY t")
def closure_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure_seed(spark, sf_dir).groupBy("table_name").agg(F.count("*").alias("n_rows"))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS k FROM customer),
n AS (SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_name LIKE 'NATION_1%' OR n_name LIKE 'A%' OR n_nationkey < 3),
g AS (SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_nationkey IN (SELECT k FROM n)),
m AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (SELECT k FROM g))
SELECT 'public.region' AS table_name, count(*) AS n_rows FROM g
UNION ALL SELECT 'public.nation', count(*) FROM m
UNION ALL SELECT 'public.customer', count(*) FROM customer WHERE c_nationkey IN (SELECT k FROM m)
UNION ALL SELECT 'public.supplier', count(*) FROM supplier WHERE s_nationkey IN (SELECT k FROM m)""")
def closure_snowflake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure over four tables that spreads through shared parents."""
    db = shop(spark, sf_dir, "region", "nation", "customer", "supplier")
    seeds = [Seed("nation", "n_name", "like", ("NATION_1%",)), Seed("nation", "n_name", "like", ("A%",)), Seed("nation", "n_nationkey", "lt", (3,))]
    plan = closure.closure_of_seeds(db, seeds, WIDE)
    frames = [plan.keys[t].toDF("key").agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in plan.order]
    return reduce(lambda a, b: a.unionByName(b), frames)


PERCENT_SQL = """WITH roots AS (SELECT c_custkey FROM customer ORDER BY 1 DESC LIMIT (SELECT cast(ceil(count(*) * 10 / 100.0) AS BIGINT) FROM customer)),
scope AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM roots)),
kids AS (SELECT o_orderkey FROM scope ORDER BY 1 DESC LIMIT (SELECT cast(ceil(count(*) * 10 / 100.0) AS BIGINT) FROM scope))
"""


def _percent(spark: SparkSession, sf_dir: str, *names: str) -> tuple[Database, closure.Plan]:
    db = shop(spark, sf_dir, *names)
    return db, closure.closure_of_percent(db, 10, WIDE)


@query(PERCENT_SQL + "SELECT c_custkey FROM roots")
def percent_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percent(spark, sf_dir, "customer", "orders")[1].keys["public.customer"]


@query(PERCENT_SQL + "SELECT o_orderkey FROM kids")
def percent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percent(spark, sf_dir, "customer", "orders")[1].keys["public.orders"]


@query(PERCENT_SQL + "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kids)")
def percent_export_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, plan = _percent(spark, sf_dir, "customer", "orders", "lineitem")
    return closure.exported(db, plan, "public.lineitem")


@query("SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 100")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recency.most_recent(table(spark, sf_dir, "events"), "event_id", "ts", 100)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def recent_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recency.most_recent_per_parent(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", ["o_custkey"], 3)


@query("SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def orphans_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that would be orphans if customers in debt were left out."""
    return closure.orphans(table(spark, sf_dir, "orders"), FkDef(("o_custkey",), "public.customer", ("c_custkey",)), table(spark, sf_dir, "customer").where("c_acctbal >= 0"))


@query("SELECT * FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def orphans_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.orphans(table(spark, sf_dir, "lineitem"), FkDef(("l_partkey",), "public.part", ("p_partkey",)), table(spark, sf_dir, "part").where("p_size > 10"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_check_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def key_check_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_violations(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


# Chunks -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk_id FROM orders")
def keyset_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.with_chunk(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 1000)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (20, 300) ORDER BY 1, 2 LIMIT 1000")
def keyset_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.next_chunk(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderkey"], (20, 300), 1000)


# Redaction ----------------------------------------------------------------------------------------------------


def _redacted(df: DataFrame) -> DataFrame:
    return redact(describe(df, "t"), df)


@query("SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN 'redacted@example.com' END AS email, CASE WHEN c_mktsegment IS NOT NULL THEN '+1-555-000-0000' END AS \"Phone\", c_acctbal FROM customer")
def redact_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return _redacted(c.select("c_custkey", F.col("c_name").alias("email"), F.col("c_mktsegment").alias("Phone"), "c_acctbal"))


@query("SELECT p_partkey, CASE WHEN p_brand IS NOT NULL THEN '[REDACTED]' END AS api_token, CASE WHEN p_name IS NOT NULL THEN '[REDACTED]' END AS old_password_hint, p_type FROM part")
def redact_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return _redacted(p.select("p_partkey", F.col("p_brand").alias("api_token"), F.col("p_name").alias("old_password_hint"), "p_type"))


@query("SELECT s_suppkey, NULL::DOUBLE AS cvv, NULL::INTEGER AS secret_nation FROM supplier")
def redact_nontext(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return _redacted(s.select("s_suppkey", F.col("s_acctbal").alias("cvv"), F.col("s_nationkey").alias("secret_nation")))


@query("SELECT doc_id, 'host=' || source || ' password=*** api_token=*** lang=' || lang || ' n=' || n_chars AS message FROM documents")
def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    built = F.concat(F.lit("host="), "source", F.lit(" password="), "lang", F.lit(" api_token='a b "), "source", F.lit("' lang="), "lang", F.lit(" n="), F.col("n_chars").cast("string"))
    return d.select("doc_id", scrub_pairs(built).alias("message"))


@query("SELECT doc_id, 'at postgresql://' || source || ':***@db/' || lang || '?sslmode=require&user_token=*** failed' AS message FROM documents")
def scrub_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    built = F.concat(F.lit("at postgresql://"), "source", F.lit(":p"), F.col("n_chars").cast("string"), F.lit("@db/"), "lang", F.lit("?sslmode=require&user_token=t"), F.col("doc_id").cast("string"), F.lit(" failed"))
    return d.select("doc_id", scrub_urls(built).alias("message"))


# Row files ----------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders")
def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    path, definition = fresh_path(spark, "rows"), describe(df, "orders", ["o_orderkey"])
    ndjson.write(df, path)
    return ndjson.rows_of(ndjson.read(spark, path, definition), definition).drop(POSITION)


@query("""SELECT o_orderkey AS __pos, unnest(CASE o_orderstatus
  WHEN 'F' THEN ['o_custkey: no bigint'] WHEN 'O' THEN ['o_orderstatus: missing or null', 'extra: unknown key']
  ELSE ['o_orderdate: no timestamp without time zone'] END) AS problem FROM orders""")
def coerce_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON rows that break a rule each, by their status."""
    o = table(spark, sf_dir, "orders")
    base = [F.col("o_orderkey"), F.col("o_orderkey").alias(POSITION), F.col("o_totalprice")]
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    status = F.col("o_orderstatus")
    line = (
        F.when(status == "F", F.to_json(F.struct(*base, status, (F.col("o_custkey") + F.lit(0.5)).alias("o_custkey"), date.alias("o_orderdate"))))
        .when(status == "O", F.to_json(F.struct(*base, F.col("o_custkey"), date.alias("o_orderdate"), F.lit(1).alias("extra"))))
        .otherwise(F.to_json(F.struct(*base, status, F.col("o_custkey"), F.concat(F.lit("on "), date).alias("o_orderdate"))))
    )
    whole = describe(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), "orders", ["o_orderkey", "o_orderstatus"])
    return violations(typed(o.select(line.alias("value")), whole))


# Conflicts ----------------------------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, TableDef]:
    """Orders that are open or done as the target; those that are open or partial, at a raised price, as the load."""
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderstatus IN ('O', 'P')").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn(POSITION, F.col("o_orderkey"))
    return o.where("o_orderstatus IN ('F', 'O')"), new, describe(o, "orders", ["o_orderkey"])


@query("SELECT o_orderkey, 'exists' AS problem FROM orders WHERE o_orderstatus = 'O'")
def conflict_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _ = _halves(spark, sf_dir)
    return conflict.conflicts(old, new, ("o_orderkey",))


@query("SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def conflict_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.merged(*_halves(spark, sf_dir), "skip")


@query("SELECT * REPLACE (CASE WHEN o_orderstatus <> 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def conflict_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.merged(*_halves(spark, sf_dir), "upsert")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias(POSITION))
    return conflict.one_per_key(rows, ("o_custkey",), "first").drop(POSITION)


# Verification and marks ---------------------------------------------------------------------------------------

ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("""SELECT 'public.customer' AS key, count(*) AS source_rows, count(*) FILTER (c_acctbal > 0) AS target_rows FROM customer
UNION ALL SELECT 'public.orders', count(*), NULL FROM orders""")
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts against a copy with fewer customers and without orders."""
    db = shop(spark, sf_dir, "region", "nation", "customer", "orders")
    copy = db.only(k for k in db.tables if k != "public.orders")
    copy.frames["public.customer"] = copy.frames["public.customer"].where("c_acctbal > 0")
    return checks.count_mismatches(checks.row_counts(db), checks.row_counts(copy))


_IDS = " UNION ALL ".join(f"SELECT 'public' AS schema, '{t}' AS \"table\", '{c}' AS \"column\", max({c})::BIGINT AS v FROM {t}" for t, c in PK.items())


def _marks(spark: SparkSession, sf_dir: str, value: str, called: str) -> DataFrame:
    ids = checks.max_ids(shop(spark, sf_dir, *PK))
    return ids.select("schema", "table", "column", F.expr(value).cast("long").alias("last_value"), F.expr(called).alias("is_called"), F.lit(1).cast("long").alias("min_value"), F.expr("max_id + 5").cast("long").alias("max_value"))


@query(f"""SELECT schema, "table", "column", greatest(v, CASE WHEN v > 1000 THEN v + 10 ELSE 3 END)::BIGINT AS last_value,
v <= 1000 AND v >= 3 OR (v > 1000 OR v < 3) AS is_called, 1::BIGINT AS min_value,
CASE WHEN v <= 1000 AND greatest(v, 3) <= v + 5 THEN v + 5 END AS max_value FROM ({_IDS})""")
def marks_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks after a load; those of large tables were ahead of their rows, those of small ones behind."""
    ids = checks.max_ids(shop(spark, sf_dir, *PK))
    return checks.synced(_marks(spark, sf_dir, "CASE WHEN max_id > 1000 THEN max_id + 10 ELSE 3 END", "true"), ids)


@query(f"""SELECT schema, "table", "column", CASE WHEN v > 1000 THEN 'last value ' || v || ' and ' || (v - 1) ELSE 'is_called differs' END AS problem FROM ({_IDS})""")
def marks_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _marks(spark, sf_dir, "max_id", "true")
    return checks.mark_mismatches(source, _marks(spark, sf_dir, "CASE WHEN max_id > 1000 THEN max_id - 1 ELSE max_id END", "false"))


@query(" UNION ALL ".join(f"SELECT 'public' AS schema, '{t}' AS name, 'table' AS kind, count(*) AS n_rows, 8::BIGINT AS n_objects FROM {t}" for t in ALL_TABLES))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(shop(spark, sf_dir, *ALL_TABLES)).select("schema", "name", "kind", "n_rows", "n_objects")


# Composite operators ------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT 'public.{t}' AS key, count(*) AS row_count FROM {t}" for t in ("region", "nation", "customer", "orders")))
def dump_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole dump with parallel workers; row counts from its manifest's own file."""
    path = fresh_path(spark, "dump")
    dump(shop(spark, sf_dir, "region", "nation", "customer", "orders"), path, workers=4)
    return spark.read.option("multiLine", True).json(f"{path}/metadata.json").select(F.explode("tables").alias("t")).select("t.key", "t.row_count")


@query(_CLOSURE + "SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT k FROM r WHERE t = 'public.orders')")
def dump_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset dump by seeds, read back from its row file."""
    db, path = shop(spark, sf_dir, "customer", "orders", "lineitem"), fresh_path(spark, "dump")
    dump(db, path, seeds=SEEDS, limits=WIDE)
    return read_back(spark, path, db.tables["public.orders"])


def read_back(spark: SparkSession, path: str, definition: TableDef) -> DataFrame:
    return ndjson.rows_of(ndjson.read(spark, f"{path}/{manifest.data_file(definition)}", definition), definition).drop(POSITION)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def dump_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunked export that is cut off after its first folder of chunks and run again."""
    df = table(spark, sf_dir, "customer")
    definition, path = describe(df, "customer", ["c_custkey"]), fresh_path(spark, "chunks")
    choice = KeyChoice("primary_key", ("c_custkey",))
    done = 0

    def cut(part: DataFrame) -> DataFrame:
        nonlocal done
        done += 1
        if done == 2:
            raise InterruptedError("cut off")
        return part

    names = df.columns
    try:
        chunks.export_chunks(df, path, definition.key, choice, 100, {}, names, cut, per_job=5)
    except InterruptedError:
        pass
    chunks.export_chunks(df, path, definition.key, choice, 100, {}, names, per_job=5)
    return ndjson.rows_of(ndjson.read(spark, path, definition), definition).drop(POSITION)


@query("SELECT * FROM orders")
def restore_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump loaded level by level with several workers."""
    db, path = shop(spark, sf_dir, "region", "nation", "customer", "orders"), fresh_path(spark, "dump")
    dump(db, path, workers=4)
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    restore(spark, path, target, workers=4, strict=True)
    return target.frame("public.orders")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def replace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that replaces what an earlier one has written."""
    db, path = shop(spark, sf_dir, "region", "nation"), fresh_path(spark, "dump")
    dump(db, path)
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    for _ in range(2):
        restore(spark, path, target, replace=True)
    return target.frame("public.nation")


@query("SELECT s_suppkey, '[REDACTED]' AS token, s_nationkey, s_acctbal FROM supplier")
def clone_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direct copy with redaction."""
    df = table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "token")
    db = Database.of((describe(df, "supplier", ["s_suppkey"]), df))
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    clone(spark, db, target, "stream", redacted=True)
    return target.frame("public.supplier")


_REVENUE = "SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query("SELECT * FROM customer")
def clone_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy by dump and restore."""
    db = shop(spark, sf_dir, "region", "nation", "customer")
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    report = clone(spark, db, target, "replay")
    if report.warnings:
        raise ValueError("; ".join(report.warnings))
    return target.frame("public.customer")


@query(f"SELECT n_name, n_customers FROM ({_REVENUE}) WHERE n_customers > 10")
def view_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two materialized views over a copied database, one reading the other."""
    db = shop(spark, sf_dir, "region", "nation", "customer")
    target = Warehouse(spark, fresh_path(spark, "warehouse"), Database(db.tables))
    clone(spark, db, target, "copy_as_is")
    views = {"by_nation": (_REVENUE, {"customer", "nation"}), "big_nations": ("SELECT n_name, n_customers FROM by_nation WHERE n_customers > 10", {"by_nation"})}
    refresh_views(spark, target, views)
    return spark.read.parquet(f"{target.path}/views/big_nations")


# Streams ------------------------------------------------------------------------------------------------------


def _exported_stream(spark: SparkSession, sf_dir: str, redacted: bool, runs: int) -> DataFrame:
    source = materialize(table(spark, sf_dir, "events").withColumnRenamed("props", "api_token").repartition(4), "stream")
    out, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    for _ in range(runs):
        append_export(table_stream(spark, source._relslice_path, source.schema), describe(source, "events", ["event_id"]), out, checkpoint, redacted=redacted).awaitTermination()
    return spark.read.schema(source.schema).parquet(out)


@query("SELECT event_id, ts, user_id, event_type, value, CASE WHEN props IS NOT NULL THEN '[REDACTED]' END AS api_token FROM events")
def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported_stream(spark, sf_dir, True, 1)


@query("SELECT event_id, ts, user_id, event_type, value, props AS api_token FROM events")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental export that is run twice and holds every row once."""
    return _exported_stream(spark, sf_dir, False, 2)
