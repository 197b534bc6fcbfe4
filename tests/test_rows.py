import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from relslice.catalog import ColumnDef, TableDef, describe
from relslice.functions.coerce import FIRST, LAST, sound, typed, violations
from relslice.functions.redact import redact, scrub, sensitive_columns
from relslice.operators import chunks, conflict
from relslice.operators.chunks import Ordered, next_chunk
from relslice.operators.conflict import ConflictError
from relslice.scratch import fresh_path
from relslice.sources import ndjson


def test_redaction(spark):
    df = spark.createDataFrame([("a@b", 1, "x", "keep"), (None, None, None, None)], "Email string, cvv int, my_token string, note string")
    d = describe(df, "t")
    assert [tuple(r) for r in redact(d, df).collect()] == [("redacted@example.com", None, "[REDACTED]", "keep"), (None, None, None, None)]
    assert sensitive_columns(d) == ["Email", "cvv", "my_token"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("host=x password=abc port=1", "host=x password=*** port=1"),
        ("API_KEY='a b' z", "API_KEY=*** z"),
        ("see postgres://u:p@h/db?sslmode=on&my_secret=1#x now", "see postgres://u:***@h/db?sslmode=on&my_secret=*** now"),
        ("postgresql:// bad", "postgresql://*** bad"),
        ("nothing = here", "nothing = here"),
        (None, None),
    ],
)
def test_scrubbing(spark, text, want):

    assert spark.createDataFrame([(text,)], "t string").select(scrub(F.col("t"))).first()[0] == want


TABLE = TableDef(
    "t",
    (
        ColumnDef("i", "bigint", False, True), ColumnDef("s", "text"), ColumnDef("b", "boolean"), ColumnDef("d", "date"), ColumnDef("n", "timestamp"),
        ColumnDef("z", "timestamptz"), ColumnDef("x", "bytea"), ColumnDef("m", "numeric(20,4)"), ColumnDef("j", "jsonb"), ColumnDef("k", "smallint"),
    ),
)


def one(spark, line, **kw):
    return typed(spark.createDataFrame([(line,)], "value string"), TABLE, **kw).first()


def test_typing_accepts(spark):
    r = one(spark, '{"i": 9007199254740993, "s": "a", "b": true, "d": "2020-02-29", "n": "2020-01-02T03:04:05.123456789Z", "z": "2020-01-02T03:04:05+01:00", "x": "AQI=", "m": 1.5, "j": {"q": [1]}, "k": 3.0}')
    assert r["__problems"] == []
    assert (r["i"], r["s"], r["b"], r["d"], r["n"]) == (9007199254740993, "a", True, dt.date(2020, 2, 29), dt.datetime(2020, 1, 2, 3, 4, 5, 123456))
    assert (bytes(r["x"]), r["m"], r["j"], r["k"]) == (b"\x01\x02", decimal.Decimal("1.5000"), '{"q":[1]}', 3)
    assert r["z"].timestamp() == dt.datetime(2020, 1, 2, 2, 4, 5, tzinfo=dt.UTC).timestamp()


def test_infinite_dates(spark):
    r = one(spark, '{"i": 1, "d": "infinity", "n": "-infinity"}', infinities=True)
    assert (r["d"], r["n"], r["d__inf"], r["n__inf"], r["z__inf"]) == (LAST.date(), FIRST, "infinity", "-infinity", None)


@pytest.mark.parametrize(
    ("line", "problem"),
    [
        ("{", "*: not a JSON object"), ("[1]", "*: not a JSON object"), ("{}", "i: missing or null"), ('{"i": null}', "i: missing or null"), ('{"i": 1.5}', "i: no bigint"),
        ('{"i": "1"}', "i: no bigint"), ('{"i": 1, "k": 40000}', "k: no smallint"), ('{"i": 1, "s": 5}', "s: no text"), ('{"i": 1, "b": "true"}', "b: no boolean"),
        ('{"i": 1, "d": "tomorrow"}', "d: no date"), ('{"i": 1, "n": 5}', "n: no timestamp"), ('{"i": 1, "new": 5}', "new: unknown key"), ('{"i": 1, "x": "?"}', "x: no bytea"),
    ],
)
def test_typing_refuses(spark, line, problem):
    rows = typed(spark.createDataFrame([(line,)], "value string"), TABLE)
    assert problem in [r["problem"] for r in violations(rows).collect()]


def test_bad_rows_stop_a_load(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"i": 1}\n\n{"i": "x"}\n')
    with pytest.raises(Exception, match="i: no bigint"):
        ndjson.rows_of(ndjson.read(spark, str(tmp_path), TABLE), TABLE).collect()


def test_long_lines_are_problems(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ndjson, "MAX_LINE", 20)
    (tmp_path / "rows.json").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t": "ééé"}\n')
    table = describe(spark.createDataFrame([], "id long, t string"), "t", ["id"])
    got = {r["id"]: r["__problems"] for r in ndjson.read(spark, str(tmp_path), table).collect()}
    assert got == {1: [], 2: ["*: more than 20 bytes"]}


def test_all_types_round_trip(spark):
    rows = [(1, "ä\n\"", True, dt.date(1, 1, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 1), bytearray(b"\0\xff"), decimal.Decimal("0.0001")), (2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i bigint, s string, b boolean, d date, n timestamp_ntz, x binary, m decimal(20,4)")
    path, d = fresh_path(spark, "rows"), describe(df, "t", ["i"])
    ndjson.write(df, path)
    back = ndjson.rows_of(ndjson.read(spark, path, d), d).drop("__pos").orderBy("i")
    assert back.collect() == df.orderBy("i").collect()


def test_ranks_and_chunks(spark):
    df = spark.range(2500).selectExpr("(id * 7919) % 2500 AS k", "id AS v").repartition(7)
    out = chunks.with_chunk(df, ["k"], 1000)
    assert {r["chunk_id"]: r["count"] for r in out.groupBy("chunk_id").count().collect()} == {0: 1000, 1: 1000, 2: 500}
    assert out.where("chunk_id != floor(k / 1000)").count() == 0
    assert chunks.with_chunk(df.limit(0), ["k"]).count() == 0
    assert [r["k"] for r in chunks.next_chunk(df, ["k"], (10,), 3).collect()] == [11, 12, 13]
    with pytest.raises(ValueError):
        chunks.with_chunk(df, ["k"], 0)


KEYED = TableDef("t", (ColumnDef("k", "integer", False, True), ColumnDef("v", "text"), ColumnDef("g", "bigint", identity="ALWAYS")))


def merged(spark, policy, old, new):
    f = spark.createDataFrame
    out = conflict.merged(f(old, "k int, v string, g bigint"), f(new, "k int, v string, g bigint, __pos bigint"), KEYED, policy)
    return sorted(map(tuple, out.collect()), key=str)


def test_conflicts(spark):
    old, new = [(1, "a", 5)], [(1, "b", 6, 0), (2, "c", 7, 1), (2, "d", 8, 2)]
    assert merged(spark, "skip", old, new) == [(1, "a", 5), (2, "c", 7)]
    assert merged(spark, "upsert", old, new) == [(1, "b", 5), (2, "d", 8)]
    with pytest.raises(ConflictError):
        merged(spark, "error", old, new)
    assert merged(spark, "error", old, [(3, "x", 1, 0)]) == [(1, "a", 5), (3, "x", 1)]
    with pytest.raises(Exception, match="without a place"):
        merged(spark, "skip", old, [(2, "c", 7, None), (2, "d", 8, None)])
    with pytest.raises(ValueError, match="no key"):
        conflict.conflict_key(TableDef("t", (ColumnDef("v", "text"),)), "skip")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('password="a b" x', "password=*** x"), (r'pwd="a\" b" x', "pwd=*** x"), ("secret='a b", "secret=***"), ("key='a\nb' x", "key=*** x"), ("monkey=5", "monkey=***"), ("token= x", "token=*** x"),
        ("keyless=5", "keyless=5"),
    ],
)
def test_scrubbing_of_quoted_values(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scrub(F.col("t"))).first()[0] == want


def test_next_chunk_skips_in_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found = next_chunk(df, ["o_custkey", "o_orderkey"], (20, 300), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,20)" in plan
    want = sorted((r["o_custkey"], r["o_orderkey"]) for r in df.collect() if (r["o_custkey"], r["o_orderkey"]) > (20, 300))[:10]
    assert [(r["o_custkey"], r["o_orderkey"]) for r in found.collect()] == want


def test_ranges_of_ranks_are_found_by_place(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    ordered = Ordered(df, ["k"])
    assert [sorted(r["k"] for r in ordered.between(a, b).collect()) for a, b in ((0, 10), (495, 505), (990, 2000))] == [list(range(10)), list(range(495, 505)), list(range(990, 1000))]
    assert "PushedFilters: [IsNotNull(__place), GreaterThanOrEqual(__place" in ordered.between(5, 9)._jdf.queryExecution().executedPlan().toString()
    assert Ordered(df.limit(0), ["k"]).between(0, 10).count() == 0


def test_years_of_any_size_round_trip(spark):
    days = [f"{y}-01-31" for y in ("-0044", "0001", "9999", "+10000", "+294246")]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i long, t string")
    df = df.select("i", F.col("t").cast("date").alias("d"), F.concat("t", F.lit("T01:02:03.000004Z")).cast("timestamp").alias("z"), F.concat("t", F.lit("T01:02:03.000004")).cast("timestamp_ntz").alias("n"))
    path, t = fresh_path(spark, "years"), describe(df, "t", ["i"])
    ndjson.write(df, path)
    back = ndjson.rows_of(ndjson.read(spark, path, t), t)

    def told(rows):
        return [tuple(r) for r in rows.select("i", *[F.col(c).cast("string") for c in "dzn"]).orderBy("i").collect()]

    assert told(back) == told(df) and all(None not in r for r in told(df))


def test_problems_are_looked_at_without_parsing_again(spark):
    rows = typed(spark.createDataFrame([('{"i": 1}',), ('{"i": "x"}',)], "value string").repartition(2), TABLE, infinities=True)
    for found in (violations(rows), sound(rows)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json(") + plan.count("parseJson") <= 1 and "Filter" not in plan
    assert [r["i"] for r in sound(rows).collect()] == [1] and sound(rows).columns == [c for c in rows.columns if c != "__problems"]


def test_lines_as_written_are_typed_as_any_others(spark):
    lines = ['{"i":1,"s":"a","b":true,"m":1.5000,"__pos":3}', '{"i":1,"s":5,"b":true,"m":1.5000,"__pos":4}', '{"i":null,"s":"a","b":true,"m":null,"__pos":5}', '{"i":2,"s":null,"b":null,"m":null,"__pos":6,"q":1}', '{"m":2, "i":7}', "{"]
    t = TableDef("t", (ColumnDef("i", "bigint", False, True), ColumnDef("s", "text"), ColumnDef("b", "boolean"), ColumnDef("m", "numeric(20,4)")))
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert typed(df, t, writer=ndjson._WRITE).collect() == typed(df, t).collect()
