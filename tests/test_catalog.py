import pytest
from pyspark.sql import functions as F

from relslice import catalog
from relslice.catalog import ColumnDef, Database, FkDef, TableDef, UniqueDef, apply_transform, choose_key, describe, key_or_row_id, key_violations, profile, qualify, schema_violations, with_row_id
from relslice.plans.graph import fk_levels, fk_order, view_order
from relslice.plans.selection import exclude_for_restore, foreign_keys, partition_leaves, row_tables, schema_scope, select_tables


def t(name, pk=("id",), fks=(), schema="public", columns=(), **more):
    own = [ColumnDef(c, "integer", False, True) for c in pk] + [ColumnDef(c, "integer") for f in fks for c in f.columns if c not in pk]
    return TableDef(name, (*own, *columns), schema, tuple(fks), **more)


def db(*tables):
    return Database({x.key: x for x in tables})


def ref(column, parent):
    return FkDef((column,), parent, ("id",))


def test_names_with_dots_are_quoted():
    assert qualify("a", "b.c") == 'a."b.c"'


def test_resolve_needs_a_single_match():
    d = db(t("x"), t("x", schema="other"), t("y"))
    assert d.resolve("y").key == "public.y"
    with pytest.raises(ValueError, match="ambiguous: other.x, public.x"):
        d.resolve("x")
    with pytest.raises(ValueError, match="unknown"):
        d.resolve("z")


def test_key_choice_prefers_pk_then_shortest_unique():
    solid = ColumnDef("a", "text", False), ColumnDef("b", "text", False), ColumnDef("n", "text")
    assert choose_key(t("x")).strategy == "primary_key"
    u = (UniqueDef("u2", ("a", "b")), UniqueDef("u1", ("b",)), UniqueDef("u0", ("n",)), UniqueDef("u9", ("a",), False))
    assert choose_key(TableDef("x", solid, uniques=u)).columns == ("b",)
    assert choose_key(TableDef("x", solid)) is None
    with pytest.raises(ValueError, match="no safe key"):
        key_or_row_id(TableDef("x", solid), require_safe_key=True)


def test_row_id_is_unique(spark):
    df = with_row_id(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    assert df.select("__file", "__row").distinct().count() == df.count()


def test_key_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, s string")
    assert {tuple(r) for r in key_violations(df, ["i", "s"]).collect()} == {(1, "a", 2), (2, None, 1)}


def test_schema_scope():
    assert schema_scope(["a", "b", "c"], [" b", "b", "a"], ["a"]) == ["b"]
    assert schema_scope(["a", "b"]) == ["a", "b"]
    for bad in ((["x"], []), ([], ["x"]), (["a"], ["a"])):
        with pytest.raises(ValueError):
            schema_scope(["a"], *bad)


def test_selection_and_partitions():
    d = db(t("p", kind="partitioned"), t("p1", partition_of="public.p"), t("p2", partition_of="public.p", kind="partitioned"), t("p2a", partition_of="public.p2"), t("q"))
    assert partition_leaves(d, "public.p") == ["public.p1", "public.p2a"]
    assert set(row_tables(d).tables) == {"public.p1", "public.p2a", "public.q"}
    with pytest.raises(ValueError, match="public.p1, public.p2a"):
        select_tables(d, ["p"])
    picked, how = select_tables(d, exclude=["p", "nothing"])
    assert set(picked.tables) == {"public.q"} and how["warnings"]
    picked, _ = select_tables(d, include=["p1", "q"], exclude=["p"])
    assert set(picked.tables) == {"public.p1", "public.q"}
    with pytest.raises(ValueError, match="unknown"):
        select_tables(d, ["nothing"])


def test_restore_exclusion():
    d = db(t("a"), t("b"))
    assert set(exclude_for_restore(d, ["a"]).tables) == {"public.b"}
    with pytest.raises(ValueError, match="all tables"):
        exclude_for_restore(d, ["a", "b"])


def test_foreign_key_out_of_selection_is_named():
    with pytest.raises(ValueError, match="public.gone"):
        foreign_keys(db(t("a", fks=[ref("g", "public.gone")])))


def test_orders_with_cycles():
    d = db(t("c", fks=[ref("b", "public.b")]), t("b", fks=[ref("a", "public.a")]), t("a"), t("self", fks=[ref("s", "public.self")]))
    assert fk_order(d) == ["public.a", "public.b", "public.c", "public.self"]
    with pytest.raises(ValueError, match="public.self"):
        fk_levels(d)
    assert fk_levels(d.only(k for k in d.tables if k != "public.self")) == [["public.a"], ["public.b"], ["public.c"]]
    ring = db(t("x", fks=[ref("y", "public.y")]), t("y", fks=[ref("x", "public.x")]), t("a"))
    assert fk_order(ring) == ["public.a", "public.x", "public.y"]


def test_view_order():
    assert view_order({"a": {"b", "t"}, "b": set()}, {"a", "b"}) == ["b", "a"]
    with pytest.raises(ValueError, match="not populated"):
        view_order({"a": {"b"}, "b": set()}, {"a"})
    with pytest.raises(ValueError, match="cycle"):
        view_order({"a": {"b"}, "b": {"a"}}, {"a", "b"})


def test_schema_violations(spark):
    src = db(TableDef("a", (ColumnDef("i", "integer", False, True), ColumnDef("s", "text"))), t("lost"))
    tgt = db(TableDef("a", (ColumnDef("i", "INTEGER", False, True), ColumnDef("s", "text", False), ColumnDef("more", "text"))))
    found = {tuple(r) for r in schema_violations(spark, src, tgt).collect()}
    assert found == {("public.a", "s", "nullability"), ("public.lost", "id", "missing table")}


def test_transform_keeps_the_column_set(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    out = apply_transform(describe(df, "t"), df, lambda _, d: d.drop("s").selectExpr("*", "i + 1 AS extra").withColumn("i", d["i"] * 10))
    assert [tuple(r) for r in out.collect()] == [(10, "a")] and out.columns == ["i", "s"]
    with pytest.raises(ValueError, match="returned nothing"):
        apply_transform(describe(df, "t"), df, lambda _, d: None)


def test_transform_by_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, x double")
    out = apply_transform(describe(df, "t"), df, lambda _, d: {"i": d["i"] + 1, "s": F.upper("s"), "more": d["x"]})
    assert out.columns == ["i", "s", "x"] and [tuple(r) for r in out.collect()] == [(2, "A", 2.0)]
    with pytest.raises(ValueError, match="mapping"):
        apply_transform(describe(df, "t"), df, lambda _, d: d.select("i"))


def test_a_transform_may_select_all_columns(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    out = apply_transform(describe(df, "t"), df, lambda _, d: d.select(F.upper("s").alias("s"), (d["i"] + 1).alias("i")))
    assert out.columns == ["i", "s"] and [tuple(r) for r in out.collect()] == [(2, "A")]
    with pytest.raises(ValueError, match="lost columns i "):
        apply_transform(describe(df, "t"), df, lambda _, d: d.select("s"))


def test_all_problems_of_a_column_are_told(spark):
    src = db(TableDef("a", (ColumnDef("i", "integer", False, True), ColumnDef("s", "text", generated="i + 1"))))
    tgt = db(TableDef("a", (ColumnDef("s", "bigint", False, identity="ALWAYS"), ColumnDef("i", "integer", False, True))))
    found = {tuple(r)[1:] for r in schema_violations(spark, src, tgt).collect()}
    assert found == {("i", "ordinal"), *(("s", p) for p in ("ordinal", "type", "nullability", "identity", "generation"))}


def test_rows_are_counted_by_footers(spark, tmp_path):
    path = str(tmp_path / "with space" / "t")
    spark.range(1000).withColumn("s", F.lit("x")).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    other = df.where("id < 10")
    told = {r["name"]: (r["n_rows"], r["n_bytes"] is not None, r["total_rows"]) for r in profile(Database.of((describe(df, "whole"), df), (describe(other, "some"), other.select("id")))).collect()}
    assert told == {"whole": (1000, True, 1010), "some": (10, True, 1010)}
    assert catalog._whole_files(df.select("s")) and not catalog._whole_files(other) and not catalog._whole_files(df.limit(5)) and not catalog._whole_files(df.union(df))
    plan = catalog._footers(spark, [path])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
