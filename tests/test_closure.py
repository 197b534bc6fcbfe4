import pytest
from pyspark.sql import functions as F

from relslice.catalog import ColumnDef, Database, FkDef, TableDef, describe
from relslice.operators import closure
from relslice.operators.closure import SubsetLimitError, check_integrity, closure_of_percent, closure_of_seeds, exported, percent_roots
from relslice.operators.predicates import Limits, Seed, SeedError, read_seed_file, select_keys
from relslice.operators.recency import is_pure_join_table, percent_limit, recency_column


@pytest.fixture(scope="module")
def company(spark):
    """Departments, people (nullable parent, self-reference) and a join table with a composite key."""
    i, s = "integer", "text"
    dep = TableDef("dep", (ColumnDef("id", i, False, True), ColumnDef("code", s, False)))
    person = TableDef("person", (ColumnDef("id", i, False, True), ColumnDef("dep", s), ColumnDef("boss", i)), fks=(FkDef(("dep",), "public.dep", ("code",)), FkDef(("boss",), "public.person", ("id",))))
    task = TableDef("task", (ColumnDef("id", i, False, True), ColumnDef("name", s)))
    does = TableDef("does", (ColumnDef("person", i, False, True), ColumnDef("task", i, False, True)), fks=(FkDef(("person",), "public.person", ("id",)), FkDef(("task",), "public.task", ("id",))))
    f = spark.createDataFrame
    return Database.of(
        (dep, f([(1, "d1"), (2, "d2"), (3, "d3")], "id int, code string")),
        (person, f([(10, "d1", None), (11, "d1", 10), (12, "d2", None), (13, None, 12)], "id int, dep string, boss int")),
        (task, f([(7, "x"), (8, "y")], "id int, name string")),
        (does, f([(10, 7), (12, 7), (11, 8)], "person int, task int")),
    )


def keys(plan, table):
    df = plan.keys.get(f"public.{table}")
    return sorted(r[0] for r in df.collect()) if df is not None else []


def test_foreign_keys_follow_referenced_columns(company):
    plan = closure_of_seeds(company, [Seed("person", "id", "eq", (11,))])
    assert keys(plan, "dep") == [1] and keys(plan, "person") == [10, 11]
    # The join table is in the plan, its other parent isn't: only the visited parent binds.
    assert sorted(map(tuple, exported(company, plan, "public.does").collect())) == [(10, 7), (11, 8)]
    bad = {k for k, o in check_integrity(company, plan).items() if o.count()}
    assert bad == {("public.does", "public.task")}  # the parent that the plan leaves out


def test_composite_parents_join_the_plan(spark):
    """c(id, x, y) refers to p(x, y), which refers to q (single key) and r (x, y), which refers to q, too."""
    i = "integer"
    q = TableDef("q", (ColumnDef("id", i, False, True),))
    r = TableDef("r", (ColumnDef("x", i, False, True), ColumnDef("y", i, False, True), ColumnDef("q", i)), fks=(FkDef(("q",), "public.q", ("id",)),))
    p = TableDef("p", (ColumnDef("x", i, False, True), ColumnDef("y", i, False, True), ColumnDef("q", i)), fks=(FkDef(("q",), "public.q", ("id",)), FkDef(("x", "y"), "public.r", ("x", "y"))))
    c = TableDef("c", (ColumnDef("id", i, False, True), ColumnDef("x", i), ColumnDef("y", i)), fks=(FkDef(("x", "y"), "public.p", ("x", "y")),))
    f = spark.createDataFrame
    db = Database.of(
        (q, f([(1,), (2,), (3,)], "id int")),
        (r, f([(1, 1, 3), (1, 2, 2)], "x int, y int, q int")),
        (p, f([(1, 1, 1), (1, 2, 2), (2, 2, None)], "x int, y int, q int")),
        (c, f([(10, 1, 1), (11, 1, 2), (12, None, 1)], "id int, x int, y int")),
    )
    for seed, pairs, singles in (((10,), [(1, 1)], [1, 3]), ((12,), None, [])):
        plan = closure_of_seeds(db, [Seed("c", "id", "eq", seed)])
        if pairs is None:
            assert plan.order == ["public.c"]
            continue
        assert plan.order == ["public.q", "public.r", "public.p", "public.c"] and keys(plan, "q") == singles
        # q leads back down to all of p and r whose planned parents are exported.
        assert {(x, y) for x, y, _ in exported(db, plan, "public.p").collect()} == set(pairs)
        assert {(x, y) for x, y, _ in exported(db, plan, "public.r").collect()} == set(pairs)
        assert all(o.count() == 0 for o in check_integrity(db, plan).values())
    plan = closure_of_percent(db, 100)
    assert all(o.count() == 0 for o in check_integrity(db, plan).values()) and exported(db, plan, "public.p").count() >= 2
    with pytest.raises(SubsetLimitError, match="max_tables"):
        closure_of_seeds(db, [Seed("c", "id", "eq", (10,))], Limits(max_tables=2))


def test_null_parents_lead_nowhere(company):
    plan = closure_of_seeds(company, [Seed("person", "id", "eq", (13,))])
    assert keys(plan, "person") == [12, 13] and keys(plan, "dep") == [2]


def test_limits(company):
    with pytest.raises(SubsetLimitError) as e:
        closure_of_seeds(company, [Seed("person", "id", "eq", (11,))], Limits(max_rows=3))
    assert e.value.limit == "max_rows"
    with pytest.raises(SubsetLimitError) as e:
        closure_of_seeds(company, [Seed("person", "id", "eq", (11,))], Limits(max_tables=1))
    assert e.value.limit == "max_tables"
    with pytest.raises(SubsetLimitError) as e:
        closure_of_seeds(company, [Seed("person", "id", "eq", (11,))], Limits(max_depth=0))
    assert e.value.limit == "max_depth"


def test_cap_takes_recent_children(company):
    plan = closure_of_seeds(company, [Seed("dep", "id", "eq", (1,))], Limits(max_rows_per_table=1))
    assert keys(plan, "person") == [10, 11]  # 11 as the most recent child, 10 as its parent


def test_empty_seed_gives_an_empty_plan(company):
    plan = closure_of_seeds(company, [Seed("task", "name", "eq", ("none",))])
    assert plan.order == [] and plan.rows_read == 0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_plan_does_not_depend_on_partitions(spark, company, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        plan = closure_of_seeds(company, [Seed("person", "id", "in", (10, 12))])
        assert (keys(plan, "person"), keys(plan, "dep")) == ([10, 11, 12, 13], [1, 2])
        assert plan.rows_read == 2 + 2 * 4 + 3 + 2  # seeds; two foreign keys for each of four people; people of both departments; staff of bosses
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_percent(company):
    roots = percent_roots(company, 50)
    assert {(t.name, o, n) for t, o, n in roots} == {("dep", "id", 2), ("task", "id", 1)}
    plan = closure_of_percent(company, 50)
    assert keys(plan, "task") == [8] and set(keys(plan, "dep")) >= {2, 3}
    with pytest.raises(ValueError):
        closure_of_percent(company, 0)
    with pytest.raises(ValueError, match="no table"):
        percent_roots(company.only(["public.does"]), 10)


def test_percent_limit():
    assert [percent_limit(n, 10) for n in (0, 1, 10, 11)] == [0, 1, 1, 2]


def test_recency():
    t = TableDef("t", (ColumnDef("id", "uuid", False, True), ColumnDef("Updated_At", "date"), ColumnDef("CREATED_ON", "date")))
    assert recency_column(t) == "CREATED_ON"
    assert recency_column(TableDef("t", (ColumnDef("id", "uuid", False, True),))) is None
    join = TableDef("j", (ColumnDef("a", "int", False, True), ColumnDef("b", "int", False, True)), fks=(FkDef(("a",), "x", ("id",)), FkDef(("b",), "y", ("id",))))
    assert is_pure_join_table(join)


@pytest.mark.parametrize(
    "seed",
    [
        Seed("nope", "id", "eq", (1,)), Seed("does", "person", "eq", (1,)), Seed("dep", "nope", "eq", (1,)), Seed("dep", "id", "eq", ("1",)),
        Seed("dep", "id", "eq", (1, 2)), Seed("dep", "id", "in"), Seed("dep", "id", "is_null", (1,)), Seed("dep", "id", "like", ("a",)), Seed("dep", "code", "like", (1,)), Seed("dep", "id", "near", (1,)),
    ],
)
def test_bad_seeds(company, seed):
    with pytest.raises(SeedError):
        closure_of_seeds(company, [seed])


def test_no_seeds(company):
    with pytest.raises(SeedError):
        closure_of_seeds(company, [])


def test_long_lists_are_joined(company):
    df = select_keys(company.frames["public.dep"], company.tables["public.dep"], Seed("dep", "id", "in", tuple(range(2, 2000))))
    assert sorted(r[0] for r in df.collect()) == [2, 3]


def test_seed_file():
    f = read_seed_file('{"seeds": [{"table": "a", "column": "b", "op": "in", "values": [1]}], "limits": {"max_rows": 5, "max_depth": 3}}', max_depth=4)
    assert f.seeds == [Seed("a", "b", "in", (1,))] and (f.limits.max_rows, f.limits.max_depth, f.limits.max_tables) == (5, 4, 50)


def test_large_tables_are_followed_by_bucketed_edges(spark, monkeypatch):
    """From its second hop on, a large child is not shuffled again, in either direction; the closure is the same."""
    df = spark.range(400).select(F.col("id").cast("int").alias("id"), (F.col("id") / 3).cast("int").alias("up"), F.lit("x").alias("wide"))
    df = df.where("id > 0")
    db = Database.of((describe(df, "node", ["id"], [FkDef(("up",), "public.node", ("id",))]), df))
    seeds, limits = [Seed("node", "id", "eq", (5,))], Limits(max_depth=40, max_rows=10**6)
    want = closure.closure_of_seeds(db, seeds, limits)
    monkeypatch.setattr(closure, "EDGE_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, real = [], closure._Closure.edges

    def watched(self, child, fk, by):
        edges = real(self, child, fk, by)
        if edges is not None:
            keys = spark.range(50).select(F.col("id").cast("int").alias("id"))
            plans.append(closure._semi(edges, list(by), keys, ["id"])._jdf.queryExecution().executedPlan().toString())
        return edges

    monkeypatch.setattr(closure._Closure, "edges", watched)
    try:
        got = closure.closure_of_seeds(db, seeds, limits)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got.keys["public.node"].collect())) == sorted(map(tuple, want.keys["public.node"].collect()))
    assert got.counts == want.counts and got.rows_read == want.rows_read
    assert len(plans) > 2 and all(p.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in p for p in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("relslice_edges")]


def test_rows_that_are_required_count_as_read(spark):
    """Parents with a composite key aren't traversed, but their rows are read, too."""
    i = "integer"
    up = TableDef("up", (ColumnDef("a", i, False, True), ColumnDef("b", i, False, True)))
    down = TableDef("down", (ColumnDef("id", i, False, True), ColumnDef("a", i), ColumnDef("b", i)), fks=(FkDef(("a", "b"), "public.up", ("a", "b")),))
    db = Database.of((up, spark.createDataFrame([(k, k) for k in range(20)], "a int, b int")), (down, spark.createDataFrame([(k, k, k) for k in range(20)], "id int, a int, b int")))
    plan = closure_of_seeds(db, [Seed("down", "id", "lt", (9,))])
    assert plan.rows_read == 9 + 9 + 9  # the seeds, their foreign keys, the rows that these require
    with pytest.raises(SubsetLimitError, match="max_rows"):
        closure_of_seeds(db, [Seed("down", "id", "lt", (9,))], Limits(max_rows=20))
