import json

import pytest
from pyspark.sql import functions as F

from relslice import catalogue_plans
from relslice.catalog import ColumnDef, Database, FkDef, KeyChoice, TableDef, describe, profile
from relslice.clone import clone
from relslice.dump import dump
from relslice.operators import chunks
from relslice.operators import verify as checks
from relslice.operators.predicates import Seed
from relslice.restore import restore
from relslice.scratch import fresh_path
from relslice.sources import fs, manifest, ndjson
from relslice.sources.warehouse import Warehouse
from relslice.streaming.exports import append_export, table_stream


@pytest.fixture(scope="module")
def db(spark):
    def read(n):
        return spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")

    n, c, o = read("nation"), read("customer"), read("orders")
    return Database.of(
        (describe(n, "nation", ["n_nationkey"]), n),
        (describe(c, "customer", ["c_custkey"], [FkDef(("c_nationkey",), "public.nation", ("n_nationkey",))]), c),
        (describe(o, "orders", ["o_orderkey"], [FkDef(("o_custkey",), "public.customer", ("c_custkey",))]), o),
    )


def same(a, b):
    return a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0


def test_dump_and_restore_are_inverse(spark, db):
    path = fresh_path(spark, "dump")
    seen = []
    done = dump(db, path, on_plan=seen.extend)
    assert [s.table for s in seen] == ["public.nation", "public.customer", "public.orders"]
    assert done["provenance"]["total_rows"] == sum(f.count() for f in db.frames.values())
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    report = restore(spark, path, target, strict=True)
    assert report.tables[0] == "public.nation" and all(same(db.frames[k], target.frame(k)) for k in db.tables)
    assert checks.verify(spark, db, target.database(), strict=True) == (3, [])
    with pytest.raises(ValueError, match="exists"):
        restore(spark, path, target)
    restore(spark, path, target, on_conflict="upsert")
    assert same(db.frames["public.orders"], target.frame("public.orders"))
    with pytest.raises(ValueError, match="finished dump"):
        dump(db, path)


def test_plan_validator_can_stop_a_dump(spark, db):
    path = fresh_path(spark, "dump")

    def refuse(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        dump(db, path, on_plan=refuse)
    assert not fs.exists(spark, path)


@pytest.mark.parametrize(
    "options",
    [
        {"percent": 101}, {"percent": 5, "seeds": [Seed("nation", "n_nationkey", "eq", (1,))]}, {"percent": 5, "workers": 2}, {"percent": 5, "chunk": ["orders"]},
        {"workers": 17}, {"workers": 2, "chunk": ["orders"]}, {"chunk_size": 0},
    ],
)
def test_options_that_do_not_go_together(spark, db, options):
    with pytest.raises(ValueError):
        dump(db, fresh_path(spark, "dump"), **options)


def test_subset_restores_without_orphans(spark, db):
    path = fresh_path(spark, "dump")
    done = dump(db, path, percent=10, strict=True, redacted=True)
    assert done["subset"]["rows_exported"]["public.nation"] > 0
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    assert restore(spark, path, target, strict=True).warnings == []


def test_chunked_dump_resumes(spark, db):
    path = fresh_path(spark, "dump")
    dump(db, path, chunk=["orders", "customer"], chunk_size=100)
    folder = f"{path}/{manifest.data_file(db.tables['public.orders'])}"
    first = fs.listdir(spark, folder)
    fs.delete(spark, f"{path}/metadata.json")
    again = dump(db, path, chunk=["orders", "customer"], chunk_size=100)
    assert fs.listdir(spark, folder) == first and [t["row_count"] for t in again["tables"] if t["name"] == "orders"] == [db.frames["public.orders"].count()]
    fs.delete(spark, f"{path}/metadata.json")
    with pytest.raises(ValueError, match="another export"):
        dump(db, path, chunk=["orders", "customer"], chunk_size=50)


def test_chunks_of_a_table_without_a_key(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines = Database.of((describe(df, "lineitem"), df))
    path = fresh_path(spark, "dump")
    with pytest.raises(ValueError, match="no safe key"):
        dump(lines, path, chunk=["lineitem"], require_safe_key=True)
    done = dump(lines, path, chunk=["lineitem"], chunk_size=1000, redacted=True, transform=lambda _, d: d.withColumn("l_tax", F.col("l_tax") + 1))
    assert done["tables"][0]["row_count"] == df.count()
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(lines.tables))
    restore(spark, path, target)
    assert same(df.withColumn("l_tax", F.col("l_tax") + 1), target.frame("public.lineitem"))


def test_broken_dumps_are_refused(spark, db):
    path = fresh_path(spark, "dump")
    dump(db, path)
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    spec = manifest.read(spark, path)
    fs.delete(spark, f"{path}/{spec['tables'][0]['file']}")
    with pytest.raises(ValueError, match="missing"):
        restore(spark, path, target)
    for change in ({"schema_version": 99}, {"schema": ""}):
        fs.write_text(spark, f"{path}/metadata.json", json.dumps(spec | change))
        with pytest.raises(ValueError):
            restore(spark, path, target)
    with pytest.raises(ValueError, match="outside"):
        manifest.check_files(spark, path, {"tables": [{"file": "../x"}]})


def test_parallel_restore_goes_on_after_a_failure(spark, db):
    path = fresh_path(spark, "dump")
    dump(db, path, workers=3)
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    spec = manifest.read(spark, path)
    orders = f"{path}/{[t['file'] for t in spec['tables'] if t['name'] == 'orders'][0]}"
    fs.write_text(spark, f"{orders}/part-broken.json", "{")
    with pytest.raises(ValueError, match="public.orders: part-broken.json is not of this dump"):
        restore(spark, path, target, workers=2)
    with pytest.raises(Exception, match="not a JSON object"):
        restore(spark, path, target, workers=2, inventory=False)
    state = json.loads(fs.read_text(spark, f"{path}/_load_state.json"))
    assert state["committed"] == ["public.nation", "public.customer"] and state["failed"] == ["public.orders"]
    fs.delete(spark, f"{orders}/part-broken.json")
    other = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    with pytest.raises(ValueError, match="another target"):
        restore(spark, path, other, workers=2)
    assert restore(spark, path, target, workers=2).tables == ["public.orders"]
    assert not fs.exists(spark, f"{path}/_load_state.json") and same(db.frames["public.orders"], target.frame("public.orders"))
    with pytest.raises(ValueError):
        restore(spark, path, target, workers=2, replace=True)


def test_replace_needs_all_inbound_tables(spark, db):
    path = fresh_path(spark, "dump")
    dump(db, path)
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    restore(spark, path, target)
    restore(spark, path, target, replace=True)
    with pytest.raises(ValueError, match="public.orders -> public.customer"):
        restore(spark, path, target, replace=True, exclude=["orders"])


def test_generated_columns_are_computed(spark):
    df = spark.createDataFrame([(1, 5)], "id int, twice int")
    t = TableDef("g", (ColumnDef("id", "integer", False, True), ColumnDef("twice", "integer", generated="id * 2")))
    path = fresh_path(spark, "dump")
    dump(Database.of((t, df)), path)
    target = Warehouse(spark, fresh_path(spark, "wh"), Database({t.key: t}))
    restore(spark, path, target)
    assert [tuple(r) for r in target.frame(t.key).collect()] == [(1, 2)]


def test_marks_never_go_down(spark, db):
    marks = "schema string, table string, column string, last_value long, is_called boolean, min_value long, max_value long"
    source = spark.createDataFrame([("public", "nation", "n_nationkey", 3, True, 1, 10), ("public", "customer", "c_custkey", 10**6, True, None, None)], marks)
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    report = clone(spark, db, target, "replay", source_marks=source)
    got = {r["table"]: (r["last_value"], r["is_called"], r["max_value"]) for r in target.marks().collect()}
    assert got == {"nation": (24, True, None), "customer": (10**6, True, None)}
    assert any("nation" in w for w in report.warnings)
    with pytest.raises(ValueError, match="no table of the dump"):
        checks.owned_marks(source, source.select("schema", "table"), source.select("schema", F.lit("x").alias("table")))


def test_clone_strategies(spark, db):
    for options in ({"strategy": "copy_as_is", "redacted": True}, {"strategy": "other"}, {"strategy": "stream", "percent": 5}):
        with pytest.raises(ValueError):
            clone(spark, db, Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables)), **options)


def test_profile_totals(db):
    rows = profile(db).collect()
    assert {r["total_rows"] for r in rows} == {sum(f.count() for f in db.frames.values())} and rows[0]["n_bytes"] >= rows[-1]["n_bytes"] > 0


def test_run_history(spark, db):
    base = fresh_path(spark, "runs")
    for n in (1, 2, 3):
        dump(db.only(["public.nation"]), f"{base}/{n:04d}")
        if n != 2:
            manifest.register_run(spark, base, f"{base}/{n:04d}", n, "here")
    assert [(r["seq"], r["source"]) for r in manifest.list_runs(spark, base).collect()] == [(3, "here"), (2, ""), (1, "here")]


def test_stream_appends_once(spark, db, tmp_path):
    df = db.frames["public.customer"]
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    df.where("c_custkey < 50").write.mode("append").parquet(src)
    t = db.tables["public.customer"]
    for _ in range(2):
        append_export(table_stream(spark, src, df.schema), t, out, state).awaitTermination()
    df.where("c_custkey >= 50").write.mode("append").parquet(src)
    append_export(table_stream(spark, src, df.schema), t, out, state).awaitTermination()
    assert same(df, spark.read.parquet(out))


def test_loads_add_files_and_leave_those_there(spark):
    df = spark.range(5).select(F.col("id").cast("int").alias("id"), F.lit("a").alias("s"))
    t = describe(df, "t", ["id"])
    target = Warehouse(spark, fresh_path(spark, "wh"), Database({t.key: t}))

    def load(rows, **how):
        path = fresh_path(spark, "dump")
        dump(Database.of((t, rows)), path)
        restore(spark, path, target, **how)
        return set(target.frame(t.key).inputFiles())

    first = load(df)
    second = load(df.select((F.col("id") + 10).alias("id"), "s"))
    assert first < second
    assert second <= load(df.select((F.col("id") + 3).alias("id"), F.lit("b").alias("s")), on_conflict="skip")
    assert sorted(map(tuple, target.frame(t.key).collect())) == [(i, "a") for i in range(5)] + [(i, "b") for i in range(5, 8)] + [(i, "a") for i in range(10, 15)]
    load(df.withColumn("s", F.lit("c")), on_conflict="upsert")
    assert target.frame(t.key).where("s = 'c'").count() == 5 and target.frame(t.key).count() == 13
    # A publication that broke off before its rename is finished by the next call; one after it isn't repeated.
    target.stage(t.key, df.select((F.col("id") + 20).alias("id"), "s"), append=True)
    fs.write_text(spark, f"{target.path}/_publish.json", json.dumps({"pending": [t.key]}))
    target.recover()
    fs.write_text(spark, f"{target.path}/_publish.json", json.dumps({"pending": [t.key]}))
    target.recover()
    assert target.frame(t.key).count() == 18


def test_resumed_chunks_must_be_of_the_same_data(spark):
    source = fresh_path(spark, "source")
    spark.range(50).write.parquet(source)
    path = fresh_path(spark, "dump")

    def db():
        df = spark.read.parquet(source)
        return Database.of((describe(df, "t", ["id"]), df))

    dump(db(), path, chunk=["t"], chunk_size=10)
    fs.delete(spark, f"{path}/metadata.json")
    dump(db(), path, chunk=["t"], chunk_size=10)
    fs.delete(spark, f"{path}/metadata.json")
    spark.range(50, 60).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="another export"):
        dump(db(), path, chunk=["t"], chunk_size=10)


def test_counts_of_dumps_come_from_the_write(spark):
    df = spark.range(7).withColumn("s", F.lit("x"))
    empty = df.limit(0)
    done = dump(Database.of((describe(df, "t", ["id"]), df), (describe(empty, "e", ["id"]), empty)), fresh_path(spark, "dump"), workers=2)
    assert {t["name"]: t["row_count"] for t in done["tables"]} == {"t": 7, "e": 0}


def test_replay_computes_statistics(spark, db):
    target = Warehouse(spark, fresh_path(spark, "wh"), Database(db.tables))
    spark.sql("CREATE DATABASE IF NOT EXISTS copied")
    clone(spark, db, target, "replay", statistics="copied")
    told = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE TABLE EXTENDED copied.nation").collect()}
    assert "25 rows" in told["Statistics"]
    spark.sql("DROP DATABASE copied CASCADE")
    assert target.frame("public.nation").count() == 25


def test_chunked_exports_have_few_jobs_and_resume_behind_a_gap(spark, monkeypatch):
    df, out = spark.range(1000).withColumn("s", F.lit("x")).repartition(3), fresh_path(spark, "chunks")
    t, choice, jobs = describe(df, "t", ["id"]), KeyChoice("primary_key", ("id",)), []

    def export(path=out, rows=df):
        jobs.clear()
        return chunks.export_chunks(rows, path, t.key, choice, 2, {}, df.columns, lambda part: jobs.append(1) or part, per_job=2)

    assert export() == 1000 and len(jobs) <= chunks.JOBS + 5
    folders = [f"chunks-{i:09d}" for i in range(0, 500, 2)]
    assert [f for f in fs.listdir(spark, out) if not f.startswith("_")] == folders
    for gone in (folders[0], folders[7], folders[-1]):
        fs.delete(spark, f"{out}/{gone}")
    export()
    assert len(jobs) == 3 and [f for f in fs.listdir(spark, out) if not f.startswith("_")] == folders
    assert fs.files(spark, f"{out}/{folders[7]}")[0].startswith("chunk_id=14/")
    assert same(df, ndjson.rows_of(ndjson.read(spark, out, t), t).drop("__pos"))
    none = fresh_path(spark, "chunks")
    assert export(none, df.limit(0)) == 0 and [f for f in fs.listdir(spark, none) if not f.startswith("_")] == folders[:1]


def test_the_chunked_query_is_run_again_over_its_finished_chunks(spark, monkeypatch):
    ends = []

    def told(*args, **options):
        try:
            done = dump(*args, **options)
        except InterruptedError:
            ends.append("cut off")
            raise
        ends.append([t["row_count"] for t in done["tables"]])

    monkeypatch.setattr(catalogue_plans, "dump", told)
    rows = catalogue_plans.dump_chunked(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert ends == ["cut off", [lines.count(), 5]] and same(lines, rows)


def test_an_interruption_keeps_the_folders_of_large_chunks(spark, monkeypatch):
    for name, n in (("FOLDER_ROWS", 100), ("FILE_ROWS", 30), ("SMALL_CHUNK", 10)):
        monkeypatch.setattr(chunks, name, n)
    source, path, jobs = fresh_path(spark, "source"), fresh_path(spark, "dump"), []
    spark.range(990).withColumn("s", F.lit("x")).repartition(3).write.parquet(source)
    df = spark.read.parquet(source)
    db = Database.of((describe(df, "t"), df))
    folder = f"{path}/{manifest.data_file(db.tables['public.t'])}"

    def cut(*_):
        jobs.append(1)
        if len(jobs) == 4:
            raise InterruptedError
        return {}

    def run():
        return dump(db, path, chunk=["t"], chunk_size=50, transform=cut)

    with pytest.raises(InterruptedError):
        run()
    first = fs.files(spark, folder)
    assert [f for f in fs.listdir(spark, folder) if f.startswith("chunks")] == [f"chunks-{i:09d}" for i in (0, 2, 4)]
    done = run()
    assert len(jobs) == 4 + 7 and set(first) < set(fs.files(spark, folder)) and done["tables"][0]["row_count"] == 990
    rows = ndjson.rows_of(ndjson.read(spark, folder, db.tables["public.t"]), db.tables["public.t"])
    assert same(df, rows.drop("__pos")) and sorted(r["__pos"] for r in rows.collect()) == list(range(990))
    for i in range(20):
        assert spark.read.json(f"{folder}/chunks-{i // 2 * 2:09d}/chunk_id={i}").agg(F.min("__pos"), F.max("__pos")).first() == (50 * i, min(50 * i + 49, 989))
    fs.delete(spark, f"{path}/metadata.json")
    monkeypatch.setattr(chunks, "Ordered", None)  # whole chunks are counted, not ordered again
    assert run()["tables"][0]["row_count"] == 990 and len(jobs) == 11


def test_chunks_of_an_older_layout_are_resumed_in_their_folders(spark, monkeypatch):
    df, out = spark.range(100).withColumn("s", F.lit("x")), fresh_path(spark, "chunks")
    t, choice = describe(df, "t", ["id"]), KeyChoice("primary_key", ("id",))

    def export(rows=df, **options):
        return chunks.export_chunks(rows, out, t.key, choice, 5, {}, df.columns, **options)

    export(per_job=chunks.FOLDER_CHUNKS)
    plan = json.loads(fs.read_text(spark, f"{out}/_plan.json"))
    fs.write_text(spark, f"{out}/_plan.json", json.dumps({k: v for k, v in plan.items() if k not in ("per_job", "n_rows")}))
    monkeypatch.setattr(chunks, "FOLDER_ROWS", 10)
    assert export() == 100 and [f for f in fs.listdir(spark, out) if f.startswith("chunks")] == ["chunks-000000000"]
    assert json.loads(fs.read_text(spark, f"{out}/_plan.json")) == plan
    # Of the same files, but with fewer rows.
    source = fresh_path(spark, "source")
    df.write.parquet(source)
    df, out = spark.read.parquet(source), fresh_path(spark, "chunks")
    export(df)
    with pytest.raises(ValueError, match="another export"):
        export(df.where("id < 7"))


def test_a_range_of_ranks_reads_its_own_files(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FILE_ROWS", 10)
    ordered = chunks.Ordered(spark.range(1000).repartition(5), ["id"])
    assert len(ordered.rows.inputFiles()) >= 100
    for a, b in ((0, 10), (495, 505), (990, 2000), (0, 1000), (31, 32)):
        part = ordered.between(a, b)
        assert sorted((r["id"], r["rank"]) for r in part.collect()) == [(i, i) for i in range(a, min(b, 1000))]
        assert len(part.inputFiles()) <= (b - a) // 10 + 4 or b >= 1000
