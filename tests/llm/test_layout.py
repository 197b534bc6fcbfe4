import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relslice.llm import entries, mixing, sharding


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


ROWS = [(i, "w " * (i % 7), f"s{i % 3}", "own") for i in range(200)] + [(7, None, None, "x"), (None, "a b", None, "y"), (7, None, None, "x")]


# Sharding -----------------------------------------------------------------------------------------------------


def test_shards_obey_their_law(spark):
    out = sharding.shard(docs_of(spark, ROWS).repartition(5), 24, seed=3, bucket_bytes=2000)
    got = out.collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["source"], r["size"]) for r in got))) == sorted(map(str, ROWS))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shuffling_is_repeatable_and_seeded(spark):
    rows = [r for r in ROWS if r[0] is not None][:200]

    def order(seed, parts):
        out = sharding.shard(docs_of(spark, rows).repartition(parts), 1, seed=seed, bucket_bytes=1500)
        return [r["doc_id"] for r in out.orderBy("slot").collect()]

    assert order(1, 2) == order(1, 7) != order(2, 2)


def test_a_hot_key_is_split(spark):
    docs = docs_of(spark, [(1, "same text", "s", "x")] * 3000 + ROWS)
    mixed = sharding.external_shuffle(docs, bucket_bytes=20_000)
    sizes = Counter(r["bucket"] for r in mixed.select("bucket").collect())
    assert sum(sizes.values()) == 3000 + len(ROWS) and max(sizes.values()) < 600


def test_fewer_rows_than_shards_and_none(spark):
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard(docs_of(spark, ROWS[:3]), 24).collect()) == [(s, 0) for s in (0, 8, 16)]
    assert sharding.shard(docs_of(spark, ROWS[:1]).limit(0), 24).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 300), st.integers(0, 5), st.integers(0, 9))
def test_fisher_yates_is_a_permutation(n, seed, bucket):
    assert sorted(sharding.fisher_yates(n, seed, bucket).tolist()) == list(range(n))


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, 0, b).tolist()) for b in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_written_shards_are_in_slot_order(spark, tmp_path):
    sharding.write_shards(docs_of(spark, ROWS), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_op3_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in entries.op3_external_shuffle(spark, "/root/testdata/sf0.001").collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


# Mixing -------------------------------------------------------------------------------------------------------


def filled(sizes, weights, total, epochs):
    """Clamping and resharing round by round, in exact fractions."""
    from fractions import Fraction as Q

    caps, done = [epochs * Q(s) for s in sizes], {}
    open_ = [i for i, w in enumerate(weights) if w > 0]
    left = Q(total)
    while open_:
        weight = sum(Q(weights[i]) for i in open_)
        above = [i for i in open_ if Q(weights[i]) * left / weight > caps[i]]
        if not above:
            done |= {i: Q(weights[i]) * left / weight for i in open_}
            break
        for i in above:
            done[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in above]
    return [float(done.get(i, 0)) for i in range(len(sizes))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 5)), min_size=1, max_size=8), st.floats(0, 3))
def test_water_filling_equals_clamping_round_by_round(sources, share):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    total = int(share * sum(sizes))
    assert mixing.water_fill(sizes, weights, total, 2) == pytest.approx(filled(sizes, weights, total, 2), rel=1e-9, abs=1e-6)


def mixed_rows(spark, rows, seed=0):
    out = mixing.mix(docs_of(spark, rows), lambda names: [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, seed=seed)
    return out, out.collect()


def test_mix_meets_its_targets(spark):
    out, got = mixed_rows(spark, ROWS)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "repeats", "taken"]
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["size"] * r["repeats"] <= 2 * r["size"]
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None), key=str) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, n, t in zip(names, sizes, filled(sizes, [5, 2, 1, 5], 1.5 * sum(sizes), 2), strict=True):
        assert {r["source_size"] for r in by[s]} == {n} and by[s][0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in by[s]) - t) <= max(r["size"] for r in by[s]) / 2
    assert sorted(map(str, mixed_rows(spark, ROWS)[1])) == sorted(map(str, got))
    assert mixing.repeated(out, ["doc_id"]).count() == sum(r["repeats"] for r in got)


def test_mix_of_nothing(spark):
    assert mixed_rows(spark, [(1, None, "s", "x")])[1][0]["taken"] == 0
    assert mixing.mix(docs_of(spark, ROWS[:1]).limit(0), lambda names: [1] * len(names), 1.0).count() == 0


def test_mix_with_a_hot_source_and_repeated_rows(spark):
    rows = [(5, "one two three", "hot", "x")] * 500 + ROWS
    _, got = mixed_rows(spark, rows)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), min_size=1, max_size=9), st.sampled_from([0.0, 0.4, 1.5, 2.0, 5.0]))
def test_weights_by_a_rule_fill_as_weights_by_a_list(spark, sources, share):
    """The same plan by Spark as by the driver, also for sources of weight 0, of size 0, and all full."""
    rows = [(100 * i + j, "w " * (j % 5), None if i == 0 else f"s{i}", "x") for i, (n, _) in enumerate(sources) for j in range(n)] or [(1, "w", "s", "x")]
    docs = docs_of(spark, rows)
    listed = mixing.mix(docs, lambda names: [(5, 0, 1, 2)[i % 4] for i in range(len(names))], share)
    ruled = mixing.mix(docs, None, share, by_rank=lambda at: F.element_at(F.array(F.lit(5), F.lit(0), F.lit(1), F.lit(2)), (at % 4 + 1).cast("int")))
    assert sorted(map(str, listed.collect())) == sorted(map(str, ruled.collect()))


def test_more_sources_than_may_be_listed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 500)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 4).cast("int")).alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000)).alias("source"))
    with pytest.raises(ValueError, match="more than 500 sources"):
        mixing.mix(docs, lambda names: [1] * len(names), 1.0)
    got = mixing.mix(docs, None, 1.5, by_rank=entries.weight_in_turn, columns=["doc_id"])
    assert got.count() == 6000 and got.where("target is null or taken > 2 * size").count() == 0
    told = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).agg(F.sum("t")).first()[0]
    assert abs(told - 1.5 * got.agg(F.sum("size")).first()[0]) < 0.02 * told


def test_seeded_order_is_md5_of_seed_and_key(spark):
    _, got = mixed_rows(spark, [(i, "a b", "s", "x") for i in range(50)] + [(99, "c " * 500, "z", "x")])
    s = sorted((r for r in got if r["source"] == "s"), key=lambda r: hashlib.md5(f"0:{r['doc_id']}".encode()).hexdigest())
    assert [r["repeats"] for r in s] == sorted((r["repeats"] for r in s), reverse=True)


def test_shards_of_a_hot_key_do_not_depend_on_the_input_split(spark):
    rows = [(7, f"text {i} " * 20, i) for i in range(300)] + [(i, "x", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")

    def dealt(d):
        return sorted((r["other"], r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(d, 4, seed=3, bucket_bytes=4000).collect())

    assert dealt(df.repartition(7)) == dealt(df.coalesce(1)) and len(dealt(df)) == len(rows)
    same = spark.createDataFrame([(7, "y" * 500, 1)] * 200, "doc_id long, text string, other int").repartition(5)
    parts = sharding.external_shuffle(same, bucket_bytes=4000).groupBy("bucket").count().collect()
    assert len(parts) > 5 and sum(r["count"] for r in parts) == 200


def test_equal_rows_that_fill_a_bucket_do_not_move_the_others(spark):
    """One kind of row fills a bucket many times; the other rows are where they are, however the input is split."""
    rows = [(7, "same " * 30, 1)] * 400 + [(7, f"other {i} " * 10, 2) for i in range(60)] + [(i, f"text {i}", 3) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")

    def dealt(d):
        return sorted((r["other"], r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shard(d, 6, seed=3, bucket_bytes=4000).collect())

    once = dealt(df.repartition(9))
    assert once == dealt(df.coalesce(1)) == dealt(df.orderBy(F.desc("text")).repartition(3)) and len(once) == len(rows)
