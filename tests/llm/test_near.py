import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relslice.llm import ann, entries, minhash
from relslice.llm.components import connected_components

# Near duplicates ----------------------------------------------------------------------------------------------


def truth(rows, k, percent):
    """Sizes and components by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [(key, len(sets[i]), least.get(top(i), key) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def found(spark, rows, k=2, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = minhash.near_duplicates(df, k, percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def edited(rng, words, share):
    return " ".join(rng.choice("qrstuv") * 3 + str(rng.randrange(50)) if rng.random() < share else w for w in words)


def family(seed):
    """Copies, near copies, chains of near copies and short texts."""
    rng = random.Random(seed)
    rows = []
    for size in (3, 6, 12, 30, 80):
        words = [f"w{rng.randrange(40)}" for _ in range(size)]
        rows += [" ".join(words)] * 3 + [edited(rng, words, s) for s in (0.02, 0.04, 0.06, 0.09, 0.15) for _ in range(6)]
        for _ in range(8):
            words = edited(rng, words, 0.05).split()
            rows.append(" ".join(words))
    rows += ["", None, " \n ", "one", "ONE", "one two", "one  two", "é è", "É è", "a b c d", "a b c d e"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 2), (3, 5)])
def test_components_equal_brute_force(spark, seed, k):
    rows = family(seed)
    assert found(spark, rows, k) == sorted(truth(rows, k, 80), key=str)


@pytest.mark.parametrize(("rounds", "split"), [(1, 1), (3, 1), (1, 100)])
def test_outliers_of_a_large_group_are_compared_in_blocks(spark, monkeypatch, rounds, split):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SPLIT_BLOCKS", split)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rng, words, rng.choice((0.02, 0.06, 0.08)))) for i in range(150)]
    assert found(spark, rows) == sorted(truth(rows, 2, 80), key=str)


def test_texts_linked_by_later_centres_are_not_compared_again(spark):
    """Two groups of near copies share buckets: each gets a centre of its own, and no text meets its own group's."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    other = [w if i % 9 else f"x{i}" for i, w in enumerate(words)]
    rows = [(i, edited(rng, other if i % 3 else words, 0.02)) for i in range(120)]
    assert found(spark, rows) == sorted(truth(rows, 2, 80), key=str)


@pytest.mark.parametrize(("percent", "rows"), [(100, 4), (80, 4), (79, 2), (60, 2), (48, 2), (30, 1), (12, 1)])
def test_bands_suit_the_similarity(percent, rows):
    assert minhash.rows_per_band(percent) == rows and (1 - (percent / 100) ** rows) ** (128 / rows) <= minhash.MISS


def test_low_similarities(spark):
    for percent in (5, 0, 101):
        with pytest.raises(ValueError):
            minhash.rows_per_band(percent)
    rows = family(6)
    assert found(spark, rows, 2, 50) == sorted(truth(rows, 2, 50), key=str)


def test_copies_with_null_keys(spark):
    rows = [(None, "a b c d")] * 50 + [(None, "a b c e"), (4, "a b c d")]
    assert found(spark, rows) == sorted(truth(rows, 2, 80), key=str)


def test_null_and_repeated_keys(spark):
    rows = [(None, "a b c"), (None, "a b c"), (7, "x y z"), (None, "x y z"), (7, "x y z"), (None, None), (7, None), (7, "other words here")]
    assert found(spark, rows) == sorted(truth(rows, 2, 80), key=str)
    assert found(spark, rows[:0]) == []


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(i, t) for i, t in family(4) if i is not None]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, kept string")
    out = minhash.deduplicate(df, 5)
    want = {i for i, _, c in truth(rows, 5, 80) if i == c}
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_deduplicate_decides_by_row_where_keys_repeat(spark):
    rows = [(3, "x y z"), (7, "x y z"), (7, "other words here"), (7, None), (8, "x y z"), (None, "x y z"), (9, "other  words here")]
    out = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, "x y z"), (7, "other words here"), (7, None), (None, "x y z")], key=str)


def test_a_very_long_text(spark):
    rng = random.Random(0)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-100])), (3, "w " * 60_000)]
    assert found(spark, rows, 5) == [(1, 59996, 1), (2, 59896, 1), (3, 1, 3)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300))
def test_band_keys_depend_on_the_set_alone(values):
    s = np.array(sorted(values), np.uint64)
    one, two = minhash.band_keys([s]), minhash.band_keys([s[:1], s])
    assert np.array_equal(one[0], two[1]) and len(set(one[0].tolist())) == 32


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 20, 100, 1000):
        hit = 0
        for _ in range(60):
            u = rng.permutation(np.unique(rng.integers(0, 2**64 - 1, n * 2, dtype=np.uint64)))
            a, b = np.sort(u[: int(0.9 * len(u))]), np.sort(u[int(0.1 * len(u)) :])
            hit += np.mean(minhash.band_keys([a])[0] == minhash.band_keys([b])[0])
        assert abs(hit / 60 - 0.8**4) < 0.12


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_connected_components(spark, edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for n in sorted(near):
        if n not in seen:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    want[x] = n
                    todo += near[x]
    df = spark.createDataFrame([*edges, (None, 1)], "a int, b int")
    assert {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()} == want


def test_a_long_chain_is_one_component(spark):
    rng = random.Random(2)
    names = rng.sample(range(1000), 200)
    df = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a int, b int")
    assert {r["root"] for r in connected_components(df, "a", "b").collect()} == {min(names)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([12, 50, 80, 95, 100]))
def test_linked_sets_share_one_of_their_rarest_shingles(seed, percent):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 60, 25)
    sets = [np.unique(np.where(rng.random(25) < rng.random() / 3, rng.integers(0, 60, 25), base)[: rng.integers(1, 25)]).astype(np.int64) for _ in range(12)]
    often = np.zeros(minhash.SLOTS, np.int64)
    np.add.at(often, np.concatenate(sets) % 7, 1)  # any order will do, also one of few different values
    first = minhash.prefixes(sets, often, percent)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = np.intersect1d(a, b).size
            if 100 * both >= percent * (a.size + b.size - both):
                assert np.intersect1d(first[i], first[j]).size


def test_texts_of_one_template_do_not_meet_in_pairs(spark, monkeypatch):
    """Texts that have 60% in common and no link: what is compared grows with them, not with their pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "SPLIT_BLOCKS", 2)
    compared, real = [], minhash._mixed

    def counted(some):
        mixed = real(some)
        compared.append(mixed.agg(F.coalesce(F.sum(F.col("n") * F.col("n_out")), F.lit(0))).first()[0])
        return mixed

    monkeypatch.setattr(minhash, "_mixed", counted)
    rng = random.Random(4)
    text = [f"t{i}" for i in range(80)]
    for n in (100, 400):
        docs = [(i, " ".join(f"u{rng.randrange(10**9)}" if j % 5 == 0 else w for j, w in enumerate(text))) for i in range(n)]
        docs += [(n + i, docs[i][1] + " end") for i in range(5)]  # links between texts of the template
        compared.clear()
        assert found(spark, docs) == sorted(((i, len(set(zip(t.split(), t.split()[1:]))), i - n if i >= n else i) for i, t in docs), key=str)
        assert compared[0] > n * n / 2 and compared[1] <= 40 * n


# Nearest neighbours -------------------------------------------------------------------------------------------


def exact(ids, x, q, k):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
    return sorted((float(d[i]), ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in entries.op10_neighbours(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    hits = total = 0
    for q in (i for i in ids if i % 100 == 0):
        want = exact(ids, x, q, 10)
        assert [r for _, _, r in got[q]] == list(range(1, 11)) and [g[:2] for g in got[q]] == sorted(g[:2] for g in got[q])
        d = {v: s for s, v in exact(ids, x, q, len(ids))}
        assert all(s == pytest.approx(d[v], abs=1e-12) for s, v, _ in got[q])
        hits += len({v for _, v in want} & {v for _, v, _ in got[q]})
        total += 10
    assert hits / total >= 0.9


def test_unusable_vectors_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 5)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, float(i % 3)]) for i in range(1, 31)]
    rows = [*good, good[0], (100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [None, 1.0]), (105, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    index = ann.build_index(df)
    assert sum(index.counts) == 31
    got = ann.search(index, df, k=4, mass=1.0).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == set(range(1, 31))
    ids, x = [i for i, _ in good], np.array([v for _, v in good])
    for q in range(1, 31):
        assert [(r["score"], r["vec_id"]) for r in got if r["query_id"] == q] == exact(ids, x, q, 4)


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in ann.search(ann.build_index(df), df).orderBy("query_id").collect()] == [(1, 2, 1.0), (2, 1, 1.0)]
    none = df.limit(0)
    assert ann.search(ann.build_index(none), none).count() == 0


def test_parts_are_balanced_and_keep_neighbours_together():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (100, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9))])
    graph = ann.neighbour_graph(x, 5)
    part = ann.balanced_partition(graph, x, 4, rng)
    assert np.bincount(part).max() <= 110 and (part[graph] == part[:, None]).mean() > 0.95
    router = ann.fit_router(x, 4)
    assert (router.probabilities(x).argmax(axis=1)[graph] == router.probabilities(x).argmax(axis=1)[:, None]).mean() > 0.95


def test_components_with_hot_nodes(spark, monkeypatch):
    from relslice.llm import components

    monkeypatch.setattr(components, "HOT", 3)
    edges = [(0, i) for i in range(1, 60)] + [(i, 1000 + i) for i in range(1, 30)] + [(5000, 5001), (None, 3), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: 0 for e in edges[:-3] for n in e} | {5000: 5000, 5001: 5000}


def clustered(spark, n, width, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    x = centres[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, width))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_recall_and_rows_read_on_clusters(spark):
    """With structure in the vectors, tuned searches find at least 0.9 of the neighbours in a small part of the rows."""
    x, df = clustered(spark, 4000, 16, 0.25)
    index = ann.build_index(df, seed=1)
    got = {}
    for r in ann.search(index, df.where("vec_id % 40 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found_ in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(found_ & set(np.argsort(d)[:10].tolist()))
    order, needed = ann.visited(index.router.probabilities(x[::40]), index.mass)
    read = np.mean([np.array(index.counts)[o[:n]].sum() for o, n in zip(order, needed, strict=True)]) / 4000
    print("recall", hit / 10 / len(got), "share of rows read", read)
    assert len(got) == 100 and hit / 10 / len(got) >= 0.9 and read < 0.3


def test_queries_in_small_parts_find_all_there_is(spark):
    """A few far clusters smaller than k, with repeated keys: other parts fill up the answers."""
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) * 0.01 + 100 * (i % 40)).tolist()) for i in range(320)] + [(0, [0.0, 0.0, 0.0, 1.0])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, seed=2)
    out = ann.search(index, df.where("vec_id < 80"), k=10, mass=0.1).groupBy("query_id").count().collect()
    assert len(out) == 80 and {r["count"] for r in out} == {10}
