"""Exact duplicates, Merkle manifests and vector codes against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relslice.llm import codes, entries, exactdedup, merkle

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# Exact duplicates ---------------------------------------------------------------------------------------------


def grouped(rows):
    """doc_id, keep_id, group_size, digest of every row, and the number of rows that stay by (text, keep_id)."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").encode().translate(LOWER)].append(key)
    out = []
    for low, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        out += [(k, best, len(keys), hashlib.sha256(low).hexdigest()) for k in keys]
    return sorted(out, key=str), len(groups)


def held(spark, rows, parts=3):
    got = exactdedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    want, groups = grouped(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    stay = [r for r in got if r["kept"]]
    assert len(stay) == groups and all(r["doc_id"] == r["keep_id"] for r in stay)


ROWS = [(i, t) for i, t in enumerate(["a", "A", "b", "É", "é", "", None, " ", "a ", "x" * 300_000, "X" * 300_000, "x" * 300_001, "Straße", "STRAßE"])]


def test_groups_equal_brute_force(spark):
    held(spark, ROWS + [(None, "a"), (None, "only null"), (3, "b"), (2, "b"), (2, "b")])
    held(spark, [(5, "same")] * 40, 4)
    assert exactdedup.exact_groups(spark.createDataFrame(ROWS[:1], "doc_id long, text string").limit(0)).count() == 0


def test_large_buckets_are_folded_and_split_again(spark, monkeypatch):
    """Tables of a few records: a text with many copies goes through several levels, and other texts of its bucket with it."""
    monkeypatch.setattr(exactdedup, "TABLE_BYTES", 900)
    monkeypatch.setattr(exactdedup, "TABLE_ROWS", 5)
    monkeypatch.setattr(exactdedup, "BUCKET_BYTES", 200)
    levels = []
    again = exactdedup._grouped
    monkeypatch.setattr(exactdedup, "_grouped", lambda records, key, level: (levels.append(level), again(records, key, level))[1])
    rows = [(i, "Hot " * 40 if i % 3 else f"text {i % 90}") for i in range(700)] + [(900 + i, "long" * 600) for i in range(5)]
    held(spark, rows, 6)
    assert max(levels) >= 2


def test_the_table_compares_contents_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(exactdedup, "hash", lambda text: len(text) % 3, raising=False)
    table, texts = exactdedup.OpenTable(), [f"{i % 50}".encode() for i in range(200)]
    assert [table.number(t) for t in texts] == [i % 50 for i in range(200)] and len(table.texts) == 50


def test_deduplicate_keeps_columns_and_one_row_of_repeats(spark):
    rows = [(1, "T", "p", 7), (2, "t", "q", 8), (2, "t", "q", 8), (None, None, None, None), (3, "", "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, record int")
    got = exactdedup.deduplicate(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [(2, "t", "q", 8), (3, "", "r", 1)]


# Merkle manifests ---------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(hashes):
    """All levels of a tree."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    steps = []
    for row in levels[:-1]:
        run = row[at // 3 * 3 : at // 3 * 3 + 3]
        steps.append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        at //= 3
    return steps


def postorder(levels):
    out = []

    def visit(level, at):
        if level:
            for j in range(3 * at, min(3 * at + 3, len(levels[level - 1]))):
                visit(level - 1, j)
        out.append((level, at))

    visit(len(levels) - 1, 0)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400))
def test_closed_form_positions_are_the_postorder(n):
    levels = tree([str(i) for i in range(n)])
    for pos, (level, at) in enumerate(postorder(levels)):
        assert merkle.positions(level, np.array([at]), n)[0] == pos
    assert merkle.height(n) == len(levels) - 1


def encoded(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_brute_force(spark, monkeypatch, height):
    """Builders of one, two and six levels, trees of 0 to 100 leaves, null groups, repeated and null keys."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = [(i, "hot" if i % 4 else f"s{i % 12}", f"t{i}") for i in range(130)] + [(500 + i, None, "n") for i in range(3)] + [(600, "", "e"), (7, "hot", "again"), (7, "hot", "again"), (None, "hot", "null"), (601, "lone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    leaves = docs.select("doc_id", "source", merkle.digest(F.col("doc_id"), F.col("text")).alias("leaf"))
    made = merkle.manifest(leaves, "source", ["doc_id"], "leaf", ["doc_id"])
    by = defaultdict(list)
    for key, source, text in rows:
        by[source].append((key is not None, key or 0, encoded(key, text), key))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([h for _, _, h, _ in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    want = []
    for k, s in enumerate(names):
        for i, (_, _, h, key) in enumerate(sorted(by[s])):
            want.append((key, h, tuple(path(trees[s], i) + path(top, k)), trees[s][-1][0], top[-1][0]))
    got = [(r["doc_id"], r["hash"], tuple(map(tuple, r["steps"])), r["subroot"], r["root"]) for r in made.proofs().collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for s in names:
        log = {r["pos"]: (r["level"], r["at"], r["hash"]) for r in made.groups.nodes().where(F.col("tree") == ("" if s is None else f"={s}")).collect()}
        assert [log[p] for p in range(len(log))] == [(lv, at, trees[s][lv][at]) for lv, at in postorder(trees[s])]
    hot = trees["hot"]
    assert merkle.read_proof(made.groups, "=hot", 10, len(hot[0])) == path(hot, 10)


def test_altered_leaves_fold_to_another_root(spark):
    leaves = spark.createDataFrame([(i, "s", sha(str(i))) for i in range(20)], "doc_id long, source string, leaf string")
    proofs = merkle.manifest(leaves, "source", ["doc_id"], "leaf", ["doc_id"]).proofs()
    told = proofs.select(merkle.folded(F.col("hash"), F.col("steps")).alias("same"), merkle.folded(F.sha2("hash", 256), F.col("steps")).alias("other"), "root").collect()
    assert len(told) == 20 and all(r["same"] == r["root"] != r["other"] for r in told)


def test_manifest_of_nothing(spark):
    leaves = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(leaves, "source", ["doc_id"], "leaf", ["doc_id"]).proofs().count() == 0


def test_op11_tampers_with_line_ends_of_half_the_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = entries.op11_merkle(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (docs[r["doc_id"]]["text"] or "")
        assert r["verified"] == (not changed)


# Vector codes -------------------------------------------------------------------------------------------------


def coded(rows, parts, entries_, rounds, scale=4096):
    """Codes, errors and codebooks by full searches; rows are (key, vector), all usable."""
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * scale)) for c in v] for _, v in rows], np.int64).reshape(len(rows), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], list(rows[i][1])))
    books = x[order[:entries_]].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        own, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[own[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    own, error = assign()
    return [bytes(o.astype(np.uint8)).hex() for o in own], error.tolist(), books


@pytest.mark.parametrize(("n", "spread", "entries_"), [(400, 8, 16), (300, 1, 16), (9, 4, 16), (120, 3, 2), (50, 2, 1)])
def test_codes_equal_full_searches(spark, monkeypatch, n, spread, entries_):
    """Clustered, coarse (many ties), few and repeated vectors, in several batches."""
    monkeypatch.setattr(codes, "ROWS", 64)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(spread, 16))
    rows = [(int(k), [float(np.float32(c)) for c in np.round(centres[rng.integers(spread)] + rng.normal(size=16) / 4, 1)]) for k in rng.permutation(n)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    made = codes.compress(df, parts=4, entries=entries_, rounds=6)
    code, error, books = coded(rows, 4, entries_, 6)
    got = sorted((r["vec_id"], r["code"], r["error"]) for r in made.rows.collect())
    assert got == sorted((k, c, e) for (k, _), c, e in zip(rows, code, error, strict=True)) and (made.codebooks == books).all()
    near = {r["vec_id"]: r["approximation"] for r in codes.decoded(made).collect()}
    for (k, _), c in zip(rows, code, strict=True):
        assert near[k] == pytest.approx(np.concatenate([books[p][b] for p, b in enumerate(bytes.fromhex(c))]) / 4096)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 6), st.integers(2, 9))
def test_bounds_give_the_nearest_entry_after_any_move(seed, b, k):
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-9, 9, (60, 3)), rng.integers(-9, 9, (k, 3))
    b = min(b, k - 1)
    state = codes.searched(x, books, b)
    for step in range(5):
        new = books + rng.integers(-2, 3, books.shape) * (rng.random((k, 1)) < 0.6)
        looked = codes.moved(x, new, np.sqrt(((new - books) ** 2).sum(axis=1).astype(float)), state)
        books = new
        d = codes.squared(x, books)
        assert (state.own == d.argmin(axis=1)).all() and (state.up >= np.sqrt(d.min(axis=1))).all()
        for i in range(len(x)):
            assert all(state.low[i, j] <= np.sqrt(d[i, e]) for j, e in enumerate(state.near[i]))
            others = set(range(k)) - {int(state.own[i]), *map(int, state.near[i])}
            assert all(state.out[i] <= np.sqrt(d[i, e]) for e in others) and (np.diff(state.low[i]) >= 0).all()
        assert looked.min() >= 0 and looked.max() <= state.near.shape[1] + 1
        if step == 2:
            state = codes.shortened(state, max(0, b - 1))


def test_close_entries_shrink_to_what_was_needed():
    assert codes.needed({0: 995, 1: 5}, 4, 16) == 2 and codes.needed({0: 900, 3: 100}, 4, 16) == 3
    assert codes.needed({0: 900, 5: 100}, 4, 16) == 4 and codes.needed({}, 4, 16) == 4


def test_unusable_vectors_clashing_columns_and_errors(spark):
    inf = float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [None, 1.0], "c"), (4, [inf, 1.0], "d"), (5, [float("nan"), 0.0], "e"), (6, [0.0, 0.0], None), (None, [1.0, -2.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({"code": F.lit("x"), "tally": F.lit(1), "error": F.lit(0)})
    made = codes.compress(df, parts=2, entries=16, rounds=2, carry=["label"])
    told = codes.with_label_error(made.rows)
    assert sorted((r["vec_id"] or 0, r["label"], r["code"], r["error"], r["label_error"]) for r in told.collect()) == [(0, None, "0002", 0, 0), (1, "a", "0000", 0, 0), (6, None, "0101", 0, 0)]
    none = codes.compress(df.limit(0), parts=2, carry=["label"])
    assert none.rows.count() == 0 and none.codebooks_sha256() == hashlib.sha256(b"").hexdigest() and codes.with_label_error(none.rows).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(df, parts=3)
    with pytest.raises(Exception, match="components"):
        codes.compress(spark.createDataFrame([(i, [1.0] * (2 + 2 * (i == 99))) for i in range(100)], "vec_id long, embedding array<float>"), parts=2, entries=4).rows.count()
    with pytest.raises(ValueError, match="can't be coded"):
        codes.compress(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<float>"), parts=2)


def test_label_errors_with_a_hot_label(spark):
    rows = [(i, "hot" if i % 2 else f"l{i % 700}", i) for i in range(3000)] + [(1, None, 4), (2, None, 5)]
    out = codes.with_label_error(spark.createDataFrame(rows, "vec_id long, label string, error long")).collect()
    want = defaultdict(int)
    for _, label, e in rows:
        want[label] += e
    assert len(out) == len(rows) and all(r["label_error"] == want[r["label"]] for r in out)
