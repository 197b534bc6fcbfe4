import hashlib
import re
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from relslice.llm import bpe, entries, wordpiece
from relslice.llm.textcore import runs, shingles, space_words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b \n\n c", "a b 　c", "<|endoftext|>hi <|endoftext|> there<|endoftext|>", "don't we'll 'S x's  ", "a" * 3000, " " * 3000 + "x", "\n \n x \t\ty",
    "日本語テキスト です。", "😀😀 👨‍👩‍👧", "\x1c a\x1d b\x85c   d", "====" * 50, "1234 5678, ½ ⅷ ٣٤", "ẞß Ａ ｡ ​ x‍ y", "﻿ a", "a \x0b b", "_ _a __ -- ́x é", "aaa aaaaa aaaaaaa",
]
texts = st.text(st.one_of(st.sampled_from("abt eh\n\t'.,s!09éß 日"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def packed(reference, text):
    ids = reference.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_the_library_on_odd_texts(reference, text):
    codec = bpe.BytePairCodec.load(PATH)
    assert codec.encode_batch([text]) == [packed(reference, text)]
    assert codec.decode(packed(reference, text)).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=5))
def test_bpe_equals_the_library(reference, some):
    codec = bpe.BytePairCodec.load(PATH)
    coded = codec.encode_batch(some)
    assert coded == [packed(reference, t) for t in some]
    assert [codec.decode(c).decode() for c in coded] == some


def test_bpe_on_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH), PATH).toPandas()
    assert all(bytes(i) == packed(reference, t) and d == t for t, i, d in zip(out["text"], out["token_ids"], out["decoded"], strict=True))


def test_bpe_keeps_other_columns_and_handles_nulls(spark):
    docs = spark.createDataFrame([(1, None, b"old"), (1, "", b"old"), (None, "hi hi", None)], "doc_id long, text string, token_ids binary")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert sorted((r["decoded"], len(r["token_ids"])) for r in out.collect()) == [("", 0), ("", 0), ("hi hi", 8)]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_bpe_decodes_any_ids():
    codec = bpe.BytePairCodec.load(PATH)
    assert codec.decode(struct.pack("<3I", 50256, 10**6, 0)) == b"<|endoftext|>!"
    assert codec.decode(struct.pack("<I", codec.encode_batch(["é"]) and 127)).decode() is not None


def test_op2_equals_the_library(spark, reference, tmp_path):
    """The query's own path over sf0.01 and odd texts: counts and both digests."""
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate([*ODD, None], 1)], whole.schema)
    whole.unionByName(odd).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    out = entries.op2_bpe(spark, str(tmp_path)).collect()
    assert len(out) == len(docs)
    for r in out:
        text = docs[r["doc_id"]]
        ids = packed(reference, text)
        back = reference.decode(list(struct.unpack(f"<{len(ids) // 4}I", ids)), skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize("word", ["a" * 1_000_000, "".join(chr(0x4E00 + i * i % 20_000) for i in range(200_000))])
def test_bpe_is_linear_in_unbroken_words(reference, word):
    codec = bpe.BytePairCodec.load(PATH)
    codec.encode_batch(["a"])
    tracemalloc.start()
    coded = codec.encode_batch([word, f"x {word}"])
    assert [codec.decode(c).decode() for c in coded] == [word, f"x {word}"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert coded == [packed(reference, word), packed(reference, f"x {word}")]
    assert word not in codec.plain.now and word not in codec.spaced.now


def test_bpe_tables_stay_within_their_bytes(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 16)
    codec = bpe.BytePairCodec(PATH)
    some = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(20)]
    assert [codec.encode_batch([t])[0] for t in some] == [packed(reference, t) for t in some]
    assert all(t.size < 4 * bpe.CACHE_BYTES and len(t.before) < 700 for t in (codec.plain, codec.spaced, codec.words))


def greedy(word, initial, continuing):
    """Longest match without an automaton; 0 if stuck."""
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (continuing if at else initial)), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


pieces = st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces, st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_piece_counts_equal_greedy_matching(initial, continuing, word):
    assert wordpiece.PieceCounter(initial, continuing).count(word) == greedy(word, initial, continuing)


def test_piece_counts_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, " \x0b\n"), (-3, "é 日 x" + "y" * 5000)], "doc_id long, text string"))
    initial, continuing = map(set, wordpiece.byte_level_pieces(PATH))
    for r in wordpiece.token_counts(docs, PATH).collect():
        found = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())
        assert (r["n_words"], r["n_unknown"]) == (len(found), 0)
        if len(r["text"] or "") < 3000:
            assert r["n_tokens"] == sum(greedy(b" " + w, initial, continuing) for w in found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aB \t\n\x0b é", max_size=25), max_size=6), st.integers(1, 5), st.integers(1, 40))
def test_shingles_equal_brute_force(some, k, limit):
    seen, found = {}, []
    for _, b, offsets in runs(pa.array(some, pa.string()), limit):
        text, h = space_words(b, offsets)
        ends, made = shingles(text, h, offsets.size - 1, k)
        found += [made[a:e].tolist() for a, e in zip(ends, ends[1:], strict=False)]
    assert len(found) == len(some)
    for t, got in zip(some, found, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        want = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []
        assert len(got) == len(want)
        for h, w in zip(got, want, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_runs_cover_sliced_columns_with_nulls():
    a = pa.array(["x", None, "yy", "", "zzz"]).slice(1, 4)
    got = [(row, b[offsets[i] : offsets[i + 1]].tobytes()) for row, b, offsets in runs(a, 2) for i in range(offsets.size - 1)]
    assert [g[1] for g in got] == [b"", b"yy", b"", b"zzz"]
    assert not list(runs(pa.array([], pa.string())))
    assert np.all(next(iter(runs(pa.array([None, None], pa.string()))))[2] == 0)
