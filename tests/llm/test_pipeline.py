import random
import re

import corpus_pipeline
from relslice.llm import entries, minhash
from relslice.scratch import materialize

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    """Each stage on what the one before has kept, checked against plain Python or its operator's own tests."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r for r in docs.collect()}
        assert all(before[i] == r for i, r in after.items())
        dropped = set(before) - set(after)
        if name == "quality classifier":
            assert all(labels[i]["quality"] == 0 for i in dropped & set(labels)) and not any(labels[i]["quality"] == 0 for i in set(after) & set(labels))
        elif name == "language ID":
            assert not dropped
        else:
            from tests.llm.test_near import truth

            want = {i for i, _, c in truth([(i, r["text"]) for i, r in before.items()], 5, 80) if i == c}
            assert set(after) == want
        before = after
    words = {i: len(r["text"].split()) for i, r in before.items()}
    mixed = materialize(corpus_pipeline.mixing_stage(spark, docs, SF), "stage")
    taken = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == docs.columns and max(map(taken.count, taken)) == 2
    assert abs(sum(words[i] for i in taken) - 1.5 * sum(words.values())) < 0.1 * sum(words.values())
    coded = corpus_pipeline.tokens_stage(spark, mixed, SF).collect()
    assert sorted(r["doc_id"] for r in coded) == sorted(taken) and all(r["round_trip"] and len(r["token_ids"]) == 4 * r["n_tokens"] for r in coded)


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "language_stage", "near_dedup_stage", "mixing_stage", "tokens_stage"]
    assert corpus_pipeline.ORACLE_SQL is None and entries.queries()["pipeline"] is corpus_pipeline.run


def test_clashing_columns_and_nulls_pass_through(spark):
    rows = [(i, f"The quick brown fox number {i} jumps over the lazy dog again and again.", "en", "s", 3, "own", 0.5, 9) for i in range(12)]
    rows += [(None, "A text without a key that stays as it is, of course.", None, None, None, None, None, None), (50, None, "en", "s", 0, "own", 0.5, 9), (51, "", None, "s", 0, "own", 0.5, 9), (52, "123 !!", "en", None, 0, "own", 0.5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, size long")
    docs = docs.withColumnRenamed("n_chars", "n.chars")
    kept = materialize(corpus_pipeline.language_stage(spark, docs, SF), "stage")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, *range(12)}
    assert {(r["lang_pred"], r["score"], r["size"]) for r in kept.collect()} == {("own", 0.5, 9), (None, None, None)}
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    assert minhash.deduplicate(docs).count() <= docs.count()


FOREIGN = {
    "ru": "Быстрая коричневая лиса прыгает через ленивую собаку, и никто не знает, почему это происходит каждый день.",
    "zh": "敏捷的棕色狐狸跳过懒狗没有人知道为什么每天都会发生这种事",
    "pl": "Szybki brązowy lis przeskakuje nad leniwym psem i nikt nie wie, dlaczego dzieje się to każdego dnia w tym mieście.",
    "fi": "Nopea ruskea kettu hyppää laiskan koiran yli eikä kukaan tiedä, miksi näin tapahtuu joka päivä tässä kaupungissa.",
}


def test_foreign_and_gibberish_texts_go_and_short_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(1)

    def gibberish(words):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(words))

    bad = [*FOREIGN.values(), *(f"{t} " * 200 for t in FOREIGN.values()), *(gibberish(n) for n in (5, 20, 60, 3000))]
    clean = ["Von.", "That it.", "Erinst resh.", "Osrañ.", "un", "The", "Pachque çaneux et.", "the and of", "der die und", "y", "Ö."]
    # One text in two of the corpus's languages, and words of clean documents by ones, twos and threes.
    by_lang = {r["lang"]: r["text"] for r in docs.where("n_chars between 1500 and 2500 and doc_id < 400").orderBy("doc_id").collect()}
    clean.append(by_lang["fr"] + " " + by_lang["en"])
    for text in by_lang.values():
        words = re.findall(r"[^\W\d_]+", text)[:60]
        clean += [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(0, 57, 4)]
    # The planted rows claim a language, as mislabelled rows of a corpus do.
    rows = [(10**6 + i, t, "en", "planted", len(t)) for i, t in enumerate([*bad, *clean])]
    planted = spark.createDataFrame(rows, docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.unionByName(planted), sf).select("doc_id").collect()}
    assert [t[:60] for i, t, *_ in rows[: len(bad)] if i in kept] == []
    assert [t for i, t, *_ in rows[len(bad) :] if i not in kept] == []
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= kept


def test_without_known_languages_lettered_texts_stay(spark):
    docs = spark.createDataFrame([(1, "Some words.", None), (2, "Привет", None), (3, "12 !?", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, SF).collect()) == [1, 2]
