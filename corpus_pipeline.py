"""A corpus pipeline: quality, language, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept; all but the last
return the columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice.llm import bpe, entries, langid, minhash, mixing, quality
from relslice.llm.arrowmap import shielded
from relslice.scratch import discard, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose probability of being better than poor is at least one half."""
    model = quality.fit(docs, entries.ratings(spark, sf_dir), seed=7)
    good = F.coalesce(F.get("grade_tails", F.lit(0)), F.lit(1.0)) >= entries.MIN_TAIL
    return shielded(docs, ["text"], lambda d: quality.grade(d, model).where(good))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with text in one of the corpus's languages."""
    model = langid.fit(docs, seed=6)
    return shielded(docs, ["text"], lambda d: langid.spoken(d, model).where("spoken"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingle sets are 80% alike."""
    return minhash.deduplicate(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the mix of sources does: weights 5, 2, 1 in turn, at most two epochs."""
    return shielded(docs, ["doc_id", "text", "source"], lambda d: mixing.repeated(mixing.mix(d, None, share=1.5, max_epochs=2, seed=4, by_rank=entries.weight_in_turn), d.columns))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token_ids (little-endian unsigned 32-bit), and whether decoding gives the text."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), entries.BYTE_BPE)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "source", "lang", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", tokens_stage),
]

#: SQL can't express trained classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)  # what a stage has read, nothing reads again
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
