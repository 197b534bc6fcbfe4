"""The queries of this subpackage: one opN_<name> per operator, and the corpus pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice.llm import ann, bpe, codes, exactdedup, langid, media, merkle, minhash, mixing, quality, sharding, toxicity, wordpiece
from relslice.scratch import materialize

#: The vocabulary of ``op2_bpe``; any byte-level BPE file of the tokenizers library will do.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of toxicity; labels are learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), seed=1)
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("token_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 24 shards under the law "rows"."""
    dealt = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24, seed=17)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select(
        "doc_id",
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def weight_in_turn(rank: Column) -> Column:
    """Weights 5, 2, 1, repeating, by a source's place."""
    return F.element_at(F.array(*[F.lit(w) for w in (5, 2, 1)]), (rank % 3 + 1).cast("int"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of 150% of all words takes, with weights 5, 2, 1 by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, None, share=1.5, max_epochs=2, seed=0, columns=["doc_id"], by_rank=weight_in_turn)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h, text
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS fill,
         (SELECT 1.5::DOUBLE * sum(source_size) FROM w)
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         (SELECT sum(weight) FROM w)
           - coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM w),
f AS (SELECT fill, rest, rest_weight FROM o WHERE weight * rest / rest_weight <= cap ORDER BY fill LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         (CASE WHEN o.fill < f.fill THEN o.cap ELSE o.weight * f.rest / f.rest_weight END)::DOUBLE AS target
  FROM o, f),
p AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE least(floor(t.target / t.source_size), 2) END::BIGINT AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size, d.text ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto - size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document over a byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, BYTE_BPE).select("doc_id", "n_words", "n_tokens", "n_unknown")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, seed=6)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings from the labels: 0 poor, 1 good but toxic, 2 good."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("rating"))


#: A document is selected if its probability of grade 1 or better is at least this.
MIN_TAIL = 0.5


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probabilities and selection."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, ratings(spark, sf_dir), seed=7)
    graded = quality.grade(docs, model)
    # The ratings have three grades at most; a tail of a grade that no training row has is null.
    tails = [F.get("grade_tails", F.lit(j)).alias(f"p_grade_{j + 1}") for j in range(2)]
    return graded.select("doc_id", "expected_grade", *tails, (F.coalesce(F.get("grade_tails", F.lit(0)), F.lit(1.0)) >= MIN_TAIL).alias("selected"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are 80% alike."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 1, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.both >= 80 * (x.n + y.n - c.both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id
GROUP BY w.doc_id
"""


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as lossless motion-JPEG in AVI, read back, with digests and its shots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.store(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text")
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    back = media.read(stored).drop("media")
    cuts = F.transform("clips", lambda c: F.concat_ws(":", c["start_s"].cast("decimal(12,2)"), F.round(c["brightness"], 3)))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat(F.lit("shots="), F.size("clips"), F.lit(";"), F.array_join(cuts, ",")).alias("feature"),
    )


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of every stored text."""
    stored = media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.clips(stored, ["doc_id"]).select("doc_id", "clip", "first_frame", "frames", "start_s", "end_s")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found for every embedding whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann.build_index(rows, seed=10)
    return ann.search(index, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents by source, each one's proof, and the root that follows from a tampered copy of it."""
    docs = table(spark, sf_dir, "documents")
    leaf = merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    without = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], without)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed).otherwise(leaf)
    rows = materialize(docs.select("doc_id", "source", leaf.alias("leaf"), tampered.alias("tampered")), "leaves")
    proofs = merkle.manifest(rows, "source", ["doc_id"], "leaf", ["doc_id", "tampered"]).proofs()
    told = proofs.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), merkle.folded(F.col("tampered"), F.col("steps")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


# CRC-32 of a decimal number's digits, byte by byte over a table made by its polynomial.
OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
k AS (
  SELECT doc_id, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda x, y: xor(x >> 8, t[xor(x, y) % 256 + 1])) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), c),
e AS (
  SELECT d.doc_id, source, text, k.crc, coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, replace(text, chr(10), '') AS cut
  FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed
  FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
a AS (
  SELECT source, 0 AS level, i, leaf AS h, n FROM l
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM a WHERE n > 1 GROUP BY source, level, i // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (
  SELECT 0 AS level, i, subroot AS h, n FROM s
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM b WHERE n > 1 GROUP BY level, i // 3),
r AS (SELECT h AS root FROM b WHERE n = 1),
sa AS (
  SELECT x.source, x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS pre, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS post
  FROM a x JOIN a y ON x.source IS NOT DISTINCT FROM y.source AND x.level = y.level AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY ALL),
sb AS (
  SELECT x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS pre, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS post
  FROM b x JOIN b y ON x.level = y.level AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY ALL),
fa AS (
  SELECT doc_id, source, leaf, 0 AS level, i, i AS first, n, changed AS h, '' AS proof FROM l
  UNION ALL
  SELECT fa.doc_id, fa.source, leaf, fa.level + 1, fa.i // 3, first, (n + 2) // 3, sha256(pre || h || post), proof || pre || post
  FROM fa JOIN sa ON sa.source IS NOT DISTINCT FROM fa.source AND sa.level = fa.level AND sa.i = fa.i WHERE n > 1),
fb AS (
  SELECT fa.doc_id, leaf, s.subroot, 0 AS level, s.i, s.n, fa.h, proof FROM fa JOIN s ON s.source IS NOT DISTINCT FROM fa.source WHERE fa.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, fb.level + 1, fb.i // 3, (n + 2) // 3, sha256(pre || h || post), proof || pre || post
  FROM fb JOIN sb ON sb.level = fb.level AND sb.i = fb.i WHERE n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM fb, r WHERE n = 1
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings over 8 codebooks of 16 entries, with their errors and those of their labels."""
    made = codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, carry=["label"])
    return codes.with_label_error(made.rows).select("vec_id", "code", "error", "label_error", F.lit(made.codebooks_sha256()).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 6) -> str:
    """Rounds of full searches, one after the other."""
    steps = [
        """WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q, len(embedding) // 8 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, list_slice(q, part * w + 1, part * w + w) AS x FROM v, (SELECT unnest(range(8)) AS part)),
b0 AS (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= 16)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT p.r, p.part, any_value(p.x) AS x, min({{'d': list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': b.entry}}) AS best
  FROM p JOIN b{i} b ON b.part = p.part GROUP BY p.r, p.part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e
  FROM (SELECT part, best.entry AS entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT max(w) FROM v) + 1)) AS j) GROUP BY ALL)
  GROUP BY part, entry),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)""")
    return ",\n".join(steps) + f"""
SELECT v.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY v.label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN (
  SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r) c ON c.r = v.r
"""


OP12_SQL = _op12_sql()


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document's text, and whether the document stays."""
    return exactdedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
g AS (SELECT doc_id, low, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(low) AS text_sha256 FROM g
"""


def queries() -> dict:
    import corpus_pipeline  # here, because the pipeline imports this module

    return {
        "pipeline": corpus_pipeline.run,
        "op1_toxicity": op1_toxicity,
        "op2_bpe": op2_bpe,
        "op3_external_shuffle": op3_external_shuffle,
        "op4_mixing": op4_mixing,
        "op5_token_counts": op5_token_counts,
        "op6_language": op6_language,
        "op7_quality": op7_quality,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_media": op9_media,
        "media_clips": media_clips,
        "op10_neighbours": op10_neighbours,
        "op11_merkle": op11_merkle,
        "op12_vector_codes": op12_vector_codes,
        "op13_exact_duplicates": op13_exact_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op8_near_duplicates": OP8_SQL, "op11_merkle": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_exact_duplicates": OP13_SQL}
