"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts and unlabelled texts, which may be toxic or not. With
the class prior p of toxic text, the risk of calling unlabelled text toxic is that of the unlabelled sample less
p times that of the toxic sample; where this estimate of the clean texts' risk falls below zero the classifier
has begun to memorise, and the step is taken back instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relslice.llm.arrowmap import add_columns, column
from relslice.llm.textcore import distinct, mix, runs, words

#: Hash buckets of the text features.
BUCKETS = 1 << 20

#: Training texts at most of each kind: confirmed toxic, and unlabelled.
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000

#: Bytes that words are made of: ASCII letters, and all of other scripts.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(b: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = (4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each word and of each word's first bytes, repeats included."""
    if not b.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = _LETTER[b]
    starts, text, h = words(b, offsets, solid)
    found, owner = [h], [text]
    for n in stems:
        # Hash the first n bytes of words with more than n bytes.
        at = starts[starts + n < b.size]
        inside = np.ones(at.size, bool)
        for j in range(1, n + 1):
            inside &= solid[at + j]
        at = at[inside]
        g = np.full(at.size, n, np.uint64)
        for j in range(n):
            g = mix(g + b[at + j])
        found.append(g)
        owner.append(text[: starts.size][starts + n < b.size][inside])
    return np.concatenate(owner), (np.concatenate(found) >> np.uint64(44)).astype(np.int64)


def presence(texts: pa.Array, stems: tuple[int, ...] = (4, 5), only: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct feature buckets of each text; of those in the boolean table ``only``, if given."""
    out: list[np.ndarray] = []
    for _, b, offsets in runs(pc.utf8_lower(texts)):
        owner, bucket = features(b, offsets, stems)
        if only is not None:
            keep = only[bucket]
            owner, bucket = owner[keep], bucket[keep]
        # One sort by text and bucket.
        joint = distinct((owner.astype(np.uint64) << np.uint64(20)) | bucket.astype(np.uint64))
        ends = np.searchsorted(joint, np.arange(1, offsets.size, dtype=np.uint64) << np.uint64(20))
        flat = (joint & np.uint64(BUCKETS - 1)).astype(np.int32)
        out += np.split(flat, ends[:-1]) if ends.size else []
    return out


@dataclass
class ToxicityModel:
    """Weights by bucket of a linear classifier on word presence."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of toxicity of each text; null and empty texts get the bias alone."""
        only = np.zeros(BUCKETS, bool)
        only[self.buckets] = True
        dense = np.zeros(BUCKETS)
        dense[self.buckets] = self.weights
        z = np.array([dense[x].sum() for x in presence(texts, only=only)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, keep: int = 4096, steps: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> ToxicityModel:
    """Train by full-batch Adam steps on the non-negative risk with logistic loss.

    Only the ``keep`` buckets are used that toxic texts have most clearly more often, by the z-score of the
    difference of shares, and by 3 standard errors at least. Deterministic for the same samples in the same order.
    Without toxic texts, or without unlabelled ones, every text gets the prior.
    """
    base = math.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), base)
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate(positive), minlength=BUCKETS)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=BUCKETS)
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    z[in_p + in_u < 3] = 0
    chosen = np.argsort(-z, kind="stable")[:keep]
    chosen = np.sort(chosen[z[chosen] >= 3])
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(chosen.size)

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [place[r] for r in rows]
        kept = [k[k >= 0] for k in kept]
        return np.repeat(np.arange(len(rows)), [k.size for k in kept]), np.concatenate(kept)

    (pr, pcol), (ur, ucol) = matrix(positive), matrix(unlabelled)
    w, bias = np.zeros(chosen.size + 1), base
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)

    def slope(rows: np.ndarray, cols: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, by_row[rows], chosen.size), by_row.sum())

    for t in range(1, steps + 1):
        f_p = np.bincount(pr, w[pcol], n_p) + w[-1]
        f_u = np.bincount(ur, w[ucol], n_u) + w[-1]
        s_p, s_u = 1 / (1 + np.exp(-f_p)), 1 / (1 + np.exp(-f_u))
        clean_risk = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        # Gradients of the clean texts' risk, and of p times the toxic texts' risk.
        clean = slope(ur, ucol, s_u / n_u) - slope(pr, pcol, prior * s_p / n_p)
        toxic = slope(pr, pcol, prior * (s_p - 1) / n_p)
        grad = (toxic + clean if clean_risk >= 0 else -clean) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    used = np.abs(w[:-1]) > 1e-6
    return ToxicityModel(chosen[used], w[:-1][used], float(w[-1]))


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves 1 modulo 3; such rows are never trained on. False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(key: str, share: float | Column, seed: int) -> Column:
    """A seeded choice of about ``share`` of all keys, never of null; ``share`` may be a column of shares up to 1."""
    bound = (share * (1 << 30)).cast("long") if isinstance(share, Column) else int(min(1.0, share) * (1 << 30))
    return F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < bound)


def fit(
    docs: DataFrame, labels: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", label: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> ToxicityModel:
    """Train on rows of ``docs`` whose key is not held out.

    Confirmed toxic texts are those with ``label`` 1 in ``labels`` (the largest, where a key repeats); the
    unlabelled sample is drawn from all training rows, labelled or not, and its labels aren't looked at. At most
    ``max_positive`` and ``max_unlabelled`` texts, drawn by seeded hashes of the key, reach the driver, as
    feature buckets: which ones depends on keys and texts alone, also where keys repeat, so reruns agree. The class
    prior is the share of 1 among the labelled training keys. Null keys and labels take no part in training.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("__label"))
    seen = known.agg(F.count("*").alias("n"), F.sum((F.col("__label") == 1).cast("long")).alias("toxic")).first()
    toxic = seen["toxic"] or 0
    prior = min(0.5, max(0.001, toxic / seen["n"])) if seen["n"] else 0.1
    rows = docs.where(~held_out(key) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    n = rows.count()
    confirmed = known.where((F.col("__label") == 1) & sampled("__key", 0.95 * max_positive / max(toxic, 1), seed)).select(F.col("__key").alias("__toxic")).orderBy("__toxic").limit(max_positive)
    drawn = rows.join(F.broadcast(confirmed), F.col("__key") == F.col("__toxic"), "left").withColumn("__drawn", F.coalesce(sampled("__key", 0.95 * max_unlabelled / max(n, 1), seed + 1), F.lit(False)))
    drawn = drawn.where(F.col("__toxic").isNotNull() | F.col("__drawn")).withColumn("__toxic", F.col("__toxic").isNotNull())
    drawn = drawn.withColumn("__digest", F.xxhash64("__key", "__text"))
    drawn = add_columns(drawn, "__buckets array<int>", lambda b: [pa.array(presence(column(b, "__text")), pa.list_(pa.int32()))], drop=("__text",))
    # A key that repeats stands for all its rows, each with its own text; where these are too many, a fixed choice of them stays.
    table = drawn.orderBy("__digest", "__key").limit(2 * (max_positive + max_unlabelled)).toArrow()
    buckets = [np.asarray(x, np.int64) for x in _lists(table["__buckets"])]
    is_toxic, is_drawn = table["__toxic"].to_pylist(), table["__drawn"].to_pylist()
    return fit_nnpu([x for x, t in zip(buckets, is_toxic, strict=True) if t], [x for x, u in zip(buckets, is_drawn, strict=True) if u], prior)


def _lists(rows: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for part in rows.chunks:
        flat, ends = np.asarray(part.values), np.asarray(part.offsets)
        out += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of each whole text; null and empty texts get the score of no words.

    Repeated texts score alike. A clashing column is replaced.
    """
    return add_columns(docs, f"{out} double", lambda b: [pa.array(model.scores(column(b, text)), pa.float64())])
