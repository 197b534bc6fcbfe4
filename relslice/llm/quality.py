"""Quality classification by ordinal cumulative-link regression on graded ratings.

All grades share one vector of weights over hashed text features; a grade above j has the probability
sigmoid(w.x - threshold_j) with ordered thresholds. The classifier gives each text its expected grade and the
probability of each tail (grade j or better), by which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relslice.llm.arrowmap import add_columns, column
from relslice.llm.textcore import IS_SPACE, LOWER, mix, runs, window_hashes, words

#: Hash buckets of the text features.
BUCKETS = 1 << 14

#: Rated texts that training draws at most.
MAX_RATED = 8_000

#: Each byte's kind: capital, small letter or part of a longer UTF-8 character, digit, and all others themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48


def features(b: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text: square roots of the shares of what it has of each bucket.

    Hashed are the runs of one to four character kinds, and for each word its length (in powers of two) together
    with whether it repeats the word before it or the word before that.
    """
    kind, solid = _KIND[b], ~IS_SPACE[b]
    grams = [(window_hashes(kind, n) >> np.uint64(50)).astype(np.int32) for n in range(1, 5)]
    starts, text, h = words(LOWER[b], offsets, solid) if b.size else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    again = np.zeros(h.size, np.uint64)
    again[1:] += (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    again[2:] += ((h[2:] == h[:-2]) & (text[2:] == text[:-2])).astype(np.uint64) << np.uint64(1)
    length = np.diff(np.append(starts, b.size)) if starts.size else np.zeros(0, np.int64)
    tokens = (mix((np.log2(np.maximum(length, 1)).astype(np.uint64) << np.uint64(2)) + again + np.uint64(1 << 20)) >> np.uint64(50)).astype(np.int32)
    ends = np.searchsorted(text, np.arange(offsets.size))
    out = []
    for i in range(offsets.size - 1):
        a, e = offsets[i], offsets[i + 1]
        parts = [g[a : max(a, e - n)] for n, g in enumerate(grams)]
        count = np.bincount(np.concatenate([*parts, tokens[ends[i] : ends[i + 1]], tokens[ends[i] : ends[i + 1]]]), minlength=BUCKETS)
        at = np.flatnonzero(count)
        out.append((at.astype(np.int32), np.sqrt(count[at] / max(1, count[at].sum())).astype(np.float32)))
    return out


def text_features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    return [x for _, b, offsets in runs(texts) for x in features(b, offsets)]


@dataclass
class OrdinalModel:
    """Weights by bucket and increasing thresholds, one for each grade above the lowest; ``grades`` are increasing."""

    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade j or better) for each text (rows) and each grade above the lowest (columns)."""
        z = np.array([self.weights[at] @ value for at, value in text_features(texts)])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -30, 30)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], ratings: list[float], steps: int = 150, rate: float = 0.3, ridge: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood with a ridge on the weights, by full-batch Adam steps. Deterministic.

    The grades are the distinct ratings. With one grade only every text has it, with none every text has grade 0.
    """
    grades = sorted(set(ratings))
    k, n = len(grades) - 1, len(rows)
    if k < 1:
        return OrdinalModel(grades or [0.0], np.zeros(BUCKETS), np.zeros(0))
    y = np.array([grades.index(r) for r in ratings])
    above = y[:, None] > np.arange(k)  # whether the grade is above each threshold
    rated = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    first = np.log((1 - rated) / rated)
    owner = np.repeat(np.arange(n), [a.size for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    # Thresholds are the first one and the logarithms of the gaps, so they stay ordered.
    p = np.concatenate([np.zeros(BUCKETS), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gaps = p[:BUCKETS], np.exp(p[BUCKETS + 1 :])
        theta = p[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(owner, w[at] * value, n)
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30)))
        wide = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
        prob = np.maximum(wide[np.arange(n), y] - wide[np.arange(n), y + 1], 1e-9)
        slope = tail * (1 - tail)
        # d(-log prob)/d tail_j is -1 / prob for the tail that the grade starts at, 1 / prob for the next.
        signs = np.where(y[:, None] == np.arange(1, k + 1), -1.0, 0.0) + np.where(y[:, None] == np.arange(k), 1.0, 0.0)
        d = signs * slope / prob[:, None] / n
        by_theta = -d.sum(axis=0)
        tails_from = np.cumsum(by_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(at, d.sum(axis=1)[owner] * value, BUCKETS) + ridge * w, tails_from[:1], tails_from[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = p[BUCKETS] + np.concatenate([[0], np.cumsum(np.exp(p[BUCKETS + 1 :]))])
    return OrdinalModel(grades, p[:BUCKETS], theta)


def fit(docs: DataFrame, ratings: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", rating: str = "rating", max_rated: int = MAX_RATED) -> OrdinalModel:
    """Train on the rated rows of ``docs``; of these at most ``max_rated``, drawn by seeded hashes of the key.

    Null keys and ratings take no part; where a key repeats in ``ratings`` its lowest rating holds. Where one repeats
    in ``docs`` each row counts, up to ``max_rated`` rows in a fixed order of keys and texts, so reruns agree. The
    driver gets the drawn texts' features only.
    """
    known = ratings.where(F.col(key).isNotNull() & F.col(rating).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.col(rating).cast("double")).alias("__rating"))
    n = known.count()
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col("__key")), F.lit(1 << 30)) < int(min(1.0, 0.95 * max_rated / max(n, 1)) * (1 << 30))
    drawn = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(known.where(chosen).orderBy("__key").limit(max_rated)), "__key")
    drawn = drawn.withColumn("__digest", F.xxhash64("__key", "__text"))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = text_features(column(batch, "__text"))
        return [pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))]

    table = add_columns(drawn, "__at array<int>, __value array<float>", make, drop=("__text",)).orderBy("__digest", "__key").limit(max_rated).toArrow()
    rows = [(np.asarray(a.values), np.asarray(v.values)) for a, v in zip(table["__at"], table["__value"], strict=True)]
    return fit_ordinal(rows, table["__rating"].to_pylist())


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and grade_tails (P(grade j or better) for each grade above the lowest).

    Null and empty texts have no features: their tails come from the thresholds alone. Equal texts get equal
    grades. Clashing columns are replaced.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        tails = model.tails(column(batch, text))
        steps = np.diff(np.asarray(model.grades, float))
        return [pa.array(model.grades[0] + tails @ steps, pa.float64()), pa.array(list(tails), pa.list_(pa.float64()))]

    return add_columns(docs, "expected_grade double, grade_tails array<double>", make)
