"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams (n from 1 to 3) that both
have, over the geometric mean of the numbers that each has. Kernel ridge regression, one language against the
rest, is fitted in the space that the Nystroem method spans by a few landmark texts. A batch of texts is scored
by two matrix products: n-gram presence times landmark presence, and the kernel rows times the coefficients.

Scores only compare languages with one another: those of any text add up to the same number. Whether a text is in
one of them at all is told by the share of its trigrams, repeats counted, that the training texts of a language know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relslice.llm.arrowmap import add_columns, column
from relslice.llm.mixing import water_fill
from relslice.llm.textcore import distinct, runs, window_hashes
from relslice.llm.toxicity import held_out, sampled

#: Bits of an n-gram's hash.
BITS = 22

#: Labelled texts that training draws at most, and landmarks among them.
MAX_LABELLED, MAX_LANDMARKS = 3_000, 128

#: Rows that a language is trained on at least, if it has them.
LEAST_LABELLED = 20

#: A trigram is known to a language if at least this share of its training texts, and two of them, have it.
KNOWN_IN = 0.01

#: A text is foreign if a language knows less than this part of what it knows of its own texts' trigrams, less
#: DEVIATIONS standard deviations of such a share. A character is in three trigrams, so a third of them count.
MIN_KNOWN, DEVIATIONS = 0.65, 1.25

#: Known trigrams from which a language's bound holds in full; below it falls with their number.
FULL_KNOWN = 1000

#: Texts scored by one matrix product.
BATCH = 128

#: The answer for null texts and texts without a letter.
UNDETERMINED = "und"

_ASCII_LETTER = np.zeros(128, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def occurrences(texts: pa.Array, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[list[np.ndarray]]:
    """The n-gram hashes of each whole text in turn, by order, repeats included.

    Texts are lower-cased; ASCII characters but letters count as spaces, runs of these as one.
    """
    for _, b, offsets in runs(pc.utf8_lower(texts)):
        points = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
        begins = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[offsets]
        plain = points < 128
        plain[plain] = ~_ASCII_LETTER[points[plain]]
        points[plain] = 32
        again = plain.copy()
        again[1:] &= plain[:-1]
        again[:1] = False
        again[begins[:-1][begins[:-1] < points.size]] = False
        kept = np.concatenate([[0], np.cumsum(~again)])
        points, begins = points[~again], kept[begins]
        grams = [(window_hashes(points, n) >> np.uint64(64 - BITS)).astype(np.int32) for n in orders]
        for a, e in zip(begins, begins[1:], strict=False):
            yield [g[a : max(a, e - n + 1)] for n, g in zip(orders, grams, strict=True)]


def ngrams(texts: pa.Array, orders: tuple[int, ...] = (1, 2, 3)) -> list[np.ndarray]:
    """The distinct n-gram hashes of each whole text."""
    return [distinct(np.concatenate(found)) for found in occurrences(texts, orders)]


@dataclass
class LanguageModel:
    """Landmark presence (n-grams x landmarks), landmark sizes, and coefficients (landmarks x languages) with offsets."""

    languages: list[str]
    columns: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    coefficients: np.ndarray
    offsets: np.ndarray
    vocabulary: Vocabulary | None = None

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel of each n-gram set with each landmark."""
        if not hasattr(self, "_place"):
            self._place = np.full(1 << BITS, -1, np.int32)
            self._place[self.columns] = np.arange(self.columns.size)
        out = np.zeros((len(sets), self.sizes.size), np.float32)
        for at in range(0, len(sets), BATCH):
            some = sets[at : at + BATCH]
            has = np.zeros((len(some), self.columns.size), np.float32)
            for i, s in enumerate(some):
                place = self._place[s]
                has[i, place[place >= 0]] = 1
            size = np.sqrt(np.maximum(1, [s.size for s in some]))
            out[at : at + BATCH] = has @ self.presence / size[:, None] / np.sqrt(np.maximum(1, self.sizes))
        return out

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest scores from 0 to 1 (texts x languages)."""
        return np.clip((self.kernel(sets).astype(np.float64) @ self.coefficients + self.offsets + 1) / 2, 0, 1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_place"}


@dataclass
class Vocabulary:
    """Trigrams, which language knows which (trigrams x languages), and the share of known ones usual in its own texts."""

    trigrams: np.ndarray
    known: np.ndarray
    usual: np.ndarray

    def shares(self, found: np.ndarray) -> np.ndarray:
        """The share of a text's trigrams, repeats counted, that each language knows."""
        if not hasattr(self, "_place"):
            self._place = np.full(1 << BITS, self.trigrams.size, np.int32)
            self._place[self.trigrams] = np.arange(self.trigrams.size)
            self._knows = self.known.astype(np.float64)
        times = np.bincount(self._place[found], minlength=self.trigrams.size + 1)[:-1]
        return times @ self._knows / max(1, found.size)

    def foreign(self, shares: np.ndarray, sizes: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether no language knows enough of each text, from its shares, number of trigrams and best-scoring language.

        A language of which few trigrams are known asks for less, but only of texts that score best in it.
        """
        bounds = np.tile(MIN_KNOWN * self.usual, (len(sizes), 1))
        bounds[:, self.usual == 0] = 2  # what knows nothing speaks for no text that scores better elsewhere
        rows = np.arange(len(sizes))
        bounds[rows, best] = (MIN_KNOWN * self.usual * np.minimum(1, self.known.sum(axis=0) / FULL_KNOWN))[best]
        spread = np.sqrt(np.maximum(0, bounds * (1 - bounds)) * 3 / np.maximum(1, sizes)[:, None])
        return (sizes > 0) & (shares < bounds - DEVIATIONS * spread).all(axis=1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_place", "_knows")}


def learn_vocabulary(trigrams: list[np.ndarray], languages: list[str]) -> Vocabulary:
    """What each language, in order of names, knows: from the trigram sets of its training texts."""
    names = sorted(set(languages))
    every = distinct(np.concatenate(trigrams)) if trigrams else np.zeros(0, np.int32)
    known, usual = np.zeros((every.size, len(names)), bool), np.zeros(len(names))
    for j, name in enumerate(names):
        places = [np.searchsorted(every, t) for t, x in zip(trigrams, languages, strict=True) if x == name]
        known[:, j] = np.bincount(np.concatenate(places), minlength=every.size) >= max(2, KNOWN_IN * len(places))
        usual[j] = np.median([known[p, j].mean() if p.size else 0.0 for p in places])
    some = known.any(axis=1)
    return Vocabulary(every[some], known[some], usual)


def fit_kernel_ridge(sets: list[np.ndarray], languages: list[str], landmarks: int = MAX_LANDMARKS, ridge: float = 1e-3) -> LanguageModel:
    """Fit from n-gram sets in a fixed order; landmarks are taken from the languages in turn, one of each at least.

    Rows weigh so that each language weighs the same. Without rows the model knows no language.
    """
    names = sorted(set(languages))
    queues = [[i for i, x in enumerate(languages) if x == name] for name in names]
    chosen = [q[k] for k in range(max(map(len, queues), default=0)) for q in queues if k < len(q)][: max(landmarks, len(names))]
    vocabulary = distinct(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.int32)
    presence = np.zeros((vocabulary.size, len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        presence[np.searchsorted(vocabulary, sets[i]), k] = 1
    model = LanguageModel(names, vocabulary, presence, np.array([sets[i].size for i in chosen]), np.zeros((len(chosen), len(names))), np.full(len(names), -1.0))
    if not chosen:
        return model
    rows = model.kernel(sets).astype(np.float64)
    values, vectors = np.linalg.eigh(model.kernel([sets[i] for i in chosen]).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * max(values.max(), 1e-12)))
    z = rows @ root
    y = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    weight = np.array([1 / (len(names) * len(queues[names.index(x)])) for x in languages])
    mean_z, mean_y = weight @ z, weight @ y
    zc = z - mean_z
    solved = np.linalg.solve((zc * weight[:, None]).T @ zc + ridge * np.eye(z.shape[1]), (zc * weight[:, None]).T @ (y - mean_y))
    model.coefficients, model.offsets = root @ solved, mean_y - mean_z @ solved
    return model


def fit(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", lang: str = "lang", max_labelled: int = MAX_LABELLED) -> LanguageModel:
    """Train on rows of ``docs`` that are not held out and whose text and language are not null.

    About ``max_labelled`` of them, drawn by seeded hashes of the key, reach the driver, as n-gram hashes. Languages
    share them alike, those with fewer rows giving all they have, but none is asked for fewer than LEAST_LABELLED.
    The driver sees a count per language. Twice the number wanted is never exceeded by much, however keys repeat.
    """
    rows = docs.where(~held_out(key) & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    counts = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}
    wanted = water_fill(list(counts.values()), [1] * len(counts), 0.95 * max_labelled, 1)
    wanted = [max(w, LEAST_LABELLED) for w in wanted]
    shares = [(x, min(1.0, w / n)) for (x, n), w in zip(counts.items(), wanted, strict=True)]
    kind = rows.schema["__lang"].dataType.simpleString()
    shares = docs.sparkSession.createDataFrame(shares, f"__lang {kind}, __share double")
    drawn = rows.join(F.broadcast(shares), "__lang").where(sampled("__key", F.col("__share"), seed)).select("__key", "__text", "__lang")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = column(batch, "__text")
        return [pa.array(ngrams(texts, orders), pa.list_(pa.int32())) for orders in ((1, 2, 3), (3,))]

    made = add_columns(drawn, "__grams array<int>, __trigrams array<int>", make, drop=("__text",))
    # Where keys repeat so often that the bound counts, the same rows are taken whatever the order they come in.
    made = made.withColumn("__digest", F.xxhash64("__key", "__lang", "__grams")).orderBy("__digest").limit(int(2 * sum(wanted)) + 100)
    table = made.toArrow().sort_by([(c, "ascending") for c in ("__key", "__lang", "__digest")])
    sets, trigrams = ([np.asarray(g.values) for g in table[c]] for c in ("__grams", "__trigrams"))
    model = fit_kernel_ridge(sets, table["__lang"].to_pylist())
    model.vocabulary = learn_vocabulary(trigrams, table["__lang"].to_pylist())
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (the best-scoring language) and score (0 to 1).

    Null texts and texts without a letter of any script are "und" with score 0, as is every text where the model
    knows no language. Of equal scores the first language by code point wins. Equal texts get equal answers.
    Clashing columns are replaced.
    """
    if not model.languages:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = model.scores(ngrams(column(batch, text)))
        best = scores.argmax(axis=1)
        return [pa.array([model.languages[i] for i in best], pa.string()), pa.array(scores[np.arange(len(best)), best], pa.float64())]

    lettered = _lettered(text)
    found = add_columns(docs, "lang_pred string, score double", make)
    return found.withColumn("lang_pred", F.when(lettered, F.col("lang_pred")).otherwise(UNDETERMINED)).withColumn("score", F.when(lettered, F.col("score")).otherwise(0.0))


def _lettered(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def spoken(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with the column spoken: whether the text is in one of the languages that ``model`` was fitted on.

    See :meth:`Vocabulary.foreign`. Of a text with fewer than three trigrams nothing is said against it. Null texts
    and texts without a letter of any script are in no language. A clashing column is replaced. Where the model knows
    no language, as no training row has one, nothing is foreign: all texts with a letter count as spoken.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        sets, shares, sizes = [], [], []
        for found in occurrences(column(batch, text)):
            sets.append(distinct(np.concatenate(found)))
            shares.append(model.vocabulary.shares(found[2]))
            sizes.append(found[2].size)
        if not sets:
            return [pa.array([], pa.bool_())]
        return [pa.array(~model.vocabulary.foreign(np.array(shares), np.array(sizes), model.scores(sets).argmax(axis=1)))]

    if not model.languages:
        return docs.withColumn("spoken", _lettered(text))
    found = add_columns(docs, "spoken boolean", make)
    return found.withColumn("spoken", F.col("spoken") & _lettered(text))
