"""Toxicity (operator 5): non-negative positive-unlabelled learning.

Only confirmed toxic documents are positives; everything else, labelled or
not, is unlabelled text that holds toxic documents at the class prior pi.
Linear classifiers are trained in numpy on the non-negative risk

    pi R_p(+) + max(0, R_u(-) - pi R_p(-))

(Kiryo et al. 2017): the corrected risk of the negatives is not allowed to
fall below zero.  The loss is the sigmoid; the score is the mean of
``MODELS`` classifiers on bootstrap weights.  pi is the share of toxic rows
among the labelled ones, unless given.

Features are a text's distinct words with their beginnings and endings; the
``MAX_FEATURES`` most telling ones (document frequency among positives
against unlabelled, counted on Spark) enter the model.

The positives are bounded: the ``MAX_POSITIVE`` toxic documents with the
least id hashes.  The unlabelled side is all documents outside the held-out
fold: their features are counted over all of them, and the risk is taken
over all of them for the last ``FULL_STEPS`` steps, each one pass over their
stored feature vectors that sums gradients by weight.  The steps before only
find a starting point and use the vectors of the ``START`` least id hashes.
Scoring reads every whole text; ids, language, source and labels are no
inputs.

Defined results: null and empty texts have no features and get the score of
the bias; with no toxic example at all every score is 0.  Equal texts get
equal scores.  A document with several label rows counts as toxic if one
says so; null labels and label rows without a document are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh_name, stored

MAX_POSITIVE = 4_000
START = 12_000
FULL_STEPS = 10
MAX_FEATURES = 1_024
MIN_POSITIVE_DF = 3
MODELS = 3
STEPS = 250
RATE = 0.06
DECAY = 1e-5
_WORD = regex.compile(r"[^\W\d_]+")
_CACHE = 400_000


def word_features(word: str) -> list[str]:
    """The word, its beginnings and its endings."""
    parts = [f"={word}"]
    for k in (4, 5, 6):
        if len(word) > k:
            parts += [f"^{word[:k]}", f"{word[-k:]}$"]
    return parts


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class ToxicityModel:
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))   # feature x model
    bias: np.ndarray = field(default_factory=lambda: np.full(1, -np.inf))

    def scorer(self):
        """Function from a text to its score, with a bounded cache of word features."""
        cache: dict[str, tuple] = {}
        wanted = self.features

        def score(text):
            counts: dict[int, int] = {}
            for word in words(text):
                found = cache.get(word)
                if found is None:
                    if len(cache) >= _CACHE:
                        cache.clear()
                    found = cache[word] = tuple(
                        wanted[f] for f in word_features(word) if f in wanted)
                for i in found:
                    counts[i] = counts.get(i, 0) + 1
            at = np.fromiter(sorted(counts), np.int64, len(counts))
            x = np.log1p(np.array([counts[i] for i in at], float))
            logits = x @ self.weights[at] + self.bias if len(at) else self.bias
            return float(np.mean(1 / (1 + np.exp(-np.clip(logits, -500, 500)))))

        return score

    def column(self, text: Column) -> Column:
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = self.scorer()
            for batch in texts:
                yield pd.Series([score(t) for t in batch], dtype="float64")
        return F.pandas_udf(run, T.DoubleType())(text)


class _WordFeatures(dict):
    """A word's feature numbers, made when first asked for."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple:
        if len(self) >= _CACHE:
            self.clear()
        found = self[word] = tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)
        return found


class _Numbers(dict):
    """Numbers for whatever is asked for, in the order of asking."""

    def __contains__(self, feature) -> bool:
        return True

    def __missing__(self, feature: str) -> int:
        self[feature] = len(self)
        return self[feature]


def _document_frequencies(wanted: list[str] | None = None):
    """Function from batches of texts to a task's features with the number of texts that have
    them: of all features, or of the ``wanted`` ones only."""
    def run(batches):
        numbers = _Numbers() if wanted is None else {f: i for i, f in enumerate(wanted)}
        of_word = _WordFeatures(numbers)
        total, ids = np.zeros(0, np.int64), []

        def added():
            counts = np.bincount(np.array(ids, np.int64), minlength=max(len(numbers), len(total)))
            counts[:len(total)] += total
            ids.clear()
            return counts

        def rows():
            names = np.array([*numbers, None], object)[:-1]
            at = np.flatnonzero(total)
            return pd.DataFrame({"feature": names[at], "n": total[at]})

        for batch in batches:
            for text in batch["text"]:
                ids.extend(set().union(*map(of_word.__getitem__, words(text))))
                if len(ids) > _CACHE:
                    total = added()
                    if wanted is None and len(numbers) > _CACHE:
                        yield rows()
                        numbers.clear()
                        of_word.clear()
                        total = np.zeros(0, np.int64)
        total = added()
        yield rows()
    return run


def _choose(toxic: DataFrame, unlabelled: DataFrame, n_positive: int, n_unlabelled: int,
            limit: int) -> list[str]:
    """The features whose document frequency rises most from unlabelled to positive.

    Among the unlabelled texts only those features are counted that could pass if no text
    had them; their number is bounded by the positives'.
    """
    count = lambda df, wanted=None: (df.mapInPandas(                       # noqa: E731
        _document_frequencies(wanted), "feature string, n long")
        .groupBy("feature").agg(F.sum("n").alias("n")))
    common = stored(count(toxic.select("text")).where(F.col("n") >= MIN_POSITIVE_DF)
                    .withColumnRenamed("n", "p"), "toxicity-features")
    p = F.col("p") / n_positive
    best = p / F.sqrt(p * (1 - p) / n_positive + 1e-9)
    wanted = sorted(r["feature"] for r in common.where(best > 3).select("feature").collect())
    counts = common.where(best > 3).join(count(unlabelled.select("text"), wanted).withColumnRenamed("n", "u"),
                         "feature", "left").na.fill(0, ["u"])
    u = (F.col("u") + 0.5) / (n_unlabelled + 1)
    z = (p - u) / F.sqrt(p * (1 - p) / n_positive + u * (1 - u) / n_unlabelled + 1e-9)
    rows = (counts.withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "feature")
            .limit(limit).collect())
    return [r.feature for r in rows]


def _merged(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with features, and one row of zeros that stands for all the others."""
    some = x.any(axis=1)
    return (np.concatenate([x[some], np.zeros((1, x.shape[1]))]).astype(np.float32),
            np.append(weight[some], weight[~some].sum()).astype(np.float32))


class Learner:
    """One linear classifier on the non-negative PU risk with sigmoid loss (Adam).

    It holds the positives, on bootstrap weights; a step is given the unlabelled side's mean
    of sigmoid(z) and that mean's gradient.
    """

    def __init__(self, x_p: np.ndarray, prior: float, rng: np.random.Generator):
        w_p = rng.poisson(1, len(x_p)) + 0.05
        self.prior, self.d, self.t = prior, x_p.shape[1], 0
        self.positives = _merged(x_p, w_p / w_p.sum())
        self.theta = np.zeros(self.d + 1, np.float32)
        self.theta[self.d] = np.log(prior / (1 - prior))
        self.m, self.v = np.zeros_like(self.theta), np.zeros_like(self.theta)

    def side(self, x: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted mean of sigmoid(z), and its gradient."""
        s = 1 / (1 + np.exp(-np.clip(x @ self.theta[:self.d] + self.theta[self.d], -60, 60)))
        slope = weight * s * (1 - s)
        return weight @ s, np.append(x.T @ slope, slope.sum())

    def step(self, other: float, g_other: np.ndarray) -> None:
        toxic, g_toxic = self.side(*self.positives)   # 1 - this: loss of positives as positive
        g = -self.prior * g_toxic
        if other - self.prior * toxic > 0:            # the non-negative correction
            g = g + g_other - self.prior * g_toxic
        g = g.astype(np.float32)
        g[:self.d] += DECAY * self.theta[:self.d]
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.theta = self.theta - np.float32(RATE) * (self.m / np.float32(1 - 0.9 ** self.t)) / (
            np.sqrt(self.v / np.float32(1 - 0.999 ** self.t)) + np.float32(1e-8))


def started(x_p: np.ndarray, x_u: np.ndarray, prior: float, seed: int,
            steps: int = STEPS) -> Learner:
    """A learner after ``steps`` steps on the given unlabelled rows, on bootstrap weights."""
    rng = np.random.default_rng(seed)
    learner = Learner(x_p, prior, rng)
    w_u = rng.poisson(1, len(x_u)) + 0.05
    rows = _merged(x_u, w_u / w_u.sum())
    for _ in range(steps):
        learner.step(*learner.side(*rows))
    return learner


def nnpu_fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, seed: int,
             steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk of the given rows."""
    theta = started(x_p, x_u, prior, seed, steps).theta.astype(float)
    return theta[:-1], float(theta[-1])


def risk_terms(vectors: DataFrame, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of ``vectors`` (at, x): of sigmoid(z) by classifier, and of its
    gradient by classifier and weight.  A task sends each of these sums once."""
    k, width = thetas.shape
    d = width - 1

    def run(batches):
        total, grad = np.zeros(k), np.zeros((k, width))
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["at"].map(len).to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            at = np.concatenate([*batch["at"], np.zeros(0, np.int64)]).astype(np.int64)
            x = np.concatenate([*batch["x"], np.zeros(0)])
            for i, theta in enumerate(thetas):
                z = np.bincount(row, x * theta[at], len(batch)) + theta[d]
                s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                slope = s * (1 - s)
                total[i] += s.sum()
                grad[i, :d] += np.bincount(at, x * slope[row], d)
                grad[i, d] += slope.sum()
        values = np.concatenate([total, grad.ravel()])
        at = np.flatnonzero(values)
        yield pd.DataFrame({"place": at, "value": values[at]})

    sums = np.zeros(k + k * width)
    for r in (vectors.select("at", "x").mapInPandas(run, "place long, value double")
              .groupBy("place").agg(F.sum("value").alias("value")).collect()):
        sums[r["place"]] = r["value"]
    return sums[:k], sums[k:].reshape(k, width)


def _vectors(features: dict[str, int]):
    def run(batches):
        cache: dict[str, tuple] = {}
        for batch in batches:
            at, x = [], []
            for text in batch["text"]:
                counts: dict[int, int] = {}
                for word in words(text):
                    found = cache.get(word)
                    if found is None:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        found = cache[word] = tuple(
                            features[f] for f in word_features(word) if f in features)
                    for i in found:
                        counts[i] = counts.get(i, 0) + 1
                at.append(sorted(counts))
                x.append([float(np.log1p(counts[i])) for i in sorted(counts)])
            yield pd.DataFrame({"id_hash": batch["id_hash"], "at": at, "x": x})
    return run


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        out[i, r["at"]] = r["x"]
    return out


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None,
        modulus: int = 5, held_out: int = 0, max_positive: int = MAX_POSITIVE,
        start: int = START, full_steps: int = FULL_STEPS) -> ToxicityModel:
    """Learns from labels of rows outside the held-out fold and all unlabelled texts there."""
    train = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & (fold(F.col("doc_id"), modulus) != held_out))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    id_hash = F.xxhash64("doc_id")
    told = train.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    if not told["k"]:
        return ToxicityModel()
    if prior is None:
        prior = min(0.9, max(1e-3, told["k"] / told["n"]))
    # bounded by max_positive, so every task may hold the chosen ids
    positive = F.broadcast(train.where("toxic = 1").select("doc_id", id_hash.alias("_hash"))
                           .orderBy("_hash", "doc_id").limit(max_positive).select("doc_id"))
    toxic = stored(docs.select("doc_id", "text").join(positive, "doc_id")
                   .select(id_hash.alias("id_hash"), "text"), "toxicity-positives")
    unlabelled = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held_out)
                            ).select(id_hash.alias("id_hash"), "text")
    n_positive, n_unlabelled = toxic.count(), unlabelled.count()
    if not n_positive or not n_unlabelled:
        return ToxicityModel()
    names = _choose(toxic, unlabelled, n_positive, n_unlabelled, MAX_FEATURES)
    features = {name: i for i, name in enumerate(names)}
    vector = "id_hash long, at array<int>, x array<double>"
    rows = sorted(toxic.mapInPandas(_vectors(features), vector).collect(),
                  key=lambda r: (r.id_hash, r.at, r.x))
    x_p = _matrix(rows, len(names))
    vectors = stored(unlabelled.mapInPandas(_vectors(features), vector), "toxicity-vectors")
    # a few more than wanted by the hash, so that tasks send few rows that the limit drops
    share = min(1.0, (start + 6 * start ** 0.5 + 50) / n_unlabelled)
    low = F.col("id_hash") <= F.lit(int(-2.0 ** 63 + share * (2.0 ** 64 - 2 ** 12)))
    x_u = _matrix(vectors.where(low).orderBy("id_hash", "at", "x").limit(start).collect(), len(names))
    learners = [started(x_p, x_u, prior, seed) for seed in range(MODELS)]
    for _ in range(full_steps):
        total, grad = risk_terms(vectors, np.stack([m.theta for m in learners]).astype(float))
        for learner, s, g in zip(learners, total, grad):
            learner.step(s / n_unlabelled, g / n_unlabelled)
    theta = np.stack([m.theta for m in learners], axis=1).astype(float)
    return ToxicityModel(features, theta[:-1], theta[-1])


def score(docs: DataFrame, model: ToxicityModel, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        model.column(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that are not predicted toxic, with the columns of ``docs``."""
    mark = fresh_name(docs, "_toxicity")
    return docs.withColumn(mark, model.column(docs["text"])).where(F.col(mark) < 0.5).drop(mark)
