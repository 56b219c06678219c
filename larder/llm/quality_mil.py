"""Quality classifier (operator 3): attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is
encoded (byte histogram and shape statistics through a tanh layer); gated
attention (Ilse et al. 2018),

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),

is learned from document labels alone, and the attention-weighted mean of the
passage codes is scored by a logistic unit.  Forward and backward passes are
numpy on ragged bags.

The fit uses a bounded sample: at most ``MAX_TRAIN`` labelled documents, those
with the least id hashes.  Scoring reads every passage of every text; ids,
language, source and labels are no inputs.

Defined results: null, empty and blank texts are one passage of zeros and get
its score.  With labels of one kind only (or none) the score is constant.
Equal texts get equal scores.  A document with several label rows takes the
least quality; null labels and label rows without a document are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh_name, stored

PASSAGE = 64
MAX_TRAIN = 6_000
HIDDEN, ATTENTION = 24, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.005, 1e-4
SHAPES = 6
DIMS = 256 + SHAPES


def passages(text: str | None) -> np.ndarray:
    """Matrix with a row of features for each passage of the whole text."""
    words = text.encode("utf-8", "replace").split() if text else []
    n = len(words)
    if not n:
        return np.zeros((1, DIMS), np.float32)
    starts = list(range(0, n, PASSAGE))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    length = np.fromiter(map(len, words), np.float64, n)
    same = np.zeros(n)
    same[1:] = ids[1:] == ids[:-1]
    again = np.zeros(n)                  # the word ends a four-word run met before in the text
    if n > 4:
        pair = ids[:-1] * len(known) + ids[1:]
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        four = pair[:-2] * (int(pair.max()) + 1) + pair[2:]
        _, first, back = np.unique(four, return_index=True, return_inverse=True)
        again[3:] = first[back] < np.arange(len(four))
    x = np.zeros((len(starts), DIMS), np.float32)
    size = np.diff([*starts, n])
    for row, s in enumerate(starts):
        raw = np.frombuffer(b" ".join(words[s:s + PASSAGE]), np.uint8)
        x[row, :256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
        x[row, 256] = len(np.unique(ids[s:s + PASSAGE])) / size[row]
    x[:, 257] = np.add.reduceat(same, starts) / size
    x[:, 258] = np.add.reduceat(again, starts) / size
    x[:, 259] = np.log(np.add.reduceat(length, starts) / size) / 2
    x[:, 260] = size / PASSAGE
    x[:, 261] = 1
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class QualityModel:
    """Parameters; ``constant`` instead when there was nothing to learn from."""

    params: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of bags (rows from each of ``starts`` on) and what backpropagation needs."""
        p = self.params
        h = np.tanh(((x - p["mean"]) / p["sd"]) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        top = np.maximum.reduceat(e, starts)
        a = np.exp(e - top[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["d"]), (h, t, g, a, z, bag)

    def score(self, text) -> float:
        if self.constant is not None:
            return self.constant
        return float(self.forward(passages(text), np.array([0]))[0][0])

    def column(self, text: Column) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([self.score(t) for t in texts], dtype="float64")
        return F.pandas_udf(run, T.DoubleType())(text)


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS,
          seed: int = 0) -> QualityModel:
    """Gradient descent (Adam) on the mean log loss, both labels with equal total weight."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return QualityModel({}, constant=share)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    p = {"W": rng.normal(0, 0.5 / np.sqrt(DIMS), (DIMS, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
         "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    model = QualityModel(p | {"mean": every.mean(0), "sd": every.std(0) + 0.02})
    m = {k: np.zeros_like(x) for k, x in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for part in np.array_split(order, max(1, len(bags) // BATCH)):
            x = np.concatenate([bags[i] for i in part])
            starts = np.cumsum([0, *[len(bags[i]) for i in part[:-1]]])
            q = model.params
            score, (h, t, g, a, z, bag) = model.forward(x, starts)
            dz_out = weight[part] * (score - labels[part]) / len(part)
            dz = dz_out[:, None] * q["c"]
            grad = {"c": z.T @ dz_out, "d": np.array([dz_out.sum()])}
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, starts)[bag])
            grad["w"] = (t * g).T @ de
            dt, dg = de[:, None] * q["w"] * g * (1 - t * t), de[:, None] * q["w"] * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = (a[:, None] * dz[bag] + dt @ q["V"].T + dg @ q["U"].T) * (1 - h * h)
            grad["W"], grad["b"] = ((x - q["mean"]) / q["sd"]).T @ dh, dh.sum(0)
            step += 1
            for k, gk in grad.items():
                gk = gk + DECAY * q[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                q[k] = q[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _sample_rows(batches):
    for batch in batches:
        yield pd.DataFrame({
            "id_hash": batch["id_hash"], "quality": batch["quality"],
            "x": [passages(t).astype(np.float16).tobytes() for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1,
        max_train: int = MAX_TRAIN) -> QualityModel:
    """Learns from labelled rows outside the held-out fold."""
    id_hash = F.xxhash64("doc_id")
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                           & (fold(F.col("doc_id"), modulus) != held_out))
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(id_hash, "doc_id").limit(max_train))
    # Bounded by max_train, so every task may hold the chosen ids.
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
              .select(id_hash.alias("id_hash"), "quality", "text"))
    rows = sorted(stored(sample.mapInPandas(_sample_rows, "id_hash long, quality int, x binary"),
                         "quality-sample").collect(), key=lambda r: (r.id_hash, r.quality, r.x))
    bags = [np.frombuffer(r.x, np.float16).reshape(-1, DIMS).astype(np.float32) for r in rows]
    return train(bags, np.array([float(r.quality) for r in rows]))


def score(docs: DataFrame, model: QualityModel, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        model.column(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows predicted good, with the columns of ``docs``."""
    mark = fresh_name(docs, "_quality")
    return docs.withColumn(mark, model.column(docs["text"])).where(F.col(mark) >= 0.5).drop(mark)
