"""Mixing sources to target weights (operator 8): soft-membership mixing.

A classifier, fitted on labelled rows (a multinomial logistic regression on
hashed byte pairs, numpy), predicts every document's posterior p(d) over the
domains.  Document rates r >= 0 are then fitted so that the expected domain
token totals

    T_d(r) = sum_i r_i n_i p_i(d)

match the targets, by distributed projected-gradient least squares on

    1/2 (T(r)/N - t)' S (T(r)/N - t) + RIDGE/2 sum_i (n_i/N) (r_i - 1)^2,  r >= 0,

whose small second term makes the solution unique (the rates closest to 1).
S is the inverse of the Gram matrix sum_i (n_i/N) p_i p_i', so a rare domain
moves as fast as a common one and is held as close to its own target; where
the Gram matrix is even anyway (``EVEN``), S is the identity.  Steps go on
until every domain is within ``TOLERANCE`` of its target, relative to that
target; targets missed by more than ``MISSED`` raise an error.
A step needs one number a domain from all documents: Spark sums the totals
under the present rates, and every rate is updated from its own posterior
with the residuals.  A document's rate follows from its posterior and the
residuals so far, so these short vectors, not the rates, are what iterations
hand on; the table of posteriors is written once and only read.

Targets are scaled so that no domain has to shrink (``keep_all``): rates are
then about 1 or more, and mixing repeats documents but drops none.

Defined results: null, empty and blank texts have no tokens, weigh nothing
and get the rate of their posterior.  Domains that no labelled row has get no
posterior; with a single domain (or none) every posterior is that domain's
and rates are 1 (an empty table gives no rows).  Rows repeated or with a null
id are mixed one by one; labelled rows with a null domain are not learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, stored

MAX_TRAIN = 4_000
PAIRS = 1_024
FIT_STEPS, FIT_RATE, FIT_DECAY = 200, 0.05, 1e-3
RIDGE = 1e-4
MAX_STEPS = 300
EVEN = 0.1            # least eigenvalue of a Gram matrix that needs no scaling
TOLERANCE = 1e-3      # error of a domain's total relative to its target, at which steps end
MISSED = 1e-2         # the same error, from which on the targets count as not met
STALLED = 1e-7        # largest relative move of a step that changes nothing any more
TEMPERATURE = 0.7


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs in the lower-cased text."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8).astype(np.int64)
    if len(raw) < 2:
        return np.zeros(PAIRS, np.float32)
    pairs = (raw[:-1] * 263 + raw[1:] * 31) % PAIRS
    return np.sqrt(np.bincount(pairs, minlength=PAIRS) / len(pairs)).astype(np.float32)


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, text) -> np.ndarray:
        z = features(text) @ self.weights + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def column(self, text: Column) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([self.posterior(t).astype(float).tolist() for t in texts])
        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text)


def train(x: np.ndarray, domains: np.ndarray) -> DomainModel:
    """Multinomial logistic regression by full-batch Adam."""
    names = sorted(set(domains.tolist()))
    y = (domains[:, None] == np.array(names, object)[None, :]).astype(np.float64)
    w = np.zeros((x.shape[1] + 1, len(names)))
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, FIT_STEPS + 1):
        z = x @ w
        e = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ (e / e.sum(1, keepdims=True) - y) / len(x) + FIT_DECAY * w / len(names)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - FIT_RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return DomainModel(names, w[:-1], w[-1])


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str,
                max_train: int = MAX_TRAIN) -> DomainModel:
    """Learns ``docs[domain]`` from the texts of at most ``max_train`` labelled rows."""
    id_hash = F.xxhash64("doc_id")
    chosen = (labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
              .join(docs.where(F.col(domain).isNotNull()).select("doc_id"), "doc_id", "left_semi")
              .orderBy(id_hash, "doc_id").limit(max_train))

    def vectors(batches):
        for batch in batches:
            yield pd.DataFrame({"id_hash": batch["id_hash"], "domain": batch["domain"],
                                "x": [features(t).astype(np.float16).tobytes()
                                      for t in batch["text"]]})

    # Bounded by max_train, so every task may hold the chosen ids.
    rows = (docs.where(F.col(domain).isNotNull()).join(F.broadcast(chosen), "doc_id")
            .select(id_hash.alias("id_hash"), F.col(domain).cast("string").alias("domain"), "text")
            .mapInPandas(vectors, "id_hash long, domain string, x binary").collect())
    if not rows:
        return DomainModel(["all"], np.zeros((PAIRS, 1)), np.zeros(1))
    rows = sorted(rows, key=lambda r: (r.id_hash, r.domain, r.x))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float64)
    return train(x, np.array([r.domain for r in rows], object))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"),
                           lambda w: w != "")).cast("long")


def rate_column(posterior: Column, residuals: list[np.ndarray], step: float) -> Column:
    """The rate after the projected-gradient steps with ``residuals``, starting from 1."""
    if not residuals:
        return F.lit(1.0)
    table = np.stack(residuals)

    def run(posteriors: pd.Series) -> pd.Series:
        p = np.array(posteriors.tolist(), float).reshape(-1, table.shape[1])
        rate = np.ones(len(p))
        for push in (p @ table.T).T:
            rate = np.maximum(0.0, rate - step * (push + RIDGE * (rate - 1)))
        return pd.Series(rate)
    return F.pandas_udf(run, T.DoubleType())(posterior)


def targets_of(totals: np.ndarray, weights: np.ndarray | None, keep_all: bool = True) -> np.ndarray:
    """Target totals a domain: shares raised to ``TEMPERATURE`` unless ``weights`` are given."""
    wanted = totals ** TEMPERATURE if weights is None else np.where(totals > 0, weights, 0.0)
    if wanted.sum() == 0:
        return totals
    wanted = wanted / wanted.sum()
    scale = totals.sum()
    if keep_all:
        scale = max(scale, float((totals[wanted > 0] / wanted[wanted > 0]).max()))
    return wanted * scale


def metric_of(gram: np.ndarray) -> np.ndarray:
    """The weights S of the residuals: the inverse Gram matrix, or the identity if it is even."""
    value, vector = np.linalg.eigh(gram)
    if value[0] >= EVEN:
        return np.eye(len(gram))
    return (vector / np.maximum(value, 1e-9 * value[-1])) @ vector.T


def relative_errors(reached: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each domain's error relative to its own target (to all tokens if that is zero)."""
    return np.abs(reached - target) / np.where(target > 0, target, 1.0)


def fit_rates(members: DataFrame, n_domains: int, weights: np.ndarray | None = None,
              keep_all: bool = True) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Scaled residuals of all steps, step length, targets and reached totals (shares of N).

    ``members``: rows with ``n`` (tokens) and ``p`` (posterior).
    """
    p = [F.col("p")[d] for d in range(n_domains)]
    first = members.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * x).alias(f"t{d}")
                                                 for d, x in enumerate(p)],
                        *[F.sum(F.col("n") * p[a] * p[b]).alias(f"g{a}_{b}")
                          for a in range(n_domains) for b in range(n_domains)]).first()
    n = float(first["n"] or 0)
    if not n:
        return [], 0.0, np.zeros(n_domains), np.zeros(n_domains)
    totals = np.array([first[f"t{d}"] for d in range(n_domains)]) / n
    gram = np.array([[first[f"g{a}_{b}"] for b in range(n_domains)]
                     for a in range(n_domains)]) / n
    target = targets_of(totals, weights, keep_all)
    metric = metric_of(gram)
    # S G has the eigenvalues of the scaled problem: 1, or those of the Gram matrix.
    step = 1.0 / (float(np.linalg.eigvals(metric @ gram).real.max()) + RIDGE)
    residuals: list[np.ndarray] = []
    reached, moved = totals, np.inf
    while (relative_errors(reached, target).max() > TOLERANCE and moved > STALLED
           and len(residuals) < MAX_STEPS):
        residuals.append(metric @ (reached - target))
        rates = members.select("n", "p", rate_column(F.col("p"), residuals, step).alias("r"))
        row = rates.agg(*[F.sum(F.col("r") * F.col("n") * x) for x in p]).first()
        new = np.array(row) / n
        moved, reached = float(relative_errors(new, reached).max()), new
    return residuals, step, target, reached


def require_met(target: np.ndarray, reached: np.ndarray, domains: list[str]) -> None:
    missed = [f"{d}: {r:.3g} of all tokens instead of {t:.3g}" for d, r, t, e
              in zip(domains, reached, target, relative_errors(reached, target)) if e > MISSED]
    if missed:
        raise RuntimeError("mixing targets are not met: " + "; ".join(missed))


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang",
        weights: dict[str, float] | None = None,
        keep_all: bool = True) -> tuple[DataFrame, str, list[str]]:
    """``docs`` with a struct column (n_tokens, posterior, rate), its name, and the domains."""
    model = fit_domains(docs, labels, domain)
    wanted = None if weights is None else np.array([weights.get(d, 0.0) for d in model.domains])
    members = stored(docs.select(n_words(F.col("text")).alias("n"),
                                 model.column(F.col("text")).alias("p")), "mixing-members")
    residuals, step, target, reached = fit_rates(members, len(model.domains), wanted, keep_all)
    require_met(target, reached, model.domains)
    name = fresh_name(docs, "_mix")
    out = docs.withColumn(name, F.struct(n_words(docs["text"]).alias("n_tokens"),
                                         model.column(docs["text"]).alias("posterior")))
    rate = rate_column(F.col(f"{name}.posterior"), residuals, step)
    return out.withColumn(name, F.col(name).withField("rate", rate)), name, model.domains


def rates(docs: DataFrame, labels: DataFrame, domain: str = "lang") -> DataFrame:
    """doc_id, n_tokens, rate, top_domain and posterior (in the domains' order) of every row."""
    mixed, name, domains = mix(docs, labels, domain)
    p = F.col(f"{name}.posterior")
    best = F.array_position(p, F.array_max(p)).cast("int")
    return mixed.select("doc_id", f"{name}.n_tokens", f"{name}.rate",
                        F.element_at(F.array(*[F.lit(d) for d in domains]), best)
                        .alias("top_domain"), p.alias("posterior"))


def resample(docs: DataFrame, labels: DataFrame, domain: str = "lang") -> DataFrame:
    """Every row as often as its rate says but at least once, with the columns of ``docs``.

    The fraction of a rate becomes one more copy for the share of documents
    whose id hash falls below it, the same on every run.
    """
    mixed, name, _ = mix(docs, labels, domain)
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    copies = F.greatest(F.lit(1), F.floor(F.col(f"{name}.rate") + draw + 1e-9)).cast("int")
    return (mixed.withColumn(name, F.explode(F.array_repeat(F.lit(1), copies)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
