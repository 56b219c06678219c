"""Quality rules (operator 10): robust multivariate outliers per language and source.

Method: every document becomes a vector of transformed statistics; per group
(language, source) the minimum covariance determinant estimate gives a robust
mean and covariance, and documents whose Mahalanobis distance is too large
are rejected.

* The estimate starts from each coordinate's median and median absolute
  deviation and is improved by concentration steps: take the ``SUPPORT``
  share of the group with the smallest distances, recompute mean and
  covariance, repeat.  A step is one pass: distances fall into narrow
  logarithmic bins, and bins carry sums and sums of products, so a group is
  only ever seen as a bounded number of partial sums (map-side combined).
  The bin at the support's edge counts with the share that is needed of it, so
  many rows at one distance do not widen the support; nothing is sampled and
  no group is collected, however many rows it has.
* Groups smaller than ``MIN_GROUP`` are judged by the estimate over all rows
  of their language, and those of languages still too small by the one over
  the whole corpus; only a corpus smaller than that has no estimate, and the
  method then rejects nothing.
* The statistics do not depend on a text's length by themselves, so that a
  long or short clean document is no outlier for its length alone.

Base rules, exact: fewer than 20 words, or over 30 % of the words inside an
8-word window found twice or more.

Defined results: null or empty text has no words: it fails the base rules.
Null language or source form a group like any value.  Every row gets a
result; rows repeated or with a null id are treated one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

DIMS = ("word_len", "symbols", "caps", "stutter", "repeats", "dup_lines", "stops", "spread")
SUPPORT = 0.5         # the usual half: up to that share of junk cannot move the estimate
STEPS = 6
MIN_GROUP = 100
# Least standard deviation of each statistic: what one odd word does to a short text.
MIN_SD = np.array([0.08, 0.25, 0.15, 0.08, 0.10, 0.12, 0.08, 0.04])
# Rejected: squared distance over this, the 99.99 % point of chi-square with 8 degrees.  In a
# group with a median distance over chi-square's, distances are scaled down to that median; never
# up, as MIN_SD is a floor that many equal texts must not lower.
CUTOFF = 31.83
MEDIAN = 7.344       # of chi-square with 8 degrees
_CODES = 64          # quantisation of a statistic for exact medians
_BINS_PER_OCTAVE = 8


def repeated_words(numbers: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` (a power of two) words found twice or more."""
    n = len(numbers) - size + 1
    if n < 2:
        return 0
    code, width = numbers.astype(np.int64), 1
    while width < size:                   # exact names for windows of 2, 4, 8 words
        pair = code[:-width] * (int(code.max()) + 1) + code[width:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


_SYMBOL = regex.compile(r"[#*$%&|<>]")
_BLANK = regex.compile(r"[\x20\x09-\x0D]")


def statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, vector) of one text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        n_symbols = len(_SYMBOL.findall(text)) if text else 0
        return 0, 0, n_symbols, 0, 0, None
    word_chars = len(text) - len(_BLANK.findall(text))
    n_symbols = len(_SYMBOL.findall(text))
    seen, dup_lines, n_lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            n_lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = repeated_words(numbers)
    counts = np.bincount(numbers)
    lengths = np.fromiter(map(len, known), np.float64, len(known))
    caps = _caps(raw)
    log_n = np.log(n + 1)
    vector = (
        float(np.log((lengths * counts).sum() / n)),
        float(np.log1p(50 * n_symbols / word_chars)),
        float(np.log1p(10 * caps / word_chars)),
        float(np.sqrt((numbers[1:] == numbers[:-1]).sum() / n)),
        float(np.sqrt(repeats / n)),
        float(np.sqrt(dup_lines / max(n_lines, 1))),
        float(np.sqrt((lengths <= 3) @ counts / n)),
        float(np.log(len(known) + 1) / log_n),
    )
    return n, word_chars, n_symbols, dup_lines, repeats, vector


def _caps(raw: bytes) -> int:
    codes = np.frombuffer(raw, np.uint8)
    return int(((codes >= 65) & (codes <= 90)).sum())


_STATS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType())]
    + [T.StructField(c, T.LongType())
       for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(c, T.DoubleType()) for c in DIMS])


def _statistics_batches(batches):
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = to_arrow_schema(_STATS)
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(3)]
        numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        vectors = [pa.array([r[5][i] if r[5] else None for r in rows], pa.float64())
                   for i in range(len(DIMS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *numbers, *vectors], schema=fields)


def document_statistics(docs: DataFrame) -> DataFrame:
    """Counts and the transformed statistic vector of every row's whole text."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"),
                        F.col("source").cast("string"), F.col("text"))
            .mapInArrow(_statistics_batches, _STATS))


def _grouped(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stats`` with ``group``, whose estimate judges a row, and the vectors of every estimate.

    A group is a language and source, or for small ones their whole language, or else the
    whole corpus; a row's vector takes part in each of these that some row is judged by.
    """
    sizes = stored(stats.where("NOT base_failed")
                   .groupBy(F.col("lang").alias("own_lang"), F.col("source").alias("own_source"))
                   .agg(F.count(F.lit(1)).alias("n")), "mcd-sizes")
    langs = sizes.groupBy(F.col("own_lang").alias("of_lang")).agg(F.sum("n").alias("n_lang"))
    own = F.concat(F.lit("source "), F.to_json(F.struct("own_lang", "own_source")))
    lang = F.concat(F.lit("language "), F.to_json(F.struct("own_lang")))
    names = stored(
        sizes.join(langs, F.col("own_lang").eqNullSafe(F.col("of_lang"))).select(
            "own_lang", "own_source", F.array(own, lang, F.lit("corpus")).alias("levels"),
            F.when(F.col("n") >= MIN_GROUP, own).when(F.col("n_lang") >= MIN_GROUP, lang)
            .otherwise(F.lit("corpus")).alias("group")), "mcd-names")
    used = names.select("group").distinct()
    parts = (names.select("own_lang", "own_source", F.explode("levels").alias("group"))
             .join(used, "group", "left_semi"))

    def named(rows: DataFrame, by: DataFrame, how: str) -> DataFrame:
        return rows.join(by, F.col("lang").eqNullSafe(F.col("own_lang"))
                         & F.col("source").eqNullSafe(F.col("own_source")), how)
    vectors = named(stats.where("NOT base_failed"), parts, "inner").select("group", *DIMS)
    return (named(stats, names.drop("levels"), "left").drop("own_lang", "own_source"),
            stored(vectors, "mcd-vectors"))


def _medians(stats: DataFrame, centre: DataFrame | None) -> DataFrame:
    """Per group and statistic the median of the values (or of their deviations), quantised."""
    d = len(DIMS)
    if centre is not None:
        stats = stats.join(centre, "group")
        values = [F.abs(F.col(c) - F.col("centre")[i]) for i, c in enumerate(DIMS)]
    else:
        values = [F.col(c) for c in DIMS]
    counts = (stats.select("group", F.posexplode(F.array(
                  *[F.round(v * _CODES).cast("long") for v in values])).alias("dim", "code"))
              .groupBy("group", "dim", "code").agg(F.count(F.lit(1)).alias("n")))
    upto = Window.partitionBy("group", "dim").orderBy("code")
    every = Window.partitionBy("group", "dim")
    middle = (counts.withColumn("upto", F.sum("n").over(upto))
              .withColumn("all", F.sum("n").over(every))
              .where("2 * upto >= all").groupBy("group", "dim").agg(F.min("code").alias("code")))
    wide = middle.groupBy("group").pivot("dim", list(range(d))).agg(F.first("code"))
    return wide.select("group", F.array(*[F.col(str(i)) / _CODES for i in range(d)])
                       .alias("centre" if centre is None else "spread"))


def _distance():
    """Squared Mahalanobis distance as a column, from ``centre`` and ``precision``."""
    d = len(DIMS)
    gap = [F.col(c) - F.col("centre")[i] for i, c in enumerate(DIMS)]
    terms = [(1 if i == j else 2) * F.col("precision")[i * d + j] * gap[i] * gap[j]
             for i in range(d) for j in range(i, d)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _inverse(cov: pd.Series) -> pd.Series:
    d = len(DIMS)
    out = []
    for flat in cov:
        matrix = np.asarray(flat, float).reshape(d, d)
        matrix = matrix + np.diag(MIN_SD ** 2)     # never singular, never narrower than this
        out.append(np.linalg.inv(matrix).ravel().tolist())
    return pd.Series(out)


_inverse_udf = F.pandas_udf(_inverse, T.ArrayType(T.DoubleType()))


def _concentrate(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: mean and covariance of each group's support under ``estimate``."""
    d = len(DIMS)
    binned = vectors.join(estimate, "group").withColumn("d2", _distance()).withColumn(
        "bin", F.floor(_BINS_PER_OCTAVE * F.log2(F.col("d2") + 1e-6)).cast("int"))
    products = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(c) for c in DIMS] + [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])) for i, j in products]
    sums = [s.alias(f"s{k}") for k, s in enumerate(sums)]
    bins = binned.groupBy("group", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("d2").alias("sum_d2"), *sums)
    order = Window.partitionBy("group").orderBy("bin")
    every = Window.partitionBy("group")
    needed = F.lit(SUPPORT) * F.col("all") - F.col("below")
    support = (bins.withColumn("below", F.sum("n").over(order) - F.col("n"))
               .withColumn("all", F.sum("n").over(every)).where(needed > 0)
               .withColumn("part", F.least(F.lit(1.0), needed / F.col("n"))))
    part = F.col("part")
    total = support.groupBy("group").agg(
        F.sum(part * F.col("n")).alias("n"),
        *[F.sum(part * F.col(f"s{k}")).alias(f"s{k}") for k in range(len(sums))])
    mean = [F.col(f"s{k}") / F.col("n") for k in range(d)]
    place = {p: d + k for k, p in enumerate(products)}
    cov = [F.col(f"s{place[min(i, j), max(i, j)]}") / F.col("n") - mean[i] * mean[j]
           for i in range(d) for j in range(d)]
    # The covariance of the nearest half is too small by a known factor.
    factor = F.lit(consistency(SUPPORT, d))
    return total.select("group", F.array(*mean).alias("centre"), _inverse_udf(
        F.array(*[factor * c for c in cov])).alias("precision"))


def consistency(support: float, d: int) -> float:
    """support / P(chi2 with d+2 degrees <= its support point with d): both by simple quadrature."""
    x = np.linspace(0, 10.0 * d, 200_001)

    def cdf(k):
        density = np.where(x > 0, np.exp((k / 2 - 1) * np.log(np.maximum(x, 1e-300)) - x / 2), 0)
        total = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
        return total / total[-1]

    point = int(np.searchsorted(cdf(d), support))
    return support / float(cdf(d + 2)[point])


def robust_estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """group, centre, precision: the minimum covariance determinant estimate of every group."""
    d = len(DIMS)
    centre = stored(_medians(vectors, None), "mcd-centre")
    spread = _medians(vectors, centre)
    diagonal = [F.pow(1.4826 * F.col("spread")[i], 2) if i == j else F.lit(0.0)
                for i in range(d) for j in range(d)]
    estimate = stored(centre.join(spread, "group").select(
        "group", "centre", _inverse_udf(F.array(*diagonal)).alias("precision")), "mcd-start")
    for _ in range(steps):
        estimate = stored(_concentrate(vectors, estimate), "mcd-step")
    return _rescaled(vectors, estimate)


def _rescaled(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """``estimate`` with the precision lowered where a group's median distance is too large."""
    counts = (vectors.join(estimate, "group")
              .select("group", F.round(_CODES * F.log2(_distance() + 1e-6)).alias("code"))
              .groupBy("group", "code").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("group").orderBy("code"))
    every = F.sum("n").over(Window.partitionBy("group"))
    middle = (counts.withColumn("upto", upto).withColumn("all", every)
              .where("2 * upto >= all").groupBy("group").agg(F.min("code").alias("code")))
    scale = F.least(F.lit(1.0), MEDIAN / F.pow(F.lit(2.0), F.col("code") / _CODES))
    return estimate.join(middle, "group").select(
        "group", "centre", F.transform("precision", lambda x: x * scale).alias("precision"))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (squared) and ``kept`` for every row."""
    stats = document_statistics(docs).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    stats, vectors = _grouped(stored(stats, "mcd-statistics"))
    stats = stored(stats, "mcd-grouped")
    sizes = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {MIN_GROUP}")
    # Written, so that the planner knows its size: the hot group's rows then need no shuffle
    # while the estimates are small, and a skew-split shuffle join beyond that.
    estimate = stored(robust_estimates(vectors).join(sizes.select("group"), "group"),
                      "mcd-estimate")
    judged = stats.join(estimate, "group", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))
        .alias("kept"), "distance")
