"""Forecast history and the feedback loop.

The history is a table keyed by (store, product, date).  Updates are
expressed as joins producing a new version of the table (write it to a new
path, see ``larder.sources.sinks``), never as in-place row edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import clip, count_if, half_even
from ..functions.rownum import bucketed_row_number
from .evaluate import metric_columns

KEY = ["store", "product", "date"]
PAIR = ["store", "product"]
HISTORY_COLUMNS = ["store", "product", "date", "predicted", "actual", "error",
                   "volume_tier", "model_version", "recorded_at"]


def dedupe_history(history: DataFrame, order_col: str = "recorded_at") -> DataFrame:
    """One row per key, the latest recorded entry wins."""
    g = history.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in HISTORY_COLUMNS if c not in KEY]),
                                           F.col(order_col)).alias("r"))
    return g.select(*KEY, "r.*")


def record_forecasts(history: DataFrame, entries: DataFrame, recorded_at) -> DataFrame:
    """Upsert predictions (rounded half-even) by (store, product, date).

    ``entries``: ``store, product, date, predicted`` and optionally
    ``volume_tier`` / ``model_version`` (defaults ``unknown`` / ``v2``).
    Existing rows keep their actual and error.
    """
    ts = recorded_at if isinstance(recorded_at, Column) else F.lit(recorded_at)
    new = entries.select(
        *KEY, half_even(F.col("predicted"), 0).alias("n_pred"),
        (F.col("volume_tier") if "volume_tier" in entries.columns else F.lit("unknown")).alias("n_tier"),
        (F.col("model_version") if "model_version" in entries.columns else F.lit("v2")).alias("n_model"))
    # one row a key on either side: the latest record, the largest prediction
    new = new.groupBy(*KEY).agg(F.max_by(F.struct("n_pred", "n_tier", "n_model"), F.struct(
        "n_pred", "n_tier", "n_model")).alias("n")).select(*KEY, "n.*")
    history = dedupe_history(history)
    j = history.join(new, KEY, "full")
    hit = F.col("n_pred").isNotNull()
    return j.select(
        *KEY,
        F.when(hit, F.col("n_pred")).otherwise(F.col("predicted")).alias("predicted"),
        "actual", "error",
        F.when(hit, F.col("n_tier")).otherwise(F.col("volume_tier")).alias("volume_tier"),
        F.when(hit, F.col("n_model")).otherwise(F.col("model_version")).alias("model_version"),
        F.when(hit, ts.cast("timestamp_ntz")).otherwise(F.col("recorded_at")).alias("recorded_at"))


def match_actuals(history: DataFrame, actuals: DataFrame) -> DataFrame:
    """Fill actuals from sales.

    Matched key -> summed sales; no sale but date <= last sales date -> 0;
    later dates stay as they are.  Adds ``changed`` (actual differs from
    before, null-safe); ``error`` is re-rounded only on changed rows.
    """
    sums = actuals.groupBy(*KEY).agg(F.sum("qty").alias("_sold"))
    last_sale = F.lit(actuals.agg(F.max("date")).first()[0])
    j = history.join(sums, KEY, "left")
    new_actual = (F.when(F.col("_sold").isNotNull(), F.col("_sold"))
                   .when(F.col("date") <= last_sale, F.lit(0.0))
                   .otherwise(F.col("actual")))
    changed = ~new_actual.eqNullSafe(F.col("actual"))
    return j.select(
        *KEY, "predicted",
        new_actual.alias("actual"),
        F.when(changed, half_even(F.col("predicted") - new_actual, 2)).otherwise(F.col("error")).alias("error"),
        "volume_tier", "model_version", "recorded_at", changed.alias("changed"))


def correction_factors(history: DataFrame) -> DataFrame:
    """Σactual/Σpredicted over completed entries with actual > 0,
    groups of at least three, clipped to [0.5, 2], 3 decimals."""
    c = history.where(F.col("actual").isNotNull() & (F.col("actual") > 0))
    g = c.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("sa"),
                             F.sum("predicted").alias("sp"))
    g = g.where((F.col("n") >= C.CORRECTION_MIN_POINTS) & (F.col("sp") > 0))
    return g.select(*PAIR, half_even(clip(F.col("sa") / F.col("sp"), *C.CORRECTION_CLIP), 3)
                    .alias("factor"))


def confidence_scores(history: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Data, accuracy, stability, calibration -> weighted score, level."""
    factors = factors if factors is not None else correction_factors(history)
    c = history.where(F.col("actual").isNotNull())
    a, p = F.col("actual"), F.col("predicted")
    g = c.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(a - p)).alias("mae"),
                             F.avg(a).alias("avg_demand"), F.stddev_pop(a).alias("sd"))
    g = g.join(factors, PAIR, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    n, mae, avg = F.col("n"), F.col("mae"), F.col("avg_demand")
    sd = F.when(n > 1, F.col("sd")).otherwise(F.lit(0.0))
    cv = F.when(avg > 0, sd / avg).otherwise(F.lit(0.0))
    data = F.least(F.lit(100.0), n / 14.0 * 100)
    acc = F.when(avg > 0, F.greatest(F.lit(0.0), (1 - mae / avg) * 100)) \
           .otherwise(F.when(mae == 0, F.lit(50.0)).otherwise(F.lit(0.0)))
    stab = F.greatest(F.lit(0.0), (1 - F.least(cv, F.lit(2.0)) / 2) * 100)
    cal = F.greatest(F.lit(0.0), (1 - F.abs(F.col("factor") - 1)) * 100)
    w = C.CONFIDENCE_WEIGHTS
    score = data * w["data"] + acc * w["accuracy"] + stab * w["stability"] + cal * w["calibration"]
    level = (F.when(score >= C.CONFIDENCE_HIGH, F.lit("High"))
              .when(score >= C.CONFIDENCE_MEDIUM, F.lit("Medium")).otherwise(F.lit("Low")))
    return g.select(*PAIR, level.alias("confidence"), half_even(score, 1).alias("score"),
                    n.alias("data_points"), half_even(mae, 2).alias("avg_mae"),
                    half_even(avg, 2).alias("avg_demand"), half_even(cv, 2).alias("demand_cv"),
                    F.col("factor").alias("correction_factor"))


def accuracy_summary(history: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Per series forecasts, MAE, WMAPE, bias and correction factor."""
    factors = factors if factors is not None else correction_factors(history)
    c = history.where(F.col("actual").isNotNull())
    g = c.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("forecasts"),
                             *metric_columns("actual", "predicted"))
    g = g.join(factors, PAIR, "left")
    return g.select(*PAIR, "forecasts", "mae", "wmape", "bias",
                    F.coalesce("factor", F.lit(1.0)).alias("correction_factor"))


def forecast_vs_actual(history: DataFrame) -> DataFrame:
    """Per completed entry, integer predicted / actual and |difference|."""
    c = history.where(F.col("actual").isNotNull())
    p, a = F.col("predicted").cast("long"), F.col("actual").cast("long")
    return c.select("date", *PAIR, p.alias("predicted"), a.alias("actual"),
                    F.abs(p - a).alias("mae"))


def feedback_summary(history: DataFrame) -> DataFrame:
    """Entry counts and overall metrics over completed entries (one
    aggregate; pending rows have a null actual and drop out of every metric)."""
    done = F.col("actual").isNotNull()
    return history.agg(F.count(F.lit(1)).alias("total"), count_if(done).alias("completed"),
                       count_if(~done).alias("pending"), *metric_columns("actual", "predicted"))


def gap_rows(history: DataFrame, actuals_daily: DataFrame) -> DataFrame:
    """Days (store, product, date) not yet in the history, after the
    last covered date (from the first sales date when the history is empty).

    ``actuals_daily`` is the dense daily table: days without sales are gaps too."""
    last_covered = history.agg(F.max("date")).first()[0]
    if last_covered is None:
        start = F.lit(actuals_daily.agg(F.min("date")).first()[0])
        cond = F.col("date") >= start
    else:
        cond = F.col("date") > F.lit(last_covered)
    return (actuals_daily.where(cond)
                         .join(history.select(*KEY), KEY, "left_anti"))


def top_corrections(factors: DataFrame, k: int = 10) -> DataFrame:
    """A15 listing: the ``k`` factors furthest from 1 (a top-k report)."""
    return factors.orderBy(F.abs(F.col("factor") - 1).desc(), *PAIR).limit(k)


def confidence_order(scores: DataFrame, place: str = "place") -> DataFrame:
    """``place`` by score, highest first (then store and product); scores between two whole
    points are numbered apart, so no task sorts all series."""
    return bucketed_row_number(scores.withColumn("_all", F.lit(0)), ["_all"],
                               -F.floor(F.col("score")),
                               [F.col("score").desc(), *[F.col(c) for c in PAIR]], place).drop("_all")
