"""Hold-out backtest and accuracy metrics.

The backtest is one hold-out: the last ``test_days`` of the global calendar
(shortened when the history is short).  Lanes and models are fitted on the
training slice only, by running the same lane / DOW plans with the training
end date as their "last day"; the test rows are the zero-filled actuals.
Model columns come from pluggable predictors so the SQL-checkable DOW-only
configuration and the full DOW + Holt-Winters + GBT ensemble share one path.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import ProductConfig
from ..functions.numeric import half_even
from . import dow as DW
from ..functions.calendar import date_lit
from .demand import date_bound_values

KEYS = ["store", "product"]


# --------------------------------------------------------------------------
# D5 metrics
# --------------------------------------------------------------------------

def metric_columns(actual="actual", pred="pred") -> list[Column]:
    """MAE (2dp), MAPE over actual > 0 (1dp, null if none), WMAPE (1dp),
    bias = mean(pred - actual) (2dp), share within one unit (1dp)."""
    a, p = F.col(actual), F.col(pred)
    err = F.abs(a - p)
    return [
        half_even(F.avg(err), 2).alias("mae"),
        half_even(F.avg(F.when(a > 0, F.abs((a - p) / a))) * 100, 1).alias("mape"),
        half_even(F.sum(err) / F.greatest(F.sum(a), F.lit(1.0)) * 100, 1).alias("wmape"),
        half_even(F.avg(p - a), 2).alias("bias"),
        half_even(F.avg(F.when(err.isNotNull(), F.when(err <= 1, 1.0).otherwise(0.0))) * 100, 1)
        .alias("within_1"),
    ]


# --------------------------------------------------------------------------
# I23 hold-out backtest
# --------------------------------------------------------------------------

def holdout_dates(first: dt.date, last: dt.date, test_days: int = C.BACKTEST_TEST_DAYS):
    """(test_days, test_start) with the short-history rule."""
    history = (last - first).days
    if history < C.BACKTEST_MIN_TRAIN + test_days:
        test_days = max(1, history - C.BACKTEST_MIN_TRAIN)
    return test_days, last - dt.timedelta(days=test_days - 1)


Predictor = Callable[[DataFrame, Column, Column, int], DataFrame]


def dow_predictor(train: DataFrame, first: Column, train_last: Column, days: int) -> DataFrame:
    """DOW v2 fitted on the training slice: ``store, product, day_idx, pred_dow``."""
    f = DW.dow_forecast(train, 2, days, first, train_last)
    return f.select(*KEYS, "day_idx", F.col("pred").alias("pred_dow"))


def backtest(daily: DataFrame, test_days: int = C.BACKTEST_TEST_DAYS,
             product_config: ProductConfig | None = None,
             predictors: dict[str, Predictor] | None = None) -> DataFrame:
    """Rows ``store, product, date, actual, lane, pred_lane, pred_<model>``.

    ``pred_lane`` is the lane rate (2dp) for periodic / intermittent, 0 for
    dormant and null for daily; daily series get one ``pred_<model>``
    column per predictor (1dp).  Series with no demand at all, or fewer than
    seven training days, produce no rows.
    """
    predictors = predictors if predictors is not None else {"dow": dow_predictor}
    lo, hi = date_bound_values(daily)
    test_days, test_start = holdout_dates(lo, hi, test_days)
    train_last = test_start - dt.timedelta(days=1)
    if (train_last - lo).days + 1 < C.BACKTEST_MIN_TRAIN_ROWS:
        return _empty_backtest(daily, predictors)
    first, tlast = date_lit(lo), date_lit(train_last)

    # every series of the full calendar takes part (a series with no
    # training demand is routed dormant); a zero row keeps it in the plan
    pairs = daily.select(*KEYS).distinct()
    train = (daily.where(F.col("date") < F.lit(test_start))
                  .unionByName(pairs.select(*KEYS, first.alias("date"), F.lit(0.0).alias("qty"))))
    lf = DW.lane_forecast(train, product_config, test_days, first, tlast)
    totals = daily.groupBy(*KEYS).agg(F.sum("qty").alias("_tot"))
    lf = lf.join(totals.where(F.col("_tot") != 0).select(*KEYS), KEYS, "left_semi")
    test = daily.where(F.col("date") >= F.lit(test_start)).select(
        *KEYS, "date", F.col("qty").alias("_a"))
    rows = (lf.join(test, [*KEYS, "date"], "left")
              .withColumn("actual", F.coalesce(F.col("_a"), F.lit(0.0))))
    lane = F.col("lane")
    rows = rows.withColumn("pred_lane", F.when(lane == "daily", F.lit(None).cast("double"))
                           .otherwise(half_even(F.col("pred"), 2)))
    out = rows.select(*KEYS, "date", "day_idx", "actual", "lane", "pred_lane")
    for name, fn in predictors.items():
        p = fn(train, first, tlast, test_days)
        col = f"pred_{name}"
        out = out.join(p.select(*KEYS, "day_idx", half_even(F.col(col), 1).alias(col)),
                       [*KEYS, "day_idx"], "left")
        out = out.withColumn(col, F.when(lane == "daily", F.col(col)))
    return out.drop("day_idx")


def _empty_backtest(daily: DataFrame, predictors) -> DataFrame:
    cols = [F.lit(None).cast("string").alias("store"), F.lit(None).cast("string").alias("product"),
            F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("actual"),
            F.lit(None).cast("string").alias("lane"), F.lit(None).cast("double").alias("pred_lane")]
    cols += [F.lit(None).cast("double").alias(f"pred_{n}") for n in predictors]
    return daily.sparkSession.range(0).select(*cols)


# --------------------------------------------------------------------------
# I24 / I25 ensemble weights
# --------------------------------------------------------------------------

def _inverse_error(mae: Column) -> Column:
    return F.lit(1.0) / F.greatest(mae, F.lit(C.WEIGHT_ERROR_FLOOR))


def ensemble_weights(bt: DataFrame, models=("dow", "exp", "gbt")) -> DataFrame:
    """Global inverse-MAE weights on daily-lane rows (3dp, sum 1).

    Returns one row ``dow, exp, gbt``; defaults .33/.34/.33 without data.
    """
    d = bt.where((F.col("lane") == "daily") & F.col("pred_dow").isNotNull()
                 & F.col("pred_exp").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in models:
        col = F.col(f"pred_{m}")
        aggs += [half_even(F.avg(F.when(col.isNotNull(), F.abs(F.col("actual") - col))), 2).alias(f"mae_{m}"),
                 F.count(col).alias(f"n_{m}")]
    g = d.agg(*aggs)
    raw = {m: F.when(F.col(f"n_{m}") > 0, _inverse_error(F.col(f"mae_{m}"))).otherwise(F.lit(0.0))
           for m in models}
    if "gbt" in models:
        others = [raw[m] for m in models if m != "gbt"]
        raw["gbt"] = F.when(F.col("n_gbt") > 0, raw["gbt"]).otherwise(
            F.greatest(*others) * C.GBT_ABSENT_FACTOR if len(others) > 1 else others[0] * C.GBT_ABSENT_FACTOR)
    total = sum(raw.values(), F.lit(0.0))
    out = []
    for m in models:
        default = C.DEFAULT_WEIGHTS.get(m, 0.0)
        out.append(F.when(F.col("n") == 0, F.lit(default)).otherwise(half_even(raw[m] / total, 3)).alias(m))
    return g.select(*out)


def product_weights(bt: DataFrame, global_weights: dict,
                    min_obs: int = C.PER_PRODUCT_MIN_OBS) -> DataFrame:
    """Per-series inverse-MAE weights for daily series with >= min_obs
    rows; an absent GBT gets ``global_gbt * sum(local weights)``."""
    d = bt.where((F.col("lane") == "daily") & F.col("pred_dow").isNotNull()
                 & F.col("pred_exp").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in ("dow", "exp", "gbt"):
        col = F.col(f"pred_{m}")
        aggs += [half_even(F.avg(F.when(col.isNotNull(), F.abs(F.col("actual") - col))), 2).alias(f"mae_{m}"),
                 F.count(col).alias(f"n_{m}")]
    g = d.groupBy(*KEYS).agg(*aggs).where(F.col("n") >= min_obs)
    g = g.withColumn("g_gbt", F.lit(float(global_weights.get("gbt", C.DEFAULT_WEIGHTS["gbt"]))))
    w_dow = F.when(F.col("n_dow") > 0, _inverse_error(F.col("mae_dow"))).otherwise(0.0)
    w_exp = F.when(F.col("n_exp") > 0, _inverse_error(F.col("mae_exp"))).otherwise(0.0)
    w_gbt = F.when(F.col("n_gbt") > 0, _inverse_error(F.col("mae_gbt"))).otherwise(
        F.col("g_gbt") * (w_dow + w_exp))
    total = w_dow + w_exp + w_gbt
    return g.select(*KEYS, half_even(w_dow / total, 3).alias("dow"),
                    half_even(w_exp / total, 3).alias("exp"),
                    half_even(w_gbt / total, 3).alias("gbt"))


# --------------------------------------------------------------------------
# I26 accuracy report as DataFrames
# --------------------------------------------------------------------------

def fill_ensemble(bt: DataFrame, weights: dict | None = None,
                  per_product: DataFrame | None = None) -> DataFrame:
    """Daily-lane ``pred_lane`` = weighted mean of the available model
    columns, normalised by the weights of the models present."""
    weights = weights or C.DEFAULT_WEIGHTS
    models = [m for m in ("dow", "exp", "gbt") if f"pred_{m}" in bt.columns]
    df = bt
    if per_product is not None:
        pp = per_product.select(*KEYS, *[F.col(m).alias(f"_w_{m}") for m in ("dow", "exp", "gbt")])
        df = df.join(pp, KEYS, "left")
        w = {m: F.coalesce(F.col(f"_w_{m}"), F.lit(weights.get(m, 0.0))) for m in models}
    else:
        w = {m: F.lit(weights.get(m, 0.0)) for m in models}
    has_gbt = "gbt" in models
    if has_gbt:
        num = sum((w[m] * F.coalesce(F.col(f"pred_{m}"), F.lit(0.0)) if m == "gbt"
                   else w[m] * F.col(f"pred_{m}") for m in models), F.lit(0.0))
        den = (w.get("dow", F.lit(0.0)) + w.get("exp", F.lit(0.0)) + w["gbt"])
    else:
        num = sum((w[m] * F.col(f"pred_{m}") for m in models), F.lit(0.0))
        den = sum((w[m] for m in models), F.lit(0.0))
    ens = num / den
    out = df.withColumn("pred_lane", F.when(F.col("lane") == "daily", ens).otherwise(F.col("pred_lane")))
    return out.select(*bt.columns)


def _long(bt: DataFrame) -> DataFrame:
    """One row per (series, date, model) with the prediction used."""
    models = [m for m in ("dow", "exp", "gbt") if f"pred_{m}" in bt.columns]
    is_daily = F.col("lane") == "daily"
    entries = [F.struct(F.lit("ensemble").alias("model"), F.col("pred_lane").alias("pred"))]
    entries += [F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in models]
    arr = F.when(is_daily, F.array(*entries)).otherwise(
        F.array(F.struct(F.lit("lane").alias("model"), F.col("pred_lane").alias("pred"))))
    x = bt.select(*KEYS, "lane", "actual", F.explode(arr).alias("m"))
    return x.select(*KEYS, "lane", "actual", F.col("m.model").alias("model"),
                    F.col("m.pred").alias("pred")).where(F.col("pred").isNotNull())


def accuracy_report(bt_filled: DataFrame) -> DataFrame:
    """Metrics per (lane, model), overall non-dormant, per store.

    One GROUPING SETS aggregate over the long form; ``final`` marks the
    prediction that ships (ensemble for daily, lane rate otherwise).
    """
    lg = _long(bt_filled).withColumn(
        "final", F.col("model").isin("ensemble", "lane") & (F.col("lane") != "dormant"))
    g = lg.groupingSets(
        [["lane", "model"], ["final", "store"], ["final"]], "lane", "model", "final", "store"
    ).agg(F.count(F.lit(1)).alias("n"),
          F.countDistinct("store", "product").alias("products"),
          *metric_columns("actual", "pred"))
    scope = (F.when(F.col("lane").isNotNull(), F.lit("lane"))
              .when(F.col("store").isNotNull(), F.lit("store"))
              .otherwise(F.lit("overall")))
    g = g.where(F.col("lane").isNotNull() | F.col("final"))
    key = F.coalesce(F.col("lane"), F.col("store"), F.lit("all"))
    model = F.coalesce(F.col("model"), F.lit("final"))
    return g.select(scope.alias("scope"), key.alias("key"), model.alias("model"), "n",
                    "products", "mae", "mape", "wmape", "bias", "within_1")


def lane_distribution(bt: DataFrame) -> DataFrame:
    """Distinct series per lane."""
    return bt.groupBy("lane").agg(F.countDistinct("store", "product").alias("series"))


def worst_products(bt_filled: DataFrame, k: int = 10) -> DataFrame:
    """Non-dormant series with >= 2 actual units, top k by WMAPE."""
    a = bt_filled.where(F.col("lane") != "dormant")
    g = a.groupBy(*KEYS).agg(F.max("lane").alias("lane"), F.sum("actual").alias("total_actual"),
                             *metric_columns("actual", "pred_lane"))
    g = g.where(F.col("total_actual") >= 2)
    return g.orderBy(F.col("wmape").desc(), "store", "product").limit(k).select(
        *KEYS, "lane", "wmape", "mae", "total_actual")
