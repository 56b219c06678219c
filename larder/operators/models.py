"""Statistical and ML models for the daily lane.

* Holt-Winters (I17) is ``smoothing.holt_winters``: estimated parameters and
  initial states for many series at a time.
* Gradient boosting (I18, I19) is ``boosting``: Huber loss for quantities, log
  loss for the chance of an order.  One model for all stores at every size,
  with the store's mean quantity as a feature; ``mode="per_store"`` fits a
  model for each of a handful of stores instead.
* Day-by-day prediction (I20) is one pass over the series' states: a task
  holds a batch of series with their last 28 quantities and the model's
  arrays, predicts a day for all of them, appends it and goes on.
* Ensemble (I22): column arithmetic over the model predictions.
"""

from __future__ import annotations

import dataclasses
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..plans.materialize import materialize
from . import boosting
from .boosting import Ensemble, Params
from .features import MODEL_FEATURES
from .smoothing import forecast as _smoothed
from .smoothing import holt_winters

KEYS = ["store", "product"]
INPUTS = (*MODEL_FEATURES, "store_level")

# Gradient-boosting settings.
GBT_PARAMS = Params(trees=100, depth=4, rate=0.1, sample=0.8, min_leaf=3, loss="huber", alpha=0.9)
SPORADIC_CLS = Params(trees=50, depth=3, rate=0.1, sample=0.8, min_leaf=5, loss="log")
SPORADIC_REG = Params(trees=50, depth=3, rate=0.1, sample=0.8, min_leaf=3, loss="huber", alpha=0.9)
SPORADIC_THRESHOLD = 0.5


def holt_winters_forecast(y: np.ndarray, horizon: int) -> np.ndarray:
    """I17 for one series: ``horizon`` steps, floored at 0."""
    return _smoothed(np.asarray(y, dtype=float)[None], horizon)[0]


# --------------------------------------------------------------------------
# gradient boosting
# --------------------------------------------------------------------------

def _weight(weight_col: str | None) -> Column:
    return F.lit(1.0) if weight_col is None else F.col(weight_col)


def _row_key(rows: DataFrame) -> list[str]:
    """What names a row, for row sampling that does not depend on the input's layout."""
    return [c for c in (*KEYS, "date") if c in rows.columns]


def store_levels(train: DataFrame, weight_col: str | None, *conditions: Column) -> DataFrame:
    """``store, store_level``: the weighted mean quantity of stores with enough rows."""
    w = _weight(weight_col)
    enough = F.col("_n") >= C.GBT_MIN_ROWS
    for c in conditions:
        enough = enough & c
    levels = train.groupBy("store").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("qty") > 0).cast("int")).alias("_pos"),
        F.try_divide(F.sum(w * F.col("qty")), F.sum(w)).alias("store_level")).where(enough)
    return materialize(levels.select("store", "store_level"), "store-levels")


def _learned(rows: DataFrame, levels: DataFrame) -> DataFrame:
    return rows.drop("store_level").join(levels, "store")


def _inputs(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """``rows`` with their store's level; null where no model knows the store."""
    return rows.drop("store_level").join(levels, "store", "left")


def fit_gbt(train: DataFrame, weight_col: str | None = "weight", mode: str = "pooled",
            params: dict | None = None) -> dict:
    """One pooled model with the store's level as a feature, at every size.

    ``train``: complete feature rows with ``store``, ``qty`` and (optionally)
    a recency ``weight``.  Stores with fewer than 20 rows are not learned
    from.  ``mode="per_store"`` fits a model for every store instead, for
    callers with a handful of stores.  ``params`` overrides fields of
    ``GBT_PARAMS``.  Returns ``{"mode", "models": {store or "*": model},
    "stores": store levels}``.
    """
    params = dataclasses.replace(GBT_PARAMS, **(params or {}))
    levels = store_levels(train, weight_col)
    rows = _learned(train, levels)

    def one(own: DataFrame) -> Ensemble | None:
        return boosting.fit(own, INPUTS, F.col("qty"), _weight(weight_col), _row_key(train), params)
    if mode == "per_store":
        # independent Spark jobs, submitted from driver threads so that they overlap
        stores = [r["store"] for r in levels.orderBy("store").collect()]
        with ThreadPoolExecutor(max_workers=max(1, min(len(stores), 8))) as pool:
            found = pool.map(lambda s: (s, one(rows.where(F.col("store") == s))), stores)
            return {"mode": mode, "models": dict(found), "stores": levels}
    model = one(rows)
    return {"mode": mode, "models": {} if model is None else {"*": model}, "stores": levels}


def _quantity(fit: dict, columns: list[Column]) -> Column:
    """Predictions floored at 0; 0 for stores without a model."""
    known = F.col("store_level").isNotNull()
    out = F.lit(0.0)
    for store, model in fit["models"].items():
        own = known if store == "*" else known & (F.col("store") == store)
        out = F.when(own, F.greatest(F.lit(0.0), boosting.predicted(model, *columns))).otherwise(out)
    return out


def predict_gbt(fit: dict, rows: DataFrame, out_col: str = "pred_gbt") -> DataFrame:
    """Predictions floored at 0 (missing features as 0); stores without a
    model get 0.  ``rows`` keep their columns plus ``out_col``."""
    columns = [F.col(c) for c in INPUTS]
    return _inputs(rows, fit["stores"]).withColumn(out_col, _quantity(fit, columns)).select(
        *rows.columns, out_col)


def feature_importance(fit: dict) -> list[tuple[str, str, float]]:
    """(store, feature, importance) for every fitted model; a model's sum to 1."""
    return [(store, name, float(v)) for store, model in fit["models"].items()
            for name, v in zip(INPUTS, model.importance())]


def fit_sporadic(train: DataFrame, weight_col: str | None = "weight") -> dict:
    """P(qty > 0) classifier and regressor on non-zero rows, the store's level as a feature.

    Learns from stores with >= 20 rows, >= 3 rows without and >= 5 with sales.
    Returns ``{}`` when there are none, else both models and those stores'
    levels."""
    levels = store_levels(train, weight_col, F.col("_pos") >= 5,
                          F.col("_n") - F.col("_pos") >= 3)
    rows, sold = _learned(train, levels), F.col("qty") > 0

    def one(own, label, params):
        return boosting.fit(own, INPUTS, label, _weight(weight_col), _row_key(train), params)
    with ThreadPoolExecutor(max_workers=2) as pool:
        chance = pool.submit(one, rows, sold.cast("double"), SPORADIC_CLS)
        amount = pool.submit(one, rows.where(sold), F.col("qty"), SPORADIC_REG)
        chance, amount = chance.result(), amount.result()
    if chance is None or amount is None:
        return {}
    return {"classifier": chance, "regressor": amount, "stores": levels}


def two_stage(chance: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """The whole quantity where an order is likely, else its share by the chance."""
    amount = np.maximum(0.0, amount)
    return np.where(chance >= SPORADIC_THRESHOLD, amount, chance * amount)


def predict_sporadic(models: dict, rows: DataFrame, out_col: str = "pred_sporadic") -> DataFrame:
    """p >= 0.5 -> predicted quantity, else p x quantity; floored at 0.  Null for other stores."""
    if not models:
        return rows.withColumn(out_col, F.lit(None).cast("double"))
    columns = [F.col(c) for c in INPUTS]
    p = boosting.predicted(models["classifier"], *columns)
    q = F.greatest(F.lit(0.0), boosting.predicted(models["regressor"], *columns))
    value = F.when(p >= SPORADIC_THRESHOLD, q).otherwise(p * q)
    return _inputs(rows, models["stores"]).withColumn(
        out_col, F.when(F.col("store_level").isNotNull(), value)).select(*rows.columns, out_col)


# --------------------------------------------------------------------------
# ensemble
# --------------------------------------------------------------------------

def blend(weights: dict | None = None) -> Column:
    """w_dow*dow + w_exp*exp + w_gbt*gbt, floored at 0.  Per-series
    weight columns ``w_dow/w_exp/w_gbt`` win over the global ``weights``."""
    w = weights or C.DEFAULT_WEIGHTS
    def wc(m):
        return F.coalesce(F.col(f"w_{m}"), F.lit(float(w.get(m, 0.0))))
    p = (wc("dow") * F.coalesce("pred_dow", F.lit(0.0)) + wc("exp") * F.coalesce("pred_exp", F.lit(0.0))
         + wc("gbt") * F.coalesce("pred_gbt", F.lit(0.0)))
    return F.greatest(F.lit(0.0), p)


# --------------------------------------------------------------------------
# Day-by-day prediction in one pass
# --------------------------------------------------------------------------

TAIL = 28


def recursive_state(dense: DataFrame, last) -> DataFrame:
    """Per series: last <= 28 quantities, length, first value, days since the
    last order and its quantity, and the frozen whole-history statistics."""
    ago = F.datediff(last, F.col("date"))
    q = F.col("qty").cast("double")
    g = dense.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.when(ago < TAIL, F.struct("date", q.alias("qty"))))).alias("_t"),
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("total"), F.avg(q).alias("hist_avg"),
        F.stddev_samp(q).alias("hist_std"), F.avg((q > 0).cast("double")).alias("order_freq"),
        F.min_by(q, F.col("date")).alias("first_qty"), F.max(ago).alias("first_ago"),
        F.min(F.when(q > 0, ago)).alias("order_ago"),
        F.max_by(F.when(q > 0, q), F.when(q > 0, F.col("date"))).alias("loq"))
    cv = F.when(F.col("hist_avg") > 0, F.coalesce(F.col("hist_std"), F.lit(0.0)) / F.col("hist_avg")) \
          .otherwise(F.lit(0.0))
    return g.select(*KEYS, F.transform("_t", lambda x: x["qty"]).alias("buf"), "n", "total",
                    "hist_avg", F.greatest(F.lit(0.0), F.least(F.lit(10.0), cv)).alias("cv"),
                    "order_freq", "first_qty",
                    F.coalesce("order_ago", "first_ago").cast("double").alias("since"),
                    F.coalesce("loq", F.lit(0.0)).alias("last_order_qty"))


def _day_features(buf, n, since, order_qty, frozen, day) -> dict[str, np.ndarray]:
    """A day's model features of many series from their buffers (series, quantities)."""
    size, length = buf.shape
    recent = {k: buf[:, -k:] for k in (7, 14, 28)}
    mean = {k: v.mean(1) for k, v in recent.items()}
    std = {k: recent[k].std(1) if min(length, k) > 1 else np.zeros(size) for k in (7, 14)}
    with np.errstate(divide="ignore", invalid="ignore"):
        trend = np.where(mean[28] > 0, np.clip(mean[7] / mean[28], *C.TREND_7_28_CLIP), 1.0)

    def lag(k):
        return np.where(n >= k, buf[:, -min(k, length)], frozen["first_qty"])
    dow, dom, turn = day.weekday(), day.day, 2 * np.pi
    calendar = {
        "dow": dow, "day_of_month": dom, "is_weekend": dow >= 5, "is_monday": dow == 0,
        "is_friday": dow == 4, "dow_sin": np.sin(turn * dow / 7), "dow_cos": np.cos(turn * dow / 7),
        "dom_sin": np.sin(turn * dom / 31), "dom_cos": np.cos(turn * dom / 31)}
    return {
        **{k: np.full(size, float(v)) for k, v in calendar.items()},
        "lag_1": buf[:, -1], "lag_7": lag(7), "lag_14": lag(14),
        "rolling_mean_7": mean[7], "rolling_mean_14": mean[14], "rolling_mean_28": mean[28],
        "rolling_std_7": std[7], "rolling_std_14": std[14], "rolling_max_7": recent[7].max(1),
        "last_order_qty": order_qty, "trend_7_28": trend, "days_since_last_order": since,
        "product_hist_avg": frozen["hist_avg"], "product_cv": frozen["cv"],
        "order_frequency": frozen["order_freq"], "store_level": frozen["store_level"]}


def recurse(predict, state: pd.DataFrame, days: int) -> np.ndarray:
    """(series, days) predictions of ``predict(columns)``, each fed into the next day's features.

    Statistics of the whole history stay frozen; series without demand and
    stores without a model predict 0.
    """
    out = np.zeros((len(state), days))
    serves = ((state["total"] != 0) & state["store_level"].notna()).to_numpy()
    sizes = state["buf"].map(len).to_numpy()
    for size in np.unique(sizes[serves]):
        at = np.flatnonzero(serves & (sizes == size))
        own = state.iloc[at]
        buf = np.array(own["buf"].tolist(), float)
        frozen = {c: own[c].to_numpy(float) for c in (
            "first_qty", "hist_avg", "cv", "order_freq", "store_level")}
        n, since = own["n"].to_numpy(float), own["since"].to_numpy(float)
        order_qty = own["last_order_qty"].to_numpy(float)
        for i in range(days):
            since = since + 1
            day = own["last_date"].iloc[0] + pd.Timedelta(days=i + 1)
            features = _day_features(buf, n + i, since, order_qty, frozen, day)
            p = np.maximum(0.0, predict([features[c] for c in INPUTS]))
            out[at, i] = p
            buf = np.concatenate([buf, p[:, None]], axis=1)[:, -TAIL:]
            order_qty = np.where(p > 0, p, order_qty)
            since = np.where(p > 0, 0.0, since)
    return out


def _recursive(predictors: dict, stores: DataFrame, dense: DataFrame, last, days: int,
               out_col: str, only: DataFrame | None) -> DataFrame:
    """One pass: the states of all series and a predictor a store ("*": all stores)."""
    kinds = dict(dense.dtypes)
    rows = dense if only is None else dense.join(only.select(*KEYS), KEYS, "left_semi")
    state = recursive_state(rows, last).withColumn("last_date", last.cast("timestamp"))
    state = state.join(stores, "store", "left")

    def run(frames):
        for frame in frames:
            out = np.zeros((len(frame), days))
            for store, predict in predictors.items():
                at = np.flatnonzero((frame["store"] == store).to_numpy()) if store != "*" \
                    else np.arange(len(frame))
                out[at] = recurse(predict, frame.iloc[at], days)
            yield pd.DataFrame({
                "store": np.repeat(frame["store"].to_numpy(), days),
                "product": np.repeat(frame["product"].to_numpy(), days),
                "day_idx": np.tile(np.arange(days, dtype=np.int32), len(frame)),
                out_col: out.ravel()})

    found = state.mapInPandas(run, f"store {kinds['store']}, product {kinds['product']}, "
                                   f"day_idx int, {out_col} double")
    return found.select(*KEYS, "day_idx", F.date_add(last, F.col("day_idx") + 1).alias("date"), out_col)


def recursive_gbt(fit: dict, dense: DataFrame, last, days: int = C.HORIZON_DAYS,
                  only: DataFrame | None = None) -> DataFrame:
    """Day-by-day GBT forecast of every series, or those of ``only``; stores
    without a model and series without demand predict 0."""
    return _recursive({s: m.predict for s, m in fit["models"].items()}, fit["stores"], dense, last,
                      days, "pred_gbt", only)


def recursive_sporadic(models: dict, dense: DataFrame, last, days: int = C.HORIZON_DAYS,
                       only: DataFrame | None = None) -> DataFrame:
    """I19 + I20: the same recursion of the two-stage model; no rows for stores it does not know."""
    if not models:
        return dense.sparkSession.createDataFrame(
            [], f"store {dict(dense.dtypes)['store']}, product {dict(dense.dtypes)['product']}, "
                "day_idx int, date date, pred_sporadic double")
    chance, amount = models["classifier"].predict, models["regressor"].predict
    known = dense.join(models["stores"].select("store"), "store", "left_semi")
    return _recursive({"*": lambda columns: two_stage(chance(columns), amount(columns))},
                      models["stores"], known, last, days, "pred_sporadic", only)


__all__ = ["holt_winters", "holt_winters_forecast", "fit_gbt", "predict_gbt", "fit_sporadic",
           "predict_sporadic", "feature_importance", "blend", "recursive_gbt", "recursive_sporadic"]
