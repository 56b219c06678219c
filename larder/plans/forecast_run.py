"""The batch forecast run (K9): demand -> features -> backtest weights ->
lanes -> DOW + Holt-Winters + GBT ensemble -> corrections -> safety stock
-> whole units -> delivery schedule -> packing list.

Actions in the middle of the plan are limited to what sets a parameter:
the two calendar bounds, the store list (model layout) and the global
ensemble weights (three numbers).  Everything else is one lazy plan per
output; the daily table is materialised once.

With ``stages`` (``plans.stages.Stages``) the run can be killed and started
again: the daily table, the backtest, the learned models' predictions, the
blended predictions and the packing list are then kept by input version, and
a rerun goes on after the last one that was finished.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import ProductConfig
from ..functions.numeric import half_even
from ..operators import demand as DM
from ..operators import dow as DW
from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import lanes as LN
from ..operators import models as MD
from ..operators import packing as PK
from .materialize import materialize
from .stages import Scratch, Stages

KEYS = ["store", "product"]


@dataclass
class ForecastResult:
    predictions: DataFrame      # store, product, lane, model, day_idx, date, pred
    packing: DataFrame          # packing list rows (I15)
    weights: dict               # global ensemble weights
    backtest: DataFrame         # hold-out rows with model columns


def _daily_lane(lanes: DataFrame) -> DataFrame:
    return lanes.where(F.col("lane") == "daily").select(*KEYS)


def _train_grid(train: DataFrame, first, train_last) -> DataFrame:
    return DM.dense_demand(train.groupBy(*KEYS, "date").agg(F.sum("qty").alias("qty")),
                           first, train_last)


def gbt_predictor(product_config: ProductConfig | None = None):
    """Backtest predictor: GBT fitted to the training slice's daily-lane
    series, then day by day over the test days."""
    def predict(train: DataFrame, first, train_last, days: int) -> DataFrame:
        dense = materialize(_train_grid(train, first, train_last), "bt-dense")
        pairs = materialize(_daily_lane(LN.lanes(train, product_config, first, train_last)),
                            "bt-daily-pairs")
        fm = FT.complete_rows(FT.feature_matrix(dense.join(pairs, KEYS, "left_semi")))
        fit = MD.fit_gbt(materialize(FT.recency_weights(fm, ["store"]), "bt-gbt-train"))
        return MD.recursive_gbt(fit, dense, train_last, days, only=pairs).select(
            *KEYS, "day_idx", "pred_gbt")
    return predict


def exp_predictor(train: DataFrame, first, train_last, days: int,
                  product_config: ProductConfig | None = None) -> DataFrame:
    """Holt-Winters over the training slice, for the daily lane only."""
    pairs = _daily_lane(LN.lanes(train, product_config, first, train_last))
    return MD.holt_winters(_train_grid(train, first, train_last), train_last, days,
                           only=pairs).select(*KEYS, "day_idx", "pred_exp")


def predictors(product_config: ProductConfig | None = None, use_gbt: bool = True) -> dict:
    """The hold-out predictors of the ensemble, by model."""
    found = {"dow": EV.dow_predictor,
             "exp": lambda *args: exp_predictor(*args, product_config=product_config)}
    return found | ({"gbt": gbt_predictor(product_config)} if use_gbt else {})


def _learned(dense: DataFrame, pairs: DataFrame, tiers: DataFrame, last,
             days: int) -> DataFrame:
    """``pred_gbt`` of the daily-lane series ``pairs``, day by day, and ``pred_sporadic`` of
    the two-stage model for those of the sporadic tier.  The models' Spark jobs overlap."""
    features = FT.complete_rows(FT.feature_matrix(dense.join(pairs, KEYS, "left_semi")))
    train = materialize(FT.recency_weights(features, ["store"]), "gbt-train")
    rare = materialize(pairs.join(tiers.where(F.col("volume_tier") == "sporadic"), KEYS,
                                  "left_semi"), "sporadic-pairs")
    rare_train = materialize(FT.recency_weights(
        train.drop("weight").join(rare, KEYS, "left_semi"), ["store"]), "sporadic-train")
    with ThreadPoolExecutor(max_workers=2) as pool:
        gbt, sporadic = pool.submit(MD.fit_gbt, train), pool.submit(MD.fit_sporadic, rare_train)
        gbt, sporadic = gbt.result(), sporadic.result()
    return (MD.recursive_gbt(gbt, dense, last, days, only=pairs).select(*KEYS, "day_idx", "pred_gbt")
            .join(MD.recursive_sporadic(sporadic, dense, last, days, only=rare).select(
                *KEYS, "day_idx", "pred_sporadic"), [*KEYS, "day_idx"], "left"))


def run_forecast(lines: DataFrame, product_config: ProductConfig | None = None,
                 par_levels: DataFrame | None = None, corrections: DataFrame | None = None,
                 days: int = C.HORIZON_DAYS, use_gbt: bool = True,
                 stages: Stages | None = None) -> ForecastResult:
    """The whole run.  ``stages``: where finished stages are kept for a rerun; its version
    must tell the lines, par levels, corrections and parameters apart (``input_version``)."""
    pc = product_config or ProductConfig()
    run = stages or Scratch()
    daily = run.table("daily", lambda: DM.daily_demand(lines))
    lo, hi = DM.date_bound_values(daily)
    first, last = F.lit(lo), F.lit(hi)

    bt = run.table("backtest", lambda: EV.backtest(daily, C.BACKTEST_TEST_DAYS, pc,
                                                   predictors(pc, use_gbt)))
    models = ("dow", "exp", "gbt") if use_gbt else ("dow", "exp")
    wrow = EV.ensemble_weights(bt, models).first()
    weights = {m: float(wrow[m]) for m in models}
    weights.setdefault("gbt", 0.0)
    per_product = EV.product_weights(bt, weights) if use_gbt else None

    predictions = lambda: _predictions(                                    # noqa: E731
        run, daily, pc, first, last, days, use_gbt, weights, per_product, corrections)
    safe = run.table("predictions", predictions) if stages else predictions()
    lstats = LN.lanes(daily, pc, first, last)
    sched = PK.delivery_schedule(lstats, days)
    packing = lambda: PK.packing_list(PK.packing_quantities(               # noqa: E731
        safe.select(*KEYS, "lane", "day_idx", "date", "pred"), sched), par_levels)
    plist = run.table("packing", packing) if stages else packing()
    return ForecastResult(predictions=safe, packing=plist, weights=weights, backtest=bt)


def _predictions(run, daily: DataFrame, pc: ProductConfig, first, last, days: int, use_gbt: bool,
                 weights: dict, per_product: DataFrame | None,
                 corrections: DataFrame | None) -> DataFrame:
    """Lane, ensemble and sporadic predictions, corrected, with safety stock."""
    dense = run.table("dense", lambda: DM.dense_demand(daily, first, last))
    base = DW.lane_forecast(daily, pc, days, first, last)          # lane + DOW preds
    preds = base.withColumnRenamed("pred", "pred_lane_or_dow")
    daily_pairs = run.table("daily-pairs", lambda: _daily_lane(LN.lanes(daily, pc, first, last)))
    hw = MD.holt_winters(dense, last, days, only=daily_pairs).select(*KEYS, "day_idx", "pred_exp")
    preds = preds.join(hw, [*KEYS, "day_idx"], "left")

    tiers = FT.volume_tiers(dense).select(*KEYS, "volume_tier")
    preds = preds.join(tiers, KEYS, "left")
    if use_gbt:
        learned = run.table("learned", lambda: _learned(dense, daily_pairs, tiers, last, days))
        preds = preds.join(learned, [*KEYS, "day_idx"], "left")
    else:
        preds = preds.withColumn("pred_gbt", F.lit(0.0)).withColumn("pred_sporadic", F.lit(None).cast("double"))

    if per_product is not None:
        preds = preds.join(per_product.select(*KEYS, F.col("dow").alias("w_dow"),
                                              F.col("exp").alias("w_exp"),
                                              F.col("gbt").alias("w_gbt")), KEYS, "left")
    else:
        preds = preds.withColumns({"w_dow": F.lit(None).cast("double"),
                                   "w_exp": F.lit(None).cast("double"),
                                   "w_gbt": F.lit(None).cast("double")})
    preds = preds.withColumn("pred_dow", F.col("pred_lane_or_dow"))
    if corrections is not None:
        preds = preds.join(corrections.select(*KEYS, "factor"), KEYS, "left")
    else:
        preds = preds.withColumn("factor", F.lit(None).cast("double"))

    lane = F.col("lane")
    use_spor = (F.col("volume_tier") == "sporadic") & F.col("pred_sporadic").isNotNull()
    daily_pred = F.when(use_spor, F.col("pred_sporadic")).otherwise(MD.blend(weights))
    daily_pred = F.greatest(F.lit(0.0), daily_pred) * F.coalesce(F.col("factor"), F.lit(1.0))
    pred = F.when(lane == "daily", daily_pred).otherwise(F.col("pred_lane_or_dow"))
    model = (F.when(lane == "dormant", F.lit("dormant"))
              .when(lane == "intermittent", F.lit("intermittent_v1"))
              .when(lane == "periodic", F.lit("periodic_v1"))
              .when(use_spor, F.lit("sporadic_v1")).otherwise(F.lit("ensemble_v2")))
    out = preds.select(*KEYS, "lane", model.alias("model"), "volume_tier", "day_idx", "date",
                       pred.alias("pred"))

    stats = PK.series_stats(daily, first, last)
    return PK.apply_safety_stock(out, stats, pc)


def forecast_dates(last: dt.date, days: int = C.HORIZON_DAYS) -> list[dt.date]:
    return [last + dt.timedelta(days=i + 1) for i in range(days)]


def rounded_history_entries(result: ForecastResult) -> DataFrame:
    """Whole-unit predictions to record in the history (post safety stock,
    before scheduling), with tier and model metadata."""
    p = result.predictions
    return p.select(*KEYS, "date", half_even(F.col("pred"), 0).alias("predicted"),
                    "volume_tier", F.col("model").alias("model_version"))


def backfill(history: DataFrame, daily: DataFrame, weights: dict | None = None,
             product_config: ProductConfig | None = None, use_gbt: bool = True) -> DataFrame:
    """Predictions for sales days missing from the history, as the
    model would have made them before the first gap day.

    Gap rows come from C12 over the dense daily table, so days without sales
    are filled in too.  Lanes use the full history (the run looks back); the
    flat rates and the DOW and Holt-Winters fits of a series use its days
    before the first gap.  GBT and the sporadic model learn from all series
    and dates.  ``weights``: the hold-out weights of the full history unless
    given.  No corrections or safety stock.  Returns the new history rows
    (``model_version = v2_backfill``) with actual and error filled.
    """
    from ..operators import feedback as FB
    lo, hi = DM.date_bound_values(daily)
    first, last = F.lit(lo), F.lit(hi)
    dense = materialize(DM.dense_demand(daily, first, last), "backfill-dense")
    gaps = FB.gap_rows(history, dense.select(*KEYS, "date", "qty"))
    gap_start = gaps.agg(F.min("date")).first()[0]
    if gap_start is None:
        return history.limit(0)
    days = (hi - gap_start).days + 1
    tlast = F.lit(gap_start - dt.timedelta(days=1))
    if weights is None:
        models = ("dow", "exp", "gbt") if use_gbt else ("dow", "exp")
        row = EV.ensemble_weights(EV.backtest(
            daily, C.BACKTEST_TEST_DAYS, product_config, predictors(product_config, use_gbt)),
            models).first()
        weights = {"gbt": 0.0} | {m: float(row[m]) for m in models}
    pairs = daily.select(*KEYS).distinct()
    train = (daily.select(*KEYS, "date", "qty").where(F.col("date") < F.lit(gap_start))
                  .unionByName(pairs.select(*KEYS, first.alias("date"), F.lit(0.0).alias("qty")))
                  .groupBy(*KEYS, "date").agg(F.sum("qty").alias("qty")))
    lane_of = LN.lanes(daily, product_config, first, last).select(*KEYS, "lane")
    rates = LN.window_stats(train, first, tlast).select(
        *KEYS, LN.intermittent_rate().alias("rate_i"), LN.periodic_rate().alias("rate_p"))
    preds = DW.dow_forecast(train, 2, days, first, tlast).withColumnRenamed("pred", "pred_dow")
    smoothed = MD.holt_winters(_train_grid(train, first, tlast), tlast, days,
                               only=_daily_lane(lane_of))
    preds = preds.join(smoothed.select(*KEYS, "day_idx", "pred_exp"), [*KEYS, "day_idx"], "left")
    tiers = FT.volume_tiers(dense).select(*KEYS, "volume_tier")
    if use_gbt:
        rows = materialize(FT.recency_weights(FT.complete_rows(FT.feature_matrix(dense)),
                                              ["store"]), "backfill-train")
        future = FT.future_features(dense.where(F.col("date") < F.lit(gap_start)), days)
        gbt = MD.predict_gbt(MD.fit_gbt(rows), future).select(*KEYS, "day_idx", "pred_gbt")
        rare = rows.join(tiers.where(F.col("volume_tier") == "sporadic"), KEYS, "left_semi")
        spor = MD.predict_sporadic(MD.fit_sporadic(rare), future).select(
            *KEYS, "day_idx", "pred_sporadic")
        preds = preds.join(gbt, [*KEYS, "day_idx"], "left").join(spor, [*KEYS, "day_idx"], "left")
    else:
        preds = preds.withColumn("pred_gbt", F.lit(0.0)).withColumn(
            "pred_sporadic", F.lit(None).cast("double"))
    none = F.lit(None).cast("double")
    preds = preds.withColumns({"w_dow": none, "w_exp": none, "w_gbt": none})
    preds = preds.join(lane_of, KEYS).join(tiers, KEYS, "left").join(rates, KEYS, "left")
    lane = F.col("lane")
    sporadic = (F.col("volume_tier") == "sporadic") & F.col("pred_sporadic").isNotNull()
    pred = (F.when(lane == "dormant", F.lit(0.0))
             .when(lane == "intermittent", F.coalesce("rate_i", F.lit(0.0)))
             .when(lane == "periodic", F.coalesce("rate_p", F.lit(0.0)))
             .when(sporadic, F.greatest(F.lit(0.0), F.col("pred_sporadic")))
             .otherwise(MD.blend(weights)))
    p = preds.select(*KEYS, "date", "volume_tier", half_even(pred, 2).alias("predicted"))
    return gaps.join(p, [*KEYS, "date"]).select(
        *KEYS, "date", "predicted", half_even(F.col("qty"), 2).alias("actual"),
        half_even(F.col("predicted") - F.col("qty"), 2).alias("error"), "volume_tier",
        F.lit("v2_backfill").alias("model_version"),
        F.col("date").cast("timestamp_ntz").alias("recorded_at"))
