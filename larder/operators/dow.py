"""Day-of-week models (D8, D9, D10, I5, I5b) and the lane forecast.

Both DOW models are computed from ONE aggregate per series over the sparse
daily table.  Zero-filled days add nothing to a numerator, and every series
spans the same global calendar, so the per-weekday denominators (day counts
or sums of decay weights) are seven numbers shared by every series.  They
come from a generated calendar of at most (last - first + 1) days and are
passed to the per-series plan as two literal arrays.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import ProductConfig
from ..functions.calendar import dow, lit_value
from ..functions.numeric import clip
from . import lanes as L
from .demand import date_bounds


def calendar_weights(daily: DataFrame, first: Column, last: Column,
                     decay: float = C.DOW_DECAY) -> tuple[Column, Column]:
    """Per-weekday day counts and decay-weight sums over the global calendar.

    These depend only on the two bounds, so they are computed from a
    generated calendar of (last - first + 1) rows and returned as literal
    arrays of seven numbers.
    """
    lo, hi = lit_value(first), lit_value(last)
    if lo is not None and hi is not None:
        days = [lo + dt.timedelta(days=i) for i in range((hi - lo).days + 1)]
        cnt = [float(sum(1 for d in days if d.weekday() == k)) for k in range(7)]
        wts = [math.fsum(decay ** (hi - d).days for d in days if d.weekday() == k) for k in range(7)]
        return (F.array(*[F.lit(x) for x in cnt]), F.array(*[F.lit(x) for x in wts]))
    cal = daily.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    w = F.pow(F.lit(decay), F.datediff(last, F.col("date")))
    d = dow("date")
    row = cal.agg(F.array(*[F.sum(F.when(d == k, 1.0).otherwise(0.0)) for k in range(7)]).alias("c"),
                  F.array(*[F.sum(F.when(d == k, w).otherwise(0.0)) for k in range(7)]).alias("w")
                  ).first()
    return (F.array(*[F.lit(float(x)) for x in row["c"]]),
            F.array(*[F.lit(float(x)) for x in row["w"]]))


def dow_aggs(last: Column, decay: float = C.DOW_DECAY) -> list[Column]:
    days_ago = F.datediff(last, F.col("date"))
    w = F.pow(F.lit(decay), days_ago)
    d = dow("date")
    q = F.col("qty")
    return ([F.sum(F.when(d == k, q * w).otherwise(0.0)).alias(f"wq{k}") for k in range(7)]
            + [F.sum(F.when(d == k, q).otherwise(0.0)).alias(f"q{k}") for k in range(7)]
            + [F.sum(F.when(days_ago <= C.DOW_RECENT_DAYS, q).otherwise(0.0)).alias("recent_v2"),
               F.sum(F.when(days_ago < C.V1_TREND_DAYS, q).otherwise(0.0)).alias("recent_v1"),
               F.sum(q).alias("total_qty")])


def series_summary(daily: DataFrame, first: Column | None = None,
                   last: Column | None = None) -> DataFrame:
    """One row per series with lane-window and DOW aggregates (one shuffle)."""
    if first is None or last is None:
        first, last = date_bounds(daily)
    g = daily.groupBy("store", "product").agg(*L.window_aggs(last), *dow_aggs(last))
    g = g.withColumn("series_days", (F.datediff(last, first) + 1).cast("long"))
    return g.withColumns(L.window_columns(F.col("series_days")))


def _trend(recent_sum: Column, recent_days: int) -> Column:
    n = F.col("series_days")
    mean_all = F.col("total_qty") / n
    mean_recent = recent_sum / F.least(F.lit(recent_days), n)
    return F.when(mean_all > 0, clip(mean_recent / mean_all, *C.DOW_TREND_CLIP)).otherwise(1.0)


def dow_profile_columns(version: int, counts: Column, weights: Column) -> dict[str, Column]:
    """``dow_avg`` array (Mon..Sun) and ``trend`` for DOW model v1 or v2."""
    if version == 2:
        avg = [F.coalesce(F.try_divide(F.col(f"wq{k}"),
                                       F.when(F.element_at(weights, k + 1) > 0,
                                              F.element_at(weights, k + 1))), F.lit(0.0))
               for k in range(7)]
        trend = _trend(F.col("recent_v2"), C.DOW_RECENT_DAYS + 1)
    else:
        avg = [F.coalesce(F.try_divide(F.col(f"q{k}"),
                                       F.when(F.element_at(counts, k + 1) > 0,
                                              F.element_at(counts, k + 1))), F.lit(0.0))
               for k in range(7)]
        trend = _trend(F.col("recent_v1"), C.V1_TREND_DAYS)
    zero = F.col("total_qty") == 0
    return {"dow_avg": F.when(zero, F.array_repeat(F.lit(0.0), 7)).otherwise(F.array(*avg)),
            "trend": F.when(zero, F.lit(1.0)).otherwise(trend)}


def _horizon(last: Column, days: int) -> Column:
    return F.posexplode(F.sequence(F.date_add(last, 1), F.date_add(last, days)))


def dow_forecast(daily: DataFrame, version: int = 2, days: int = C.HORIZON_DAYS,
                 first: Column | None = None, last: Column | None = None) -> DataFrame:
    """I5 (v2, decayed profile, floored at 0) or I5b (v1, plain profile)."""
    if first is None or last is None:
        first, last = date_bounds(daily)
    counts, weights = calendar_weights(daily, first, last)
    s = series_summary(daily, first, last).withColumns(
        dow_profile_columns(version, counts, weights))
    h = s.select("store", "product", "dow_avg", "trend", _horizon(last, days))
    pred = F.element_at(F.col("dow_avg"), dow("col") + 1) * F.col("trend")
    if version == 2:
        pred = F.greatest(F.lit(0.0), pred)
    return h.select("store", "product", F.col("pos").cast("int").alias("day_idx"),
                    F.col("col").alias("date"), pred.alias("pred"))


def dow_profile(daily: DataFrame, version: int = 2) -> DataFrame:
    """D8/D9 + D10: ``store, product, dow, dow_avg, trend`` rows."""
    first, last = date_bounds(daily)
    counts, weights = calendar_weights(daily, first, last)
    s = series_summary(daily, first, last).withColumns(
        dow_profile_columns(version, counts, weights))
    return s.select("store", "product", "trend",
                    F.posexplode("dow_avg").alias("dow", "dow_avg")) \
            .select("store", "product", F.col("dow").cast("int"), "dow_avg", "trend")


def lane_forecast(daily: DataFrame, product_config: ProductConfig | None = None,
                  days: int = C.HORIZON_DAYS, first: Column | None = None,
                  last: Column | None = None) -> DataFrame:
    """Lane routing + flat lane rates + DOW v2 for the daily lane.

    One aggregate over the daily table feeds both the router and the DOW
    model; the horizon is a per-series generator (14 rows per series).
    """
    if first is None or last is None:
        first, last = date_bounds(daily)
    counts, weights = calendar_weights(daily, first, last)
    s = series_summary(daily, first, last)
    s = L.classify_lanes(s, product_config).withColumns(dow_profile_columns(2, counts, weights))
    rate = (F.when(F.col("lane") == "intermittent", L.intermittent_rate())
             .when(F.col("lane") == "periodic", L.periodic_rate())
             .otherwise(F.lit(0.0)))
    s = s.withColumn("lane_rate", rate)
    h = s.select("store", "product", "lane", "lane_rate", "dow_avg", "trend",
                 _horizon(last, days))
    dow_pred = F.greatest(F.lit(0.0), F.element_at(F.col("dow_avg"), dow("col") + 1) * F.col("trend"))
    pred = F.when(F.col("lane") == "daily", dow_pred).otherwise(F.col("lane_rate"))
    return h.select("store", "product", "lane", F.col("pos").cast("int").alias("day_idx"),
                    F.col("col").alias("date"), pred.alias("pred"))
