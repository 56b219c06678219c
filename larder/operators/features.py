"""Feature engineering on the dense daily grid.

All row-level windows share ``partitionBy(store, product).orderBy(date)``
and are projected in one ``select``, so Catalyst plans a single exchange
and a single sort for the whole feature matrix.  A series is at most the
number of calendar days long, so no window partition can grow with the
data volume.  Whole-series statistics use the same partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.calendar import calendar_columns
from ..functions.numeric import clip



def series_window():
    return Window.partitionBy("store", "product")


def ordered_window():
    return series_window().orderBy("date")


def past_window():
    return ordered_window().rowsBetween(Window.unboundedPreceding, -1)

MODEL_FEATURES = (
    "dow", "day_of_month", "is_weekend", "is_monday", "is_friday",
    "dow_sin", "dow_cos", "dom_sin", "dom_cos",
    "lag_1", "lag_7", "lag_14",
    "rolling_mean_7", "rolling_mean_14", "rolling_mean_28",
    "rolling_std_7", "rolling_std_14",
    "rolling_max_7",
    "last_order_qty",
    "trend_7_28",
    "days_since_last_order",
    "product_hist_avg", "product_cv", "order_frequency",
)


def prev(n: int):
    return ordered_window().rowsBetween(-n, -1)


def lag_columns() -> dict[str, Column]:
    q = F.col("qty")
    out = {f"lag_{k}": F.lag(q, k).over(ordered_window()) for k in (1, 7, 14)}
    for n in (7, 14, 28):
        out[f"rolling_mean_{n}"] = F.avg(q).over(prev(n))
        out[f"rolling_std_{n}"] = F.stddev_samp(q).over(prev(n))
    out["rolling_max_7"] = F.max(q).over(prev(7))
    return out


def recency_columns() -> dict[str, Column]:
    q = F.col("qty")
    rm7, rm28 = F.avg(q).over(prev(7)), F.avg(q).over(prev(28))
    ratio = F.coalesce(F.try_divide(rm7, F.when(rm28 != 0, rm28)), F.lit(1.0))
    last_order_day = F.max(F.when(q > 0, F.col("date"))).over(past_window())
    return {
        "last_order_qty": F.coalesce(F.last(F.when(q != 0, q), ignorenulls=True).over(past_window()),
                                     F.lit(0.0)),
        "trend_7_28": clip(ratio, *C.TREND_7_28_CLIP),
        "days_since_last_order": F.coalesce(F.datediff(F.col("date"), last_order_day), F.lit(0)),
    }


def tier(avg: Column) -> Column:
    """Volume tier from the average daily demand."""
    return (F.when(avg >= C.TIER_HIGH_MIN, F.lit("high"))
             .when(avg >= C.TIER_LOW_MIN, F.lit("low"))
             .otherwise(F.lit("sporadic")))


def product_columns() -> dict[str, Column]:
    q = F.col("qty")
    avg = F.avg(q).over(series_window())
    std = F.coalesce(F.stddev_samp(q).over(series_window()), F.lit(0.0))
    cv = F.coalesce(F.try_divide(std, F.when(avg != 0, avg)), F.lit(0.0))
    return {
        "product_hist_avg": avg,
        "product_cv": clip(cv, *C.PRODUCT_CV_CLIP),
        "order_frequency": F.avg((q > 0).cast("double")).over(series_window()),
        "volume_tier": tier(avg),
    }


def feature_matrix(dense: DataFrame) -> DataFrame:
    """Full feature matrix: calendar, lags, rolling, recency, product, tier."""
    cols = {**calendar_columns("date"), **lag_columns(), **recency_columns(),
            **product_columns()}
    return dense.select("store", "product", "date", "qty",
                        *[c.alias(n) for n, c in cols.items()])


def complete_rows(features: DataFrame) -> DataFrame:
    """Rows with every model feature present (training rows)."""
    return features.dropna(subset=list(MODEL_FEATURES))


def add_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumns(calendar_columns(date_col))


def product_stats(dense: DataFrame) -> DataFrame:
    """D6 + D7 as one row per series (hash aggregate, no window)."""
    q = F.col("qty")
    g = dense.groupBy("store", "product").agg(
        F.avg(q).alias("a"), F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("sd"),
        F.avg((q > 0).cast("double")).alias("order_frequency"))
    cv = F.coalesce(F.try_divide(F.col("sd"), F.when(F.col("a") != 0, F.col("a"))), F.lit(0.0))
    return g.select("store", "product", F.col("a").alias("product_hist_avg"),
                    clip(cv, *C.PRODUCT_CV_CLIP).alias("product_cv"), "order_frequency",
                    tier(F.col("a")).alias("volume_tier"))


def volume_tiers(daily_dense: DataFrame) -> DataFrame:
    """D7 tier map: one row per series."""
    g = daily_dense.groupBy("store", "product").agg(F.avg("qty").alias("avg_demand"))
    return g.withColumn("volume_tier", tier(F.col("avg_demand")))


def recency_weights(rows: DataFrame, group_cols=("store",),
                    half_life: int = C.RECENCY_HALF_LIFE) -> DataFrame:
    """exp(-ln2/half_life * days before the group's last date), scaled
    so the weights of a training group sum to its row count.

    The weights come from a (group, date) pre-aggregate — a hash aggregate
    with partial combine, one row a group and day — joined back on group and
    date, so a store holding a third of all rows is spread over its days.
    """
    gcols = list(group_cols)
    if half_life <= 0:
        return rows.withColumn("weight", F.lit(1.0))
    k = math.log(2) / half_life
    per_day = rows.groupBy(*gcols, "date").agg(F.count(F.lit(1)).alias("_c"))
    last = per_day.groupBy(*gcols).agg(F.max("date").alias("_last"))
    tot = (per_day.join(last, gcols)
                  .groupBy(*gcols, "_last")
                  .agg(F.sum(F.col("_c") * F.exp(F.lit(-k) * F.datediff("_last", "date")))
                       .alias("_wsum"), F.sum("_c").alias("_n")))
    w = F.exp(F.lit(-k) * F.datediff("_last", "date"))
    weights = per_day.join(tot, gcols).select(
        *gcols, "date", (w * F.col("_n") / F.col("_wsum")).alias("weight"))
    return rows.join(weights, [*gcols, "date"])


def tail_stats(dense: DataFrame, last: Column | None = None) -> DataFrame:
    """Per series the tail statistics used for static future features.

    Rows are numbered from the end by ``datediff(last, date)`` — the grid is
    dense — so one hash aggregate replaces sorting each series.
    """
    if last is None:
        last = F.lit(dense.agg(F.max("date")).first()[0])
    ago = F.datediff(last, F.col("date"))
    q = F.col("qty")

    def tail(n):
        return ago < n

    return dense.groupBy("store", "product").agg(
        F.sum(q).alias("total_qty"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(q).alias("hist_avg"),
        F.stddev_samp(q).alias("hist_std"),
        F.avg((q > 0).cast("double")).alias("order_freq"),
        F.max(F.when(ago == 0, q)).alias("last_qty"),
        F.avg(F.when(tail(7), q)).alias("rm7"),
        F.avg(F.when(tail(14), q)).alias("rm14"),
        F.avg(F.when(tail(28), q)).alias("rm28"),
        F.stddev_samp(F.when(tail(7), q)).alias("rs7"),
        F.stddev_samp(F.when(tail(14), q)).alias("rs14"),
        F.max(F.when(tail(7), q)).alias("rmax7"),
        F.min("date").alias("first_date"),
        F.max(F.when(q > 0, F.col("date"))).alias("last_order_date"),
        F.max_by(F.when(q > 0, q), F.when(q > 0, F.col("date"))).alias("last_order_qty"),
        F.max(F.when(ago == 6, q)).alias("q_ago6"),
        F.max(F.when(ago == 13, q)).alias("q_ago13"),
    )


def future_features(dense: DataFrame, days: int = C.HORIZON_DAYS) -> DataFrame:
    """Static feature rows for the horizon (lags frozen at the last day).

    Series with zero total demand get no rows.  ``lag_7``/``lag_14`` are the
    first values of the last 7/14 rows (the series' first value when shorter).
    """
    row = dense.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    first_day, last = F.lit(row["lo"]), F.lit(row["hi"])
    t = tail_stats(dense, last)
    first_q = dense.where(F.col("date") == first_day).select(
        "store", "product", F.col("qty").alias("first_qty"))
    t = t.join(first_q, ["store", "product"]).where(F.col("total_qty") != 0)
    n = F.col("n_rows")
    lag7 = F.when(n >= 7, F.col("q_ago6")).otherwise(F.col("first_qty"))
    lag14 = F.when(n >= 14, F.col("q_ago13")).otherwise(F.col("first_qty"))
    cv = F.when(F.col("hist_avg") > 0,
                F.coalesce(F.col("hist_std"), F.lit(0.0)) / F.col("hist_avg")).otherwise(0.0)
    trend = F.when(F.col("rm28") > 0, F.col("rm7") / F.col("rm28")).otherwise(1.0)
    h = t.select("*", F.posexplode(F.sequence(F.date_add(last, 1),
                                              F.date_add(last, days))).alias("day_idx", "date"))
    cal = calendar_columns("date")
    last_order = F.coalesce(F.col("last_order_date"), F.col("first_date"))
    return h.select(
        "store", "product", F.col("day_idx").cast("int"), "date",
        *[cal[c].alias(c) for c in ("dow", "day_of_month", "is_weekend", "is_monday",
                                    "is_friday", "dow_sin", "dow_cos", "dom_sin", "dom_cos")],
        F.col("last_qty").alias("lag_1"), lag7.alias("lag_7"), lag14.alias("lag_14"),
        F.col("rm7").alias("rolling_mean_7"), F.col("rm14").alias("rolling_mean_14"),
        F.col("rm28").alias("rolling_mean_28"),
        F.coalesce(F.col("rs7"), F.lit(0.0)).alias("rolling_std_7"),
        F.coalesce(F.col("rs14"), F.lit(0.0)).alias("rolling_std_14"),
        F.col("rmax7").alias("rolling_max_7"),
        F.coalesce(F.col("last_order_qty"), F.lit(0.0)).alias("last_order_qty"),
        clip(trend, *C.TREND_7_28_CLIP).alias("trend_7_28"),
        F.datediff(F.col("date"), last_order).alias("days_since_last_order"),
        F.col("hist_avg").alias("product_hist_avg"),
        clip(cv, *C.PRODUCT_CV_CLIP).alias("product_cv"),
        F.col("order_freq").alias("order_frequency"))


__all__ = ["feature_matrix", "complete_rows", "volume_tiers", "recency_weights",
           "tail_stats", "future_features", "MODEL_FEATURES"]
