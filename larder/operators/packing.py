"""Safety stock, delivery scheduling and packing lists (I14, I15, I16, C11,
C17, D26, B16, F2).

Inputs are long-format predictions ``(store, product, lane, day_idx, date,
pred)``.  Series statistics come from one aggregate over the sparse daily
table (zero days add nothing to non-zero statistics; the order frequency
divides by the common series length), then everything is per-row column
arithmetic or a per-series aggregate over 14 horizon rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import ProductConfig
from ..functions.numeric import half_even
from .lanes import with_rules

KEYS = ["store", "product"]


def series_stats(daily: DataFrame, first: Column, last: Column) -> DataFrame:
    """Per series: total, non-zero count/mean/std, order frequency."""
    q = F.col("qty")
    pos = q > 0
    days = (F.datediff(last, first) + 1).cast("double")
    return daily.groupBy(*KEYS).agg(
        F.sum(q).alias("total_qty"),
        F.sum(F.when(pos, 1).otherwise(0)).alias("nz_count"),
        F.avg(F.when(pos, q)).alias("nz_mean"),
        F.stddev_samp(F.when(pos, q)).alias("nz_std"),
    ).withColumn("order_freq", F.col("nz_count") / days)


def apply_safety_stock(preds: DataFrame, stats: DataFrame,
                       product_config: ProductConfig | None = None,
                       multiplier: float = C.SAFETY_MULTIPLIER) -> DataFrame:
    """x1.15 (x1.25 when the non-zero CV > 1); sporadic products get a
    floor of max(1, round(mean order / 2)) on days predicted above zero.
    Series with no demand keep their predictions."""
    j, rule, _ = with_rules(preds.join(stats, KEYS, "left"), product_config)
    cv = F.when((F.col("nz_count") > 1) & (F.col("nz_mean") > 0),
                F.col("nz_std") / F.col("nz_mean")).otherwise(F.lit(0.0))
    mult = F.when(cv > C.SAFETY_VOLATILE_CV,
                  F.lit(multiplier + C.SAFETY_VOLATILE_EXTRA)).otherwise(F.lit(multiplier))
    p = F.col("pred") * mult
    floor = F.greatest(F.lit(1.0), half_even(F.coalesce(F.col("nz_mean"), F.lit(1.0)) * 0.5, 0))
    sporadic = rule["sporadic"] & (F.col("order_freq") > C.SPORADIC_MIN_ORDER_FREQ)
    p = F.when(sporadic & (p > 0) & (p < floor), floor).otherwise(p)
    no_history = F.col("total_qty").isNull() | (F.col("total_qty") == 0)
    adj = F.when(no_history, F.col("pred")).otherwise(p)
    return j.withColumn("pred", adj).select(*preds.columns)


def delivery_schedule(lane_stats: DataFrame, days: int = C.HORIZON_DAYS) -> DataFrame:
    """I16: intermittent / periodic series get ``avg_qty`` every ``interval``
    days from day 0 (or nothing when the period's expected total < 0.5).

    ``lane_stats`` carries ``lane, n_days, n_order_days, window_nonzero_qty``.
    Returns ``store, product, day_idx, qty`` for all 14 days.
    """
    s = lane_stats.where(F.col("lane").isin("intermittent", "periodic"))
    k = F.col("n_order_days")
    interval = F.greatest(F.lit(1.0), half_even(F.col("n_days") / F.when(k > 0, k), 0))
    avg_qty = F.greatest(F.lit(1.0), half_even(F.col("window_nonzero_qty") / F.when(k > 0, k), 0))
    s = s.select(*KEYS, k.alias("k"), interval.alias("interval"), avg_qty.alias("avg_qty"))
    active = (F.col("k") > 0) & ((F.lit(float(days)) / F.col("interval")) * F.col("avg_qty") >= 0.5)
    h = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day_idx"))
    qty = F.when(active & (F.col("day_idx") % F.col("interval").cast("int") == 0),
                 F.col("avg_qty")).otherwise(F.lit(0.0))
    return h.select(*KEYS, F.col("day_idx").cast("int"), qty.alias("qty"))


def packing_quantities(preds: DataFrame, schedule: DataFrame) -> DataFrame:
    """Whole-unit daily quantities: rounded predictions, replaced by the
    delivery schedule for intermittent / periodic series."""
    rounded = preds.withColumn("qty", half_even(F.col("pred"), 0))
    j = rounded.join(schedule.withColumnRenamed("qty", "sched"), [*KEYS, "day_idx"], "left")
    q = F.when(F.col("lane").isin("intermittent", "periodic"),
               F.coalesce(F.col("sched"), F.lit(0.0))).otherwise(F.col("qty"))
    return j.select(*KEYS, "day_idx", "date", q.alias("qty"))


def packing_list(qty: DataFrame, par_levels: DataFrame | None = None) -> DataFrame:
    """I15 + C17: series with a 14-day total >= 1, each day capped at par.

    Returns ``store, product, day_idx, date, qty, total, capped_total,
    par``; ``total`` orders the list (F2), ``capped_total`` is printed.
    """
    totals = qty.groupBy(*KEYS).agg(F.sum("qty").alias("total"))
    keep = totals.where(F.col("total") >= 1)
    rows = qty.join(keep, KEYS)
    if par_levels is not None:
        rows = rows.join(par_levels.select(*KEYS, F.col("max_qty").cast("double").alias("par")),
                         KEYS, "left")
    else:
        rows = rows.withColumn("par", F.lit(None).cast("double"))
    capped = F.when(F.col("par").isNull(), F.col("qty")).otherwise(F.least("qty", "par"))
    rows = rows.withColumn("qty", capped)
    ct = rows.groupBy(*KEYS).agg(F.sum("qty").alias("capped_total"))
    return rows.join(ct, KEYS).select(*KEYS, "day_idx", "date", "qty", "total",
                                      "capped_total", "par")


def packing_totals(plist: DataFrame) -> DataFrame:
    """Capped per-day totals per store plus the store's grand total
    (``day_idx`` null) in one ROLLUP."""
    r = plist.rollup("store", "day_idx").agg(F.sum("qty").alias("total"))
    return r.where(F.col("store").isNotNull())


def check_stock(plist: DataFrame, par_levels: DataFrame) -> DataFrame:
    """C11: stocked items (par > 0) with no packed demand this period."""
    listed = plist.select(*KEYS).distinct()
    return (par_levels.where(F.col("max_qty") > 0)
                      .join(listed, KEYS, "left_anti")
                      .select(*KEYS, F.col("max_qty").alias("par")))


def packing_order(plist: DataFrame) -> DataFrame:
    """products by uncapped total descending (product breaks ties)."""
    return plist.orderBy("store", F.col("total").desc(), "product", "day_idx")


def packing_v1(preds: DataFrame, min_total: float = 0.5) -> DataFrame:
    """B16 (v1 export): series whose unrounded 14-day total is >= 0.5."""
    t = preds.groupBy(*KEYS).agg(F.sum("pred").alias("total"))
    return t.where(F.col("total") >= min_total)
