"""Demand tables: daily sums, dense grid, order/usage overlay.

Scale notes
* ``daily_demand`` is a hash aggregate with map-side partial sums, so a hot
  (store, product, date) key is combined before the shuffle.
* The dense grid is generated per observed (store, product) pair with
  ``explode(sequence(first_day, last_day))`` — a generator, not a join — so
  its size is pairs x days and every series stays bounded by the number of
  calendar days, whatever the skew of the raw lines.  Pairs never observed
  together are all-zero series and are not materialised (see README).
* The global date bounds set the forecast horizon; they are resolved once
  (one aggregate job, two values to the driver) and then used as literals,
  so they are not re-planned as subqueries inside every expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import date_lit

KEYS = ("store", "product")


def distinct_lines(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Drop exact duplicates (default on the four canonical columns)."""
    return lines.dropDuplicates(key or ["store", "product", "date", "qty"])


def daily_demand(lines: DataFrame) -> DataFrame:
    """One row per (store, product, date) with the summed quantity."""
    return lines.groupBy("store", "product", "date").agg(F.sum("qty").alias("qty"))


def date_bound_values(daily: DataFrame):
    """Global first and last demand date (one aggregate job, two values)."""
    row = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return row["lo"], row["hi"]


def date_bounds(daily: DataFrame) -> tuple[Column, Column]:
    """Global first and last demand date, as literal columns."""
    lo, hi = date_bound_values(daily)
    return date_lit(lo), date_lit(hi)


def dense_demand(daily: DataFrame, first: Column | None = None,
                 last: Column | None = None) -> DataFrame:
    """Zero-filled series from the global first to the global last day."""
    if first is None or last is None:
        first, last = date_bounds(daily)
    pairs = daily.select(*KEYS).distinct()
    grid = pairs.select(*KEYS, F.explode(F.sequence(first, last)).alias("date"))
    return (grid.join(daily, [*KEYS, "date"], "left")
                .select(*KEYS, "date", F.coalesce(F.col("qty"), F.lit(0.0)).alias("qty")))


def data_profile(lines: DataFrame) -> DataFrame:
    """first/last date, distinct stores and products, row count."""
    return lines.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                     F.countDistinct("store").alias("n_stores"),
                     F.countDistinct("product").alias("n_products"),
                     F.count(F.lit(1)).alias("n_rows"))


def overlay_demand(usage: DataFrame, orders: DataFrame, plan_date,
                   max_window: int | Column) -> DataFrame:
    """Per (store_id, item_id, date) the order quantity if any, else usage.

    Only dates in ``[plan_date - max_window, plan_date - 1]`` are kept; the
    filter is on the scan columns so it reaches the Parquet reader.  The
    ``has_usage`` / ``has_order`` flags feed the source label later.
    """
    p = F.lit(plan_date) if not isinstance(plan_date, Column) else plan_date
    lo = F.date_sub(p, max_window) if isinstance(max_window, int) else F.date_sub(p, max_window)
    u = (usage.where((F.col("usage_date") >= lo) & (F.col("usage_date") < p))
              .select("store_id", "item_id", F.col("usage_date").alias("date"),
                      F.col("quantity_used").alias("u_qty")))
    o = (orders.where((F.col("order_date") >= lo) & (F.col("order_date") < p))
               .select("store_id", "item_id", F.col("order_date").alias("date"),
                       F.col("quantity_ordered").alias("o_qty")))
    j = u.join(o, ["store_id", "item_id", "date"], "full")
    return j.select("store_id", "item_id", "date",
                    F.coalesce("o_qty", "u_qty").alias("qty"),
                    F.col("u_qty").isNotNull().alias("has_usage"),
                    F.col("o_qty").isNotNull().alias("has_order"))
