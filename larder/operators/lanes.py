"""Lane routing and the flat lane forecasts.

The adaptive demand window ("shortest of the last 28, 60, 90 days or the
whole history holding at least three order days, else the last 28") is
evaluated for every series in ONE hash aggregate over the sparse daily
table: on a zero-filled grid the tail-n statistics of a series are the
conditional sums over rows with ``days_ago < n``, and the tail length is
``least(n, series_length)``.  No dense grid, no sort, no per-series loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import ProductConfig
from ..functions.numeric import count_if
from .demand import date_bounds

WINDOWS = (C.ROUTING_WINDOW, *C.EXTENDED_WINDOWS)


def _lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup for bounded product configuration."""
    if not mapping:
        return F.lit(None).cast("string")
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*kv), key)


def _in_set(values, key: Column) -> Column:
    return key.isin(list(values)) if values else F.lit(False)


def with_rules(df: DataFrame, product_config: ProductConfig | None, name: str = "product"
               ) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """``df`` with the product's rules at hand: the frame, the columns
    ``override``, ``periodic`` and ``sporadic``, and the names to drop afterwards.

    A rule table (``ProductConfig.rules``) is joined; the planner sends it to
    all tasks only if its stored size allows.  Otherwise the configuration's
    small collections become literals.
    """
    pc = product_config or ProductConfig()
    key = F.col(name)
    if pc.rules is None:
        return df, {"override": _lookup(pc.lane_overrides, key),
                    "periodic": _in_set(pc.periodic, key),
                    "sporadic": _in_set(pc.sporadic, key)}, []
    kept = ["_r_product", "_r_override", "_r_periodic", "_r_sporadic"]
    rules = pc.rules.select("product", "lane_override", "periodic", "sporadic").toDF(*kept)
    is_set = lambda c: F.coalesce(F.col(c), F.lit(False))                  # noqa: E731
    return df.join(rules, key == F.col("_r_product"), "left"), {
        "override": F.col("_r_override"), "periodic": is_set("_r_periodic"),
        "sporadic": is_set("_r_sporadic")}, kept


def window_aggs(last: Column) -> list[Column]:
    """Aggregates for E9 (conditional counts and sums per tail length)."""
    days_ago = F.datediff(last, F.col("date"))
    pos = F.col("qty") > 0
    aggs = []
    for w in WINDOWS:
        inside = days_ago < w
        aggs += [count_if(pos & inside).alias(f"c{w}"),
                 F.sum(F.when(inside, F.col("qty")).otherwise(0.0)).alias(f"s{w}"),
                 F.sum(F.when(inside & pos, F.col("qty")).otherwise(0.0)).alias(f"p{w}")]
    aggs += [count_if(pos).alias("call"), F.sum("qty").alias("sall"),
             F.sum(F.when(pos, F.col("qty")).otherwise(0.0)).alias("pall")]
    return aggs


def window_columns(series_days: Column) -> dict[str, Column]:
    """Chosen-window columns from the ``window_aggs`` output."""
    m = C.MIN_ORDER_DAYS
    pick = (F.when(F.col(f"c{WINDOWS[0]}") >= m, F.lit(WINDOWS[0]))
             .when(F.col(f"c{WINDOWS[1]}") >= m, F.lit(WINDOWS[1]))
             .when(F.col(f"c{WINDOWS[2]}") >= m, F.lit(WINDOWS[2]))
             .when(F.col("call") >= m, F.lit(-1))
             .otherwise(F.lit(WINDOWS[0])))

    def chosen(prefix: str, all_col: str) -> Column:
        out = F.when(pick == -1, F.col(all_col))
        for w in WINDOWS:
            out = out.when(pick == w, F.col(f"{prefix}{w}"))
        return out

    window_days = F.when(pick == -1, series_days).otherwise(pick)
    return {
        "window_days": window_days.cast("int"),
        "n_days": F.least(window_days, series_days).cast("long"),
        "n_order_days": chosen("c", "call").cast("long"),
        "window_qty": chosen("s", "sall"),
        "window_nonzero_qty": chosen("p", "pall"),
    }


def window_stats(daily: DataFrame, first: Column | None = None,
                 last: Column | None = None) -> DataFrame:
    """E9 statistics for every (store, product) series.

    Returns ``store, product, series_days, window_days, n_days,
    n_order_days, window_qty, window_nonzero_qty``.
    """
    if first is None or last is None:
        first, last = date_bounds(daily)
    series_days = (F.datediff(last, first) + 1).cast("long")
    g = daily.groupBy("store", "product").agg(*window_aggs(last))
    cols = window_columns(F.col("series_days"))
    return (g.withColumn("series_days", series_days)
             .select("store", "product", "series_days",
                     *[c.alias(n) for n, c in cols.items()]))


def classify_lanes(stats: DataFrame, product_config: ProductConfig | None = None,
                   dormant: float = C.DORMANT_ZERO_RATE,
                   intermittent: float = C.INTERMITTENT_ZERO_RATE) -> DataFrame:
    """Override, else dormant / intermittent / periodic / daily ladder."""
    stats, rule, extra = with_rules(stats, product_config)
    n, k = F.col("n_days"), F.col("n_order_days")
    zero_rate = F.when(n > 0, F.lit(1.0) - k / n)
    override = rule["override"]
    lane = (F.when(override.isNotNull(), override)
             .when((n == 0) | (F.col("window_qty") == 0), F.lit("dormant"))
             .when(zero_rate >= dormant, F.lit("dormant"))
             .when(zero_rate >= intermittent, F.lit("intermittent"))
             .when(rule["periodic"], F.lit("periodic"))
             .otherwise(F.lit("daily")))
    return stats.withColumn("zero_rate", zero_rate).withColumn("lane", lane).drop(*extra)


def intermittent_rate() -> Column:
    """(order days / days) x mean order size, floored at 0."""
    k, n = F.col("n_order_days"), F.col("n_days")
    mean_nz = F.col("window_nonzero_qty") / k
    return F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (k / n) * mean_nz))


def periodic_rate(delivery_window: int = C.PERIODIC_DELIVERY_WINDOW) -> Column:
    """I4: mean order size / max(mean interval, delivery window)."""
    k, n = F.col("n_order_days"), F.col("n_days")
    mean_nz = F.col("window_nonzero_qty") / k
    interval = F.greatest(n / k, F.lit(float(delivery_window)))
    return F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), mean_nz / interval))


def lanes(daily: DataFrame, product_config: ProductConfig | None = None,
          first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Window statistics + lane + flat daily rate of the non-daily lanes."""
    st = classify_lanes(window_stats(daily, first, last), product_config)
    rate = (F.when(F.col("lane") == "intermittent", intermittent_rate())
             .when(F.col("lane") == "periodic", periodic_rate())
             .when(F.col("lane") == "dormant", F.lit(0.0)))
    return st.withColumn("lane_rate", rate)
