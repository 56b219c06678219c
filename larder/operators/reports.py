"""Warehouse reports over plan lines (K1-K6, D19-D23, D25, D29, G5, F3-F5,
B12-B14, C4, C5, C16, H13).

The reference renders each report for one plan per HTTP request with one
query per line in places.  Here every report is computed for all plans in
one plan (grouped by ``plan_id``); callers filter a plan id if they want
one, and the filter reaches the scan.  Dimension joins (stores, items) are
plain equi-joins: Spark broadcasts them when the runtime size allows (AQE)
and falls back to a shuffle join when the dimension is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import count_if, half_even
from ..functions.topk import top_k_per_group


def pick_list(lines: DataFrame, items: DataFrame, category: str | None = None,
              search: str | None = None) -> DataFrame:
    """D19 + B12 + B13: per plan and item the recommended and actual totals
    and the number of distinct stores; optional category / name-or-sku
    search (case-insensitive substring)."""
    it = items.select(F.col("id").alias("item_id"), "item_name", "sku", "category")
    if category:
        it = it.where(F.col("category") == category)
    if search:
        pat = f"%{search.strip()}%"
        it = it.where(F.col("item_name").ilike(pat) | F.col("sku").ilike(pat))
    if category or search:
        lines = lines.join(it.select("item_id"), "item_id", "left_semi")
    # summed by ids, the names joined to the sums; an item row that occurs n times counts n times.
    # a plan has one line per (store, item) (unique key), so counting lines
    # per (plan, item) counts distinct stores without a distinct aggregate
    sums = lines.groupBy("plan_id", "item_id").agg(
        F.sum("recommended_quantity").alias("total_recommended"),
        F.sum(F.coalesce("actual_quantity", F.lit(0.0))).alias("total_actual"),
        F.count(F.lit(1)).alias("store_count"))
    it = it.groupBy("item_id", "item_name", "sku", "category").agg(F.count(F.lit(1)).alias("_n"))
    return sums.join(it, "item_id").select(
        "plan_id", "item_id", "item_name", "sku", "category",
        *[(F.col(c) * F.col("_n")).alias(c)
          for c in ("total_recommended", "total_actual", "store_count")])


def status_pivot(lines: DataFrame) -> DataFrame:
    """Per plan and item the number of lines in each status."""
    p = lines.groupBy("plan_id", "item_id").pivot("status", list(C.LINE_STATUSES)).count()
    return p.select("plan_id", "item_id",
                    *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in C.LINE_STATUSES])


def store_breakdown(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """A row per plan, item and store with its recommended and actual
    quantity and status; ``position`` orders an item's stores by name.  An
    item has one line a store, so a window partition is bounded by the stores."""
    st = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"))
    order = Window.partitionBy("plan_id", "item_id").orderBy("store_name", "id")
    return lines.join(st, "store_id").select(
        "plan_id", "item_id", "store_name", F.col("recommended_quantity").alias("recommended"),
        F.col("actual_quantity").alias("actual"), "status",
        F.row_number().over(order).cast("long").alias("position"))


def dashboard(lines: DataFrame, plans: DataFrame) -> DataFrame:
    """D22 + K1: per plan status counts, totals, stores and status shares."""
    agg = [F.count(F.lit(1)).alias("total_lines"),
           F.sum("recommended_quantity").alias("total_quantity"),
           F.countDistinct("store_id").alias("total_stores")]
    agg += [count_if(F.col("status") == s).alias(f"{s}_lines") for s in C.LINE_STATUSES]
    g = lines.groupBy("plan_id").agg(*agg)
    share = {f"{s}_pct": half_even(F.col(f"{s}_lines") * 100.0 /
                                   F.greatest(F.col("total_lines"), F.lit(1)), 1)
             for s in C.LINE_STATUSES}
    hdr = plans.select(F.col("id").alias("plan_id"), "plan_date", F.col("status").alias("plan_status"))
    return g.withColumns(share).join(hdr, "plan_id")


def delivery_progress(lines: DataFrame) -> DataFrame:
    """D23 + K3: per plan, store and status the line count and its share
    of the store's lines (1dp)."""
    g = lines.groupBy("plan_id", "store_id", "status").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("plan_id", "store_id"))
    return g.withColumn("pct", half_even(F.col("n") * 100.0 / tot, 1))


def exceptions(lines: DataFrame) -> DataFrame:
    """G5 + K4: each line once if shorted, low confidence or flagged."""
    f = lines.select(
        "plan_id", "id", "store_id", "item_id", "status", "confidence_level",
        (F.col("status") == "shorted").alias("is_shorted"),
        (F.col("confidence_level") == "low").alias("is_low_confidence"),
        (F.coalesce(F.size("warning_flags"), F.lit(0)) > 0).alias("has_warnings"))
    return f.where(F.col("is_shorted") | F.col("is_low_confidence") | F.col("has_warnings"))


def activity_top(lines: DataFrame, audit: DataFrame, k: int = C.ACTIVITY_LOG_LIMIT) -> DataFrame:
    """C16 + F4 + K5: per plan the newest ``k`` audit entries about its lines.

    The semi join keeps entries of type ``plan_line`` whose entity is a
    line; the top-k is a row number per plan (the limit is the feature).
    """
    ids = lines.select(F.col("id").alias("entity_id"), "plan_id")
    a = audit.where(F.col("entity_type") == "plan_line").join(ids, "entity_id")
    order = [F.col("changed_at").desc(), F.col("id").desc(), F.col("action").desc()]
    top = top_k_per_group(a, ["plan_id"], order, k, salt_col="id")
    return top.select("plan_id", F.col("rank").cast("long"), "id", "entity_id", "action",
                      "changed_at")


def prediction_accuracy(lines: DataFrame, plans: DataFrame, orders: DataFrame) -> DataFrame:
    """C5 + H13 + F5: per line predicted vs the store order on the plan date."""
    hdr = plans.select(F.col("id").alias("plan_id"), "plan_date")
    o = orders.select("store_id", "item_id", F.col("order_date").alias("plan_date"),
                      F.col("quantity_ordered").alias("actual"))
    j = lines.join(hdr, "plan_id").join(o, ["store_id", "item_id", "plan_date"], "left")
    pred, act = F.col("recommended_quantity"), F.col("actual")
    diff = act - pred
    pct = (F.when(act > 0, F.abs(diff) / act * 100).when(act.isNotNull() & (pred > 0), F.lit(100.0)))
    status = (F.when(act.isNull(), F.lit("no_actual")).when(F.abs(diff) < 0.01, F.lit("match"))
               .when(diff > 0, F.lit("under")).otherwise(F.lit("over")))
    return j.select("plan_id", "id", "store_id", "item_id", pred.alias("predicted"), "actual",
                    diff.alias("diff"), pct.alias("pct_error"), status.alias("status"),
                    "confidence_level")


def accuracy_order(acc: DataFrame) -> DataFrame:
    """mismatches first, then larger absolute differences."""
    return acc.orderBy("plan_id", (F.col("status") == "no_actual"), (F.col("status") == "match"),
                       F.abs(F.coalesce("diff", F.lit(0.0))).desc(), "id")


def accuracy_place(acc: DataFrame, place: str = "place") -> DataFrame:
    """F5 as a column: each line's place in its plan's list; a plan is one window."""
    order = Window.partitionBy("plan_id").orderBy(
        F.col("status") == "no_actual", F.col("status") == "match",
        F.abs(F.coalesce("diff", F.lit(0.0))).desc(), "id")
    return acc.withColumn(place, F.row_number().over(order).cast("long"))


def prediction_summary(acc: DataFrame) -> DataFrame:
    """Per plan matched / over / under / no-actual counts, totals, WMAPE."""
    s = F.col("status")
    g = acc.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("total_lines"), count_if(s == "match").alias("matched_lines"),
        count_if(s == "over").alias("over_predicted"), count_if(s == "under").alias("under_predicted"),
        count_if(s == "no_actual").alias("no_actual"),
        F.sum("predicted").alias("total_predicted_qty"),
        F.coalesce(F.sum("actual"), F.lit(0.0)).alias("total_actual_qty"),
        F.coalesce(F.sum(F.abs("diff")), F.lit(0.0)).alias("total_abs_error"))
    return g.withColumn("wmape", F.when(F.col("total_actual_qty") > 0,
                                        F.col("total_abs_error") / F.col("total_actual_qty") * 100))


def plan_categories(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct item categories per plan."""
    it = items.select(F.col("id").alias("item_id"), "category")
    return lines.join(it, "item_id").select("plan_id", "category").distinct()


def plan_stores(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Distinct store names per plan (sorted when rendered)."""
    st = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"))
    return lines.join(st, "store_id").select("plan_id", "store_name").distinct()


def delivery_sheet(lines: DataFrame, items: DataFrame) -> DataFrame:
    """K3 + C4: every plan line with its item, per store; ``sheet_order``
    renders it in the report order (category, item name)."""
    it = items.select(F.col("id").alias("item_id"), "item_name", "sku", "category")
    return lines.join(it, "item_id").select(
        "plan_id", "store_id", "id", "item_id", "item_name", "sku", "category",
        "recommended_quantity", "actual_quantity", "status", "confidence_level")


def sheet_order(sheet: DataFrame) -> DataFrame:
    """plan, store, then category and item name (line id breaks ties)."""
    return sheet.orderBy("plan_id", "store_id", "category", "item_name", "id")
