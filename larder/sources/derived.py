"""Domain tables derived from the driver's TPC-H-style tables.

The library's operators work on a retail model: demand lines
``(store, product, date, qty)`` for the batch forecaster and the app tables
(stores, items, settings, usage, orders, snapshots, plan lines, audit log,
forecast history) for the replenishment rules.  This module maps the given
tables onto that model; every mapping is a Spark plan over the whole input
so the work grows with the data.  The DuckDB oracle in
``larder.checks.oracle`` states the same mappings in SQL.

Mappings (see FIXTURES.md part 3):

* ``demand_lines("type")``: store = region of the supplier, product =
  ``p_type``, date = ship date, qty = ``l_quantity``.  ``"brand"`` uses
  ``p_brand``; ``"events"`` uses store = ``event_type``, product =
  ``user_id`` and qty = ``value``.
* App tables come from ``events``: store = ``event_type``, item =
  ``user_id``, unit quantity = ``floor(value / 40)``; morning events
  (hour < 12) are usage, afternoon events are store orders, Sunday events
  give inventory snapshots.  Setting attributes are assigned from the item
  key so that every rounding rule, zero par and inactive rows occur.
* Plan lines come from ``lineitem`` joined to ``orders``: plan = order year,
  store = supplier, item = part; order priority maps to line status.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rownum import bucketed_row_number
from ..plans.dealing import TASK_ROWS, deal, tasks_for
from .tables import read_table

# Fixed values of the fixture mappings.
APP_AS_OF = dt.date(2024, 1, 31)
UNIT_DIVISOR = 40.0
SNAPSHOT_DIVISOR = 20.0
ITEM_CATEGORIES = ("Dairy", "Coffee", "Supplies", "Bakery")
PRIORITY_TO_STATUS = {
    "1-URGENT": "pending",
    "2-HIGH": "picked",
    "3-MEDIUM": "shorted",
    "4-NOT SPECIFIED": "loaded",
    "5-LOW": "delivered",
}
RETURNFLAG_TO_CONFIDENCE = {"A": "high", "N": "medium", "R": "low"}
HISTORY_FUTURE_DAYS = 7
HISTORY_PENDING_DAYS = 14
IMPORT_AS_OF = dt.date(2002, 1, 1)
IMPORT_BUCKET = 1 << 14


# --------------------------------------------------------------------------
# batch forecaster inputs
# --------------------------------------------------------------------------

def supplier_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier key -> region name (supplier ⋈ nation ⋈ region)."""
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    reg = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
               .join(reg, nat.n_regionkey == reg.r_regionkey)
               .select("s_suppkey", F.col("r_name").alias("store")))


def demand_lines(spark: SparkSession, sf_dir: str, kind: str = "type") -> DataFrame:
    """Raw sales lines ``(store, product, date, qty)``."""
    if kind == "events":
        ev = read_table(spark, sf_dir, "events", ["event_type", "user_id", "ts", "value"])
        return ev.select(F.col("event_type").alias("store"),
                         F.col("user_id").cast("string").alias("product"),
                         F.to_date("ts").alias("date"),
                         F.col("value").alias("qty"))
    pcol = {"type": "p_type", "brand": "p_brand"}[kind]
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", pcol])
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    reg = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # each dimension joins the fact directly: the planner size-checks it on
    # its own (a pre-joined dimension chain is estimated as the product of
    # its inputs and would force a shuffle of the fact table)
    natreg = nat.join(reg, nat.n_regionkey == reg.r_regionkey)   # two tiny tables: one broadcast
    return (li.join(part, li.l_partkey == part.p_partkey)
              .join(sup, li.l_suppkey == sup.s_suppkey)
              .join(natreg, sup.s_nationkey == natreg.n_nationkey)
              .select(F.col("r_name").alias("store"), F.col(pcol).alias("product"),
                      F.to_date("l_shipdate").alias("date"),
                      F.col("l_quantity").alias("qty")))


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines whose product is the part's written name, ``Part <key>``."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_returnflag", "l_quantity",
                                                "l_shipdate"])
    return li.select(F.col("l_returnflag").alias("store"),
                     F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("product"),
                     F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("qty"))


def part_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``variant, target``: part names in chains of 40, each name an alias of the one before;
    in every fourth chain the second name leads back to the fourth, which makes a circle."""
    key = F.col("p_partkey")
    back = (key % 40 == 1) & (F.floor(key / 40) % 4 == 3)
    named = lambda c: F.concat(F.lit("Part "), c.cast("string"))           # noqa: E731
    return (read_table(spark, sf_dir, "part", ["p_partkey"]).where(key % 40 != 0)
            .select(named(key).alias("variant"),
                    named(F.when(back, key + 2).otherwise(key - 1)).alias("target")))


def product_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane rules with dates, one a part for its type and one for its brand: ``product, kind,
    lane, valid_from, valid_to``.  The product settles the kind.  Some rules are open-ended,
    some name an unknown kind or lane, some end before they start."""
    key = F.col("p_partkey").cast("int")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (key * 37) % 2500)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n + 1)
    kind = F.when(key % 6 == 5, F.lit("seasonal")).otherwise(
        pick(("override", "periodic", "sporadic", "obsolete"), (F.col("group") % 4).cast("int")))
    lane = pick(("daily", "periodic", "intermittent", "dormant", "weekly"), key % 5)
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    return (read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"])
            .select("p_partkey", F.explode(F.array(
                F.struct(F.col("p_type").alias("product"), F.length("p_type").alias("group")),
                F.struct(F.col("p_brand").alias("product"), number.alias("group")))).alias("of"))
            .select("p_partkey", "of.*")
            .select("product", kind.alias("kind"), F.when(kind == "override", lane).alias("lane"),
                    start.alias("valid_from"),
                    F.when(key % 11 != 0, F.date_add(start, (key * 13) % 400 - 20)).alias("valid_to")))


def par_levels(spark: SparkSession, sf_dir: str, kind: str = "brand") -> DataFrame:
    """Par levels ``(store, product, max_qty)`` for every observed pair.

    The value is assigned from the key lengths so that zero par occurs.
    """
    return par_levels_for(demand_lines(spark, sf_dir, kind))


def par_levels_for(demand: DataFrame) -> DataFrame:
    """Par levels for the pairs of any demand table (raw lines or daily)."""
    pairs = demand.select("store", "product").distinct()
    return pairs.withColumn(
        "max_qty",
        (((F.length("store") + F.length("product")) % 4) * 10).cast("long"))


# --------------------------------------------------------------------------
# replenishment app tables (from events)
# --------------------------------------------------------------------------

def _app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_type", "user_id", "ts", "value"])
    return ev.select(F.col("event_type").alias("store_id"),
                     F.col("user_id").alias("item_id"),
                     F.to_date("ts").alias("d"),
                     F.hour("ts").alias("hr"),
                     F.col("value"))


def app_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _app_events(spark, sf_dir).where(F.col("hr") < 12)
    return (ev.groupBy("store_id", "item_id", F.col("d").alias("usage_date"))
              .agg(F.sum(F.floor(F.col("value") / UNIT_DIVISOR)).cast("double")
                   .alias("quantity_used"))
              .withColumn("source", F.lit("import")))


def app_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _app_events(spark, sf_dir).where(F.col("hr") >= 12)
    return (ev.groupBy("store_id", "item_id", F.col("d").alias("order_date"))
              .agg(F.sum(F.floor(F.col("value") / UNIT_DIVISOR)).cast("double")
                   .alias("quantity_ordered"))
              .withColumn("source", F.lit("import")))


def app_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _app_events(spark, sf_dir).where(F.weekday("d") == 6)
    return (ev.groupBy("store_id", "item_id", F.col("d").alias("snapshot_date"))
              .agg(F.sum(F.floor(F.col("value") / SNAPSHOT_DIVISOR)).cast("double")
                   .alias("quantity_on_hand")))


def app_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_type"]).distinct()
    return ev.select(F.col("event_type").alias("id"),
                     F.initcap("event_type").alias("name"),
                     F.upper("event_type").alias("code"),
                     F.lit(True).alias("active"))


def app_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read_table(spark, sf_dir, "events", ["user_id"]).distinct()
    cats = F.array(*[F.lit(c) for c in ITEM_CATEGORIES])
    uid = F.col("user_id")
    return users.select(
        uid.alias("id"),
        F.concat(F.lit("Item "), uid.cast("string")).alias("item_name"),
        F.concat(F.lit("SKU-"), F.lpad(uid.cast("string"), 5, "0")).alias("sku"),
        F.element_at(cats, (uid % len(ITEM_CATEGORIES) + 1).cast("int")).alias("category"),
        F.lit("each").alias("unit_of_measure"),
        (uid % 6 + 1).cast("int").alias("case_pack_quantity"),
        F.lit(True).alias("active"))


def app_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One setting per (store, item) pair seen in usage or orders."""
    ev = _app_events(spark, sf_dir).select("store_id", "item_id").distinct()
    item = F.col("item_id")
    rules = F.array(F.lit("round_up_case_pack"), F.lit("round_up_integer"), F.lit("none"))
    return ev.select(
        "store_id", "item_id",
        ((item % 5) * 4).cast("double").alias("par_level"),
        (item % 3).cast("double").alias("safety_stock"),
        F.lit(1.0).alias("reorder_threshold"),
        ((item % 4) * 2).cast("double").alias("min_send_quantity"),
        F.element_at(rules, (item % 3 + 1).cast("int")).alias("rounding_rule"),
        F.when(item % 7 == 0, F.lit(14)).cast("int").alias("usage_window_days"),
        (item % 11 != 0).alias("active"))


# --------------------------------------------------------------------------
# plan lines, plans, audit log (from lineitem ⋈ orders)
# --------------------------------------------------------------------------

def _case_map(c: Column, mapping: dict, default: str) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _plan_id(ts: Column) -> Column:
    """Plan key = ship date as yyyymmdd."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("long")


def plan_lines(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """One plan per ship date; a line per (supplier, part) shipped that day."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_quantity", "l_discount", "l_returnflag", "l_shipdate"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    lines = li.join(od, li.l_orderkey == od.o_orderkey).select(
        _plan_id(F.col("l_shipdate")).alias("plan_id"), F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("item_id"), "l_orderkey", "l_linenumber", "l_quantity",
        "o_orderpriority", "l_returnflag", "l_discount", "o_orderdate")
    # a plan's lines of an item in one task: what is summed by plan and item finds them there
    g = (deal(lines, tasks_for(li.count(), task_rows), "plan_id", "item_id")
           .groupBy("plan_id", "store_id", "item_id")
           .agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                F.sum("l_quantity").alias("recommended_quantity"),
                F.min("o_orderpriority").alias("prio"),
                F.max("l_returnflag").alias("flag"),
                F.max("l_discount").alias("disc"),
                F.max("o_orderdate").alias("last_status_change_at")))
    status = _case_map(F.col("prio"), PRIORITY_TO_STATUS, "delivered")
    conf = _case_map(F.col("flag"), RETURNFLAG_TO_CONFIDENCE, "low")
    rec = F.col("recommended_quantity")
    g = g.withColumn("status", status).withColumn("confidence_level", conf)
    return g.select(
        "id", "plan_id", "store_id", "item_id", "recommended_quantity",
        F.when(F.col("status") == "pending", F.lit(None).cast("double"))
         .when(F.col("status") == "shorted", F.floor(rec / 2).cast("double"))
         .otherwise(rec).alias("actual_quantity"),
        "status", "confidence_level",
        F.array_compact(F.array(
            F.when(F.col("confidence_level") == "low", F.lit("low_confidence")),
            F.when(F.col("disc") >= 0.08, F.lit("missing_snapshot")),
            F.when(rec > 100, F.lit("unusual_recommendation")))).alias("warning_flags"),
        "last_status_change_at")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan headers: id, plan_date, status (by day of month)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_shipdate"])
    d = li.select(F.to_date("l_shipdate").alias("plan_date")).distinct()
    dom = F.dayofmonth("plan_date")
    return d.select(_plan_id(F.col("plan_date")).alias("id"), "plan_date",
                    F.when(dom <= 10, F.lit("completed")).when(dom <= 20, F.lit("in_progress"))
                     .otherwise(F.lit("draft")).alias("status"))


def plan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store orders recorded against plan lines (finished line items)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
                     "l_linestatus", "l_shipdate"])
    f = li.where(F.col("l_linestatus") == "F")
    q = F.floor(F.col("l_quantity") * (1 - F.col("l_discount")) + F.col("l_tax") * 20)
    return (f.groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("item_id"),
                      F.to_date("l_shipdate").alias("order_date"))
             .agg(F.sum(q).cast("double").alias("quantity_ordered")))


def plan_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    return sup.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                      F.concat(F.lit("ST"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
                      .alias("code"))


def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("item_name"),
                       F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku"),
                       F.col("p_type").alias("category"),
                       F.col("p_size").alias("case_pack_quantity"))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"])
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_returnflag") == "N", F.lit("plan")).otherwise(F.lit("plan_line"))
         .alias("entity_type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entity_id"),
        F.when(F.col("l_linestatus") == "F", F.lit("status_change"))
         .otherwise(F.lit("quantity_change")).alias("action"),
        F.col("l_shipdate").alias("changed_at"))


# --------------------------------------------------------------------------
# forecast history (feedback loop input)
# --------------------------------------------------------------------------

def forecast_history(spark: SparkSession, sf_dir: str, kind: str = "type") -> DataFrame:
    """Recorded forecasts for the whole calendar plus 7 future days.

    predicted is a deterministic perturbation of the real demand; actuals
    of the last 14 data days are still pending (null), future days too.
    """
    lines = demand_lines(spark, sf_dir, kind)
    return forecast_history_for(lines.groupBy("store", "product", "date").agg(F.sum("qty").alias("qty")))


def forecast_history_for(daily: DataFrame, last: Column | None = None) -> DataFrame:
    """``forecast_history`` over an existing daily-demand table."""
    first, latest = daily.agg(F.min("date"), F.max("date")).first()
    first, last = F.lit(first), F.lit(latest) if last is None else last
    pairs = daily.select("store", "product").distinct()
    grid = pairs.select(
        "store", "product",
        F.explode(F.sequence(first, F.date_add(last, HISTORY_FUTURE_DAYS))).alias("date"))
    h = grid.join(daily, ["store", "product", "date"], "left")
    dom = F.dayofmonth("date")
    q = F.coalesce(F.col("qty"), F.lit(0.0))
    predicted = F.when(F.col("date") > last, (dom % 4 + 1).cast("double")).otherwise(
        F.rint(q * (F.lit(0.8) + (dom % 5) * F.lit(0.1)) + dom % 3))
    actual = F.when(F.col("date") <= F.date_sub(last, HISTORY_PENDING_DAYS), q)
    h = h.select("store", "product", "date", predicted.alias("predicted"),
                 actual.alias("actual"), q.alias("_q"))
    return h.select(
        "store", "product", "date", "predicted", "actual",
        F.when(F.col("actual").isNotNull(),
               F.rint((F.col("predicted") - F.col("actual")) * 100) / 100).alias("error"),
        F.when(F.col("_q") >= 5, F.lit("high")).otherwise(F.lit("low")).alias("volume_tier"),
        F.lit("v2").alias("model_version"),
        F.col("date").cast("timestamp_ntz").alias("recorded_at"))


# --------------------------------------------------------------------------
# raw import text (CSV-validation input)
# --------------------------------------------------------------------------

def raw_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage-import rows as text, one bad field injected per reject reason.

    Columns mirror a usage CSV (``store_code, sku, usage_date,
    quantity_used, notes``) plus ``file`` (ship year) and ``line_no``
    (record number in the file, header = 1).  Rows are the line items,
    numbered in key order; the key decides which rows carry which defect.
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_quantity", "l_shipdate", "l_returnflag"])
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    k = F.col("line_key") % 97
    store = F.concat(F.lit("ST"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    sku = F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))
    date_iso = F.date_format("l_shipdate", "yyyy-MM-dd")
    date_us = F.date_format("l_shipdate", "M/d/yyyy")
    qty = F.col("l_quantity").cast("string")
    base = li.select("*", F.year("l_shipdate").cast("long").alias("file"), key.alias("line_key"))
    order = [F.col(c) for c in ("line_key", "l_partkey", "l_suppkey", "l_quantity",
                                "l_shipdate", "l_returnflag")]
    numbered = bucketed_row_number(base, ["file"], F.floor(F.col("line_key") / IMPORT_BUCKET),
                                   order, out="_rn")
    return numbered.select(
        "file", (F.col("_rn") + 1).alias("line_no"),
        F.when(k == 1, F.lit("NOPE")).when(k == 2, F.lit("  ")).otherwise(store).alias("store_code"),
        F.when(k == 3, F.lit("P-0")).otherwise(sku).alias("sku"),
        F.when(k == 4, F.lit("31/31/2001"))
         .when(k == 5, F.lit("2031-01-01"))
         .when(k % 2 == 0, date_us).otherwise(date_iso).alias("usage_date"),
        F.when(k == 6, F.lit("NaN")).when(k == 7, F.lit("inf")).when(k == 8, F.lit("-3"))
         .when(k == 9, F.lit("1000000")).when(k == 10, F.lit("abc"))
         .otherwise(qty).alias("quantity_used"),
        F.when(F.col("l_returnflag") == "R", F.lit(" returned ")).alias("notes"))


ORDER_SPLIT = 20_000             # lines a split of the rendered order files


def order_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import rows as the text lines of order files: ``file, start, seq, value``.

    A file is a ship year.  Years of remainder 0 by 3 are legacy files with
    semicolons, of 1 enquiry exports with a title row, of 2 legacy files with
    tabs.  Notes have a quoted delimiter, quotes and a line break; every
    hundredth record is followed by a blank line.  The year 1 lacks a column.
    """
    raw = raw_import(spark, sf_dir)
    kind = F.col("file") % 3
    note = F.when(F.col("notes").isNotNull(), F.lit('"came ""back"";\t,\n\nlate"')).otherwise("")
    by_name = F.regexp_replace("store_code", "^ST", "Supplier#000")
    product = F.when(F.col("line_no") % 7 == 0, F.lit("Red Widget ")).otherwise(F.col("sku"))
    legacy = ("store_code", "sku", "usage_date", "quantity_used")
    text = (F.when(kind == 1, F.concat_ws(",", F.col("line_no").cast("string"), "usage_date",
                                          F.lit('"a, b"'), by_name, product, "quantity_used"))
             .when(kind == 0, F.concat_ws(";", *legacy, note))
             .otherwise(F.concat_ws("\t", *legacy, note)))
    text = F.when(F.col("line_no") % 100 == 0, F.concat(text, F.lit("\n"))).otherwise(text)
    body = raw.select("file", (F.col("line_no") + 1).alias("no"), text.alias("text"))
    title = F.when(kind == 1, F.lit("Sales Enquiry as of 03/14/2026,,,,,\n")).otherwise("")
    names = (F.when(kind == 1, F.lit("Order No.,Order Date,Warehouse,Customer,Product,Quantity"))
              .when(kind == 0, F.lit("store_code;SKU;order_date;quantity_ordered;notes"))
              .otherwise(F.lit("store_code\tsku\torder_date\tquantity_ordered\tnotes")))
    heads = raw.select("file").distinct().select(
        "file", F.lit(1).cast("long").alias("no"), F.concat(title, names).alias("text"))
    broken = spark.range(2).select(
        F.lit(1).cast("long").alias("file"), (F.col("id") + 1).alias("no"),
        F.when(F.col("id") == 0, F.lit("store_code,sku,order_date")).otherwise("ST000001,P-1,x")
        .alias("text"))
    every = body.unionByName(heads).unionByName(broken)
    lines = every.select("file", "no", F.posexplode(F.split("text", "\n")).alias("part", "value"))
    return lines.select("file", F.floor(F.col("no") / ORDER_SPLIT).alias("start"),
                        (F.col("no") * 8 + F.col("part")).alias("seq"), "value")


def plan_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing usage table of the plan world (open line items per day)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate"])
    return (li.where(F.col("l_linestatus") == "O")
              .groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("item_id"),
                       F.to_date("l_shipdate").alias("usage_date"))
              .agg(F.sum("l_quantity").alias("quantity_used"))
              .withColumn("source", F.lit("seed"))
              .withColumn("notes", F.lit(None).cast("string")))


# --------------------------------------------------------------------------
# rows that break the dimension rules; status events on plan lines
# --------------------------------------------------------------------------

def faulty_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app_settings`` with one fault a rule on chosen items, one setting twice and unknown items."""
    s, item = app_settings(spark, sf_dir), F.col("item_id")
    k = item % 17
    s = s.withColumns({
        "par_level": F.when(k == 1, F.lit(-1.0)).otherwise(F.col("par_level")),
        "safety_stock": F.when(k == 2, F.lit(-1.0)).otherwise(F.col("safety_stock")),
        "reorder_threshold": F.when(k == 3, F.lit(-1.0)).otherwise(F.col("reorder_threshold")),
        "min_send_quantity": F.when(k == 4, F.lit(-1.0)).otherwise(F.col("min_send_quantity")),
        "rounding_rule": F.when(k == 5, F.lit("half_up")).otherwise(F.col("rounding_rule")),
        "usage_window_days": F.when(k == 6, F.lit(91)).when(k == 7, F.lit(0))
                              .otherwise(F.col("usage_window_days"))})
    return s.unionByName(s.where(k == 8)).unionByName(
        s.where(k == 9).withColumn("item_id", F.lit(-1) * item - 1))


def faulty_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app_items`` with over-long names and codes, blanks, shared codes and empty case packs."""
    k = F.col("id") % 17
    return app_items(spark, sf_dir).withColumns({
        "item_name": F.when(k == 10, F.repeat(F.lit("n"), 201)).when(k == 11, F.lit(" "))
                      .otherwise(F.col("item_name")),
        "sku": F.when(k == 12, F.repeat(F.col("sku"), 9)).when(k == 13, F.lit(""))
                .when(k == 14, F.lit("sku-shared")).otherwise(F.col("sku")),
        "case_pack_quantity": F.when(k == 15, F.lit(0)).otherwise(F.col("case_pack_quantity"))})


def keyed_plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``plan_lines`` with an id of its own for every (plan, store, item)."""
    key = (F.col("plan_id") * 100_000 + F.col("store_id")) * 1_000_000 + F.col("item_id")
    return plan_lines(spark, sf_dir).withColumn("id", key)


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events a plan line: some without a field, not finite, of unknown lines or statuses."""
    k, seq = F.col("id"), F.col("seq")
    nan, none = F.lit(float("nan")), F.lit(None)
    rec = F.col("recommended_quantity")
    ev = keyed_plan_lines(spark, sf_dir).select("id", "recommended_quantity", "last_status_change_at",
                                          F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))
                                          .alias("seq"))
    return ev.select(
        F.when((k % 50 == 0) & (seq == 1), -k).otherwise(k).alias("line_id"),
        F.when(seq == 1, F.when(k % 5 == 0, F.lit("lost")).otherwise(F.lit("picked")))
         .when((seq == 3) & (k % 3 == 0), F.lit("loaded")).alias("status"),
        F.when(seq == 1, rec)
         .when(seq == 2, F.when(k % 7 == 0, nan).when(k % 7 == 1, none)
                          .when(k % 7 == 2, F.lit(float("inf"))).when(k % 7 == 3, F.lit(-1.0))
                          .otherwise(rec - 1)).alias("actual_quantity"),
        F.when((seq == 3) & (k % 4 == 0), F.lit("late")).alias("picker_note"),
        F.when(k % 2 == 0, F.col("last_status_change_at"))
         .otherwise(F.date_add(F.to_date("last_status_change_at"), seq).cast("timestamp_ntz"))
         .cast("timestamp_ntz").alias("changed_at"),
        seq.cast("long").alias("seq"))


def backtest_rows(daily: DataFrame) -> DataFrame:
    """Hold-out rows with fixed errors a model: ``store, product, date, actual, lane, pred_*``.

    The day and the length of the name decide the errors, so weights can be
    checked without fitting a model; some series have no GBT column, stores
    with names of six letters are not of the daily lane.
    """
    k = F.dayofmonth("date") + F.length("product")
    daily_lane = F.length("store") != 6
    return daily.select(
        "store", "product", "date", F.col("qty").alias("actual"),
        F.when(daily_lane, F.lit("daily")).otherwise(F.lit("intermittent")).alias("lane"),
        F.when(daily_lane, F.col("qty") + k % 5 - 2).alias("pred_dow"),
        F.when(daily_lane & (k % 11 != 0), F.col("qty") + (k % 7) * 0.5 - 1).alias("pred_exp"),
        F.when(daily_lane & (F.length("product") % 3 != 0), F.col("qty") + k % 3 - 1.25)
         .alias("pred_gbt"))
