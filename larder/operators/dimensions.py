"""Dimension tables derived from facts and quality checks (I29, H8, H9, C8,
D28, G3, G4, B3, B18).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .lanes import _lookup


def make_sku(name: Column) -> Column:
    """H8: runs of non-alphanumerics -> '-', trimmed of '-', upper case."""
    dashed = F.regexp_replace(name, r"[^a-zA-Z0-9]+", "-")
    return F.upper(F.regexp_replace(dashed, r"^-+|-+$", ""))


def normalize_product(name: Column, aliases: dict) -> Column:
    """Trim, then the alias map, else the trimmed name."""
    t = F.trim(name)
    return F.coalesce(_lookup(aliases, t), t) if aliases else t


def product_names(sales: DataFrame, par: DataFrame | None = None,
                  obsolete=frozenset()) -> DataFrame:
    """G3 + G4: products sold or stocked, minus blanks and obsolete ones."""
    names = sales.select(F.col("product").alias("item_name"))
    if par is not None:
        names = names.unionByName(par.select(F.col("product").alias("item_name")))
    names = names.distinct().where(F.col("item_name") != "")
    if obsolete:
        names = names.where(~F.col("item_name").isin(list(obsolete)))
    return names


def item_dimension(names: DataFrame, categories: dict | None = None) -> DataFrame:
    """I29 + H9: item rows with generated SKU and mapped category."""
    cat = _lookup(categories or {}, F.col("item_name"))
    return names.select("item_name", make_sku(F.col("item_name")).alias("sku"),
                        F.coalesce(cat, F.lit("Other")).alias("category"),
                        F.lit("each").alias("unit_of_measure"),
                        F.lit(1).cast("int").alias("case_pack_quantity"),
                        F.lit("dry").alias("storage_type"), F.lit(True).alias("active"))


def settings_from_facts(usage_pairs: DataFrame, par: DataFrame) -> DataFrame:
    """A setting for every (store, item) pair that has usage or a par
    level; par defaults to 0, other rule values to their neutral defaults.

    The reference materialises every store x item pair; pairs with neither
    usage nor par produce no plan line (par 0, no demand -> quantity 0), so
    they are left implicit instead of being generated by a cross join.
    """
    pairs = usage_pairs.select("store", "product").unionByName(par.select("store", "product")).distinct()
    j = pairs.join(par.select("store", "product", "max_qty"), ["store", "product"], "left")
    return j.select("store", "product",
                    F.coalesce(F.col("max_qty").cast("double"), F.lit(0.0)).alias("par_level"),
                    F.lit(0.0).alias("safety_stock"), F.lit(0.0).alias("reorder_threshold"),
                    F.lit(0.0).alias("min_send_quantity"), F.lit("none").alias("rounding_rule"),
                    F.lit(True).alias("active"))


def par_coverage(items: DataFrame, par: DataFrame) -> DataFrame:
    """Per item whether any store has par > 0."""
    p = par.groupBy(F.col("product").alias("item_name")).agg(
        F.bool_or(F.col("max_qty") > 0).alias("_has"))
    return (items.select("item_name").join(p, "item_name", "left")
                 .select("item_name", F.coalesce("_has", F.lit(False)).alias("has_par")))


def quality_checks(settings: DataFrame, items: DataFrame) -> DataFrame:
    """Violations per setting / item as an array of rule codes.

    Uniqueness uses a grouped count joined back (no unpartitioned window).
    """
    dup = (settings.groupBy("store_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > 1).select("store_id", "item_id", F.lit(True).alias("_dup")))
    s = settings.join(dup, ["store_id", "item_id"], "left")
    uw = F.col("usage_window_days")
    checks = F.array_compact(F.array(
        F.when(F.col("par_level") < 0, F.lit("negative_par_level")),
        F.when(F.col("safety_stock") < 0, F.lit("negative_safety_stock")),
        F.when(F.col("reorder_threshold") < 0, F.lit("negative_reorder_threshold")),
        F.when(F.col("min_send_quantity") < 0, F.lit("negative_min_send_quantity")),
        F.when(~F.col("rounding_rule").isin(*C.ROUNDING_RULES), F.lit("invalid_rounding_rule")),
        F.when(uw.isNotNull() & ((uw < 1) | (uw > 90)), F.lit("invalid_usage_window")),
        F.when(F.col("_dup").isNotNull(), F.lit("duplicate_setting"))))
    code = F.upper(F.trim("sku"))
    shared = (items.where(code != "").groupBy(code.alias("_code"))
              .agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
              .select("_code", F.lit(True).alias("_shared")))
    it = items.withColumn("_code", code).join(shared, "_code", "left").select(
        F.col("id").alias("item_id"), F.lit(True).alias("_found"), "case_pack_quantity", "sku",
        "item_name", "_shared")
    s = s.join(it, "item_id", "left")
    found = F.col("_found").isNotNull()
    blank = lambda c: found & (F.coalesce(F.trim(c), F.lit("")) == "")     # noqa: E731
    item_checks = F.array_compact(F.array(
        F.when(~found, F.lit("unknown_item")),
        F.when(blank("item_name"), F.lit("blank_item_name")),
        F.when(blank("sku"), F.lit("blank_sku")),
        F.when(F.col("_shared"), F.lit("duplicate_sku")),
        F.when(F.col("case_pack_quantity") < 1, F.lit("invalid_case_pack")),
        F.when(F.length("item_name") > 200, F.lit("item_name_too_long")),
        F.when(F.length("sku") > 50, F.lit("sku_too_long"))))
    return s.select("store_id", "item_id", F.concat(checks, item_checks).alias("violations"))


def quality_summary(checked: DataFrame) -> DataFrame:
    """Count of settings per violation code (plus the clean count)."""
    e = checked.select(F.explode_outer("violations").alias("violation"))
    return e.groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(
        F.count(F.lit(1)).alias("n"))


__all__ = ["make_sku", "normalize_product", "product_names", "item_dimension",
           "settings_from_facts", "par_coverage", "quality_checks", "quality_summary"]
