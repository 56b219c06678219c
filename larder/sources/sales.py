"""Sales files: rows and problems from one pass.

Built on ``records``: quoted line breaks, title rows and any number of column
sets; files of both layouts are one scan, and what cannot be read is told
beside the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rownum import bucketed_row_number
from ..operators.dimensions import normalize_product
from ..operators.lanes import _lookup
from .csv_files import OUTPUT_PREFIXES, SALES_DATE_FORMATS
from .records import import_records

# The sales layouts (canonical name: column) and the first forecaster's rules.
SALES_LAYOUTS = {
    "order": {"store": "customername", "item": "productdescription", "date": "orderdate",
              "quantity": "orderquantity"},
    "enquiry": {"store": "customer", "item": "product", "date": "order date",
                "quantity": "quantity"},
}
STRICT_DATES = ("M/d/yyyy",)
V1_STORES = ("Gardena", "KTOWN")
V1_MERGED = {"CS Vienna Cream": "Vienna Cream"}


def _date(c: Column, formats) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(f))) for f in formats])


def read_sales(spark: SparkSession, path: str, stores: tuple | None = None,
               store_names: dict | None = None, aliases: dict | None = None,
               date_formats: tuple = SALES_DATE_FORMATS, bad: str = "zero",
               dedup: bool = True, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(``store, product, date, qty``, problems ``file, line_no, problem``).

    ``store_names`` maps customers to store codes and drops the others;
    ``stores`` keeps these stores only, else rows with a store stay.  Product
    names are trimmed and normalised by ``aliases``; ``dedup`` removes exact
    duplicates (G2).  Dates and quantities that do not parse: ``bad="zero"``
    keeps the row with a null date or a zero quantity, ``"drop"`` drops it,
    ``"tell"`` drops it and adds it to the problems; blank quantities are zero
    except with ``"drop"``.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"), "value")
    for prefix in OUTPUT_PREFIXES:
        lines = lines.where(~F.col("name").startswith(prefix))
    rows, problems = import_records(lines.drop("name"), SALES_LAYOUTS)
    store = F.trim("store")
    if store_names is not None:
        store = _lookup(store_names, store)
    rows = rows.withColumn("store", store).where(F.coalesce(F.col("store"), F.lit("")) != "")
    if stores:
        rows = rows.where(F.col("store").isin(list(stores)))
    if bad == "drop":
        rows = rows.where(F.coalesce(F.trim("item"), F.lit("")) != "")
    text = F.coalesce(F.trim("quantity"), F.lit(""))
    qty = text.try_cast("double")
    if bad != "drop":
        qty = F.when(text == "", F.lit(0.0)).otherwise(qty)
    rows = rows.withColumns({"_date": _date(F.col("date"), date_formats), "_qty": qty})
    if bad != "zero":
        fault = (F.when(F.col("_date").isNull(), F.lit("invalid date"))
                  .when(F.col("_qty").isNull(), F.lit("invalid quantity")))
        if bad == "tell":
            problems = problems.unionAll(rows.where(fault.isNotNull()).select(
                "file", "line_no", fault.alias("problem")))
        rows = rows.where(fault.isNull())
    out = rows.select("store", normalize_product(F.col("item"), aliases or {}).alias("product"),
                      F.col("_date").alias("date"), F.coalesce("_qty", F.lit(0.0)).alias("qty"))
    return (out.dropDuplicates(["store", "product", "date", "qty"]) if dedup else out), problems


def read_sales_v1(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4: the first forecaster's file: its two stores, one merged name, strict dates; rows it
    would stop at are told instead.  Duplicates stay."""
    return read_sales(spark, path, V1_STORES, aliases=V1_MERGED, date_formats=STRICT_DATES,
                      bad="tell", dedup=False)


def read_sales_seed(spark: SparkSession, path: str, store_names: dict,
                    aliases: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A5: the seed's files: customers mapped to store codes, bad dates and quantities dropped.
    Duplicates stay."""
    return read_sales(spark, path, store_names=store_names, aliases=aliases,
                      date_formats=STRICT_DATES, bad="drop", dedup=False)


def by_date(sales: DataFrame, place: str = "place") -> DataFrame:
    """``place`` of each row by date (then store, product, quantity), null dates last; days
    are numbered apart, so no task sorts the whole table."""
    day = F.coalesce(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(1 << 30))
    return bucketed_row_number(sales.withColumn("_all", F.lit(0)), ["_all"], day,
                               [F.col(c) for c in ("store", "product", "qty")], place).drop("_all")
