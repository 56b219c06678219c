"""Output writers.

Tables that the reference updates in place (forecast history, usage,
plans) are written as new versions: each write goes to a fresh
``.../v=<n>`` directory and readers take the newest complete version, so a
failed job never leaves a half-written table behind and nothing reads the
path it is overwriting.  A version is written beside and takes its number by
one rename, so of two writers one gets the number and the other the next.
Tables that batches update in part are ``keyed_table``'s.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import fmt_header, fmt_tab
from ..functions.numeric import half_even
from ..operators import feedback as FB
from ..operators import packing as PK
from . import keyed_table


def _versions(spark: SparkSession, base: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def write_version(df: DataFrame, base: str, keep: int | None = None) -> str:
    """Write ``df`` as the next version of the table at ``base``.

    ``keep``: how many of the newest versions stay (all if not given)."""
    spark, base = df.sparkSession, base.rstrip("/")
    beside = f"{base}/_writing-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(beside)
    while True:
        vs = _versions(spark, base)
        path = f"{base}/v={(vs[-1] + 1) if vs else 1}"
        if keyed_table.claim(spark, beside, path):
            break
    if keep is not None:
        jvm = spark.sparkContext._jvm
        for v in _versions(spark, base)[:-max(1, keep)]:
            old = jvm.org.apache.hadoop.fs.Path(f"{base}/v={v}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return path


def read_latest(spark: SparkSession, base: str, schema: str | None = None) -> DataFrame | None:
    """Newest complete version, or ``None`` (or an empty frame of
    ``schema``) when the table does not exist yet."""
    vs = _versions(spark, base)
    if not vs:
        return spark.createDataFrame([], schema) if schema else None
    return spark.read.parquet(f"{base.rstrip('/')}/v={vs[-1]}")


def append_audit(audit: DataFrame, base: str) -> None:
    """Audit rows are append-only."""
    audit.write.mode("append").parquet(base)


def packing_list_table(plist: DataFrame, dates: list[dt.date], par_levels: DataFrame | None = None
                       ) -> DataFrame:
    """A13 layout: one row per product (ordered by uncapped total), one
    column per date (``MM/dd/yyyy``, blank = 0), the two-week total, par,
    then a ``DAILY TOTAL`` row and the check-stock section, per store."""
    headers = [d.strftime("%m/%d/%Y") for d in dates]
    w = (plist.withColumn("_h", fmt_header("date"))
              .groupBy("store", "product", "total", "capped_total", "par")
              .pivot("_h", headers)
              .agg(F.first("qty")))
    cells = [F.when(F.col(h) > 0, F.col(h).cast("long").cast("string")).otherwise(F.lit("")).alias(h)
             for h in headers]
    body = w.select("store", F.lit(0).alias("_section"), F.col("total").alias("_order"),
                    F.col("product").alias("Product"), *cells,
                    F.col("capped_total").cast("long").cast("string").alias("2-Week Total"),
                    F.coalesce(F.col("par").cast("long").cast("string"), F.lit("")).alias("Max (Par)"))
    tot = (plist.withColumn("_h", fmt_header("date")).groupBy("store").pivot("_h", headers)
                .agg(F.sum("qty")))
    total_row = tot.select("store", F.lit(1).alias("_section"), F.lit(0.0).alias("_order"),
                           F.lit("DAILY TOTAL").alias("Product"),
                           *[F.coalesce(F.col(h), F.lit(0)).cast("long").cast("string").alias(h)
                             for h in headers],
                           sum((F.coalesce(F.col(h), F.lit(0)) for h in headers), F.lit(0))
                           .cast("long").cast("string").alias("2-Week Total"),
                           F.lit("").alias("Max (Par)"))
    out = body.unionByName(total_row)
    if par_levels is not None:
        cs = PK.check_stock(plist, par_levels)
        out = out.unionByName(cs.select(
            "store", F.lit(2).alias("_section"), F.lit(0.0).alias("_order"),
            F.col("product").alias("Product"), *[F.lit("").alias(h) for h in headers],
            F.lit("0").alias("2-Week Total"), F.col("par").cast("string").alias("Max (Par)")))
    return out


PACKING_ORDER = ("store", "_section", "_down", "Product")


def write_packing_lists(table: DataFrame, out_dir: str) -> None:
    """One CSV folder per store (``store=<name>``), rows in report order.

    Rows are dealt to ranges of the report order, so a large store is several
    files; read in the order of their names they are the list.
    """
    ordered = table.withColumn("_down", -F.col("_order"))
    ordered = ordered.repartitionByRange(*PACKING_ORDER).sortWithinPartitions(*PACKING_ORDER)
    ordered.drop("_section", "_order", "_down").write.mode("overwrite").partitionBy("store") \
        .option("header", True).csv(out_dir)


def read_packing_list(spark: SparkSession, out_dir: str, store: str) -> DataFrame:
    """A store's written list with ``file`` and ``row``, which give its order."""
    rows = spark.read.option("header", True).csv(out_dir).where(F.col("store") == store)
    return rows.select("*", F.col("_metadata.file_name").alias("file"),
                       F.monotonically_increasing_id().alias("row"))


def export_feedback(history: DataFrame, out_dir: str) -> None:
    """Per-date forecast-vs-actual rows (one folder per ``MM-dd`` tab),
    the accuracy summary and the confidence table."""
    rows = FB.forecast_vs_actual(history).withColumn("tab", fmt_tab("date"))
    rows.write.mode("overwrite").partitionBy("tab").option("header", True).csv(f"{out_dir}/by_day")
    FB.accuracy_summary(history).write.mode("overwrite").option("header", True) \
        .csv(f"{out_dir}/accuracy_summary")
    FB.confidence_scores(history).write.mode("overwrite").option("header", True) \
        .csv(f"{out_dir}/confidence")


def read_feedback_export(spark: SparkSession, out_dir: str, year: int) -> DataFrame:
    """Per-day rows back into history records (year given explicitly)."""
    df = spark.read.option("header", True).csv(f"{out_dir}/by_day")
    d = F.to_date(F.concat(F.lit(f"{year}-"), F.col("tab")), "yyyy-MM-dd")
    return df.select("store", "product", d.alias("date"),
                     F.col("predicted").cast("double").alias("predicted"),
                     F.col("actual").cast("double").alias("actual"),
                     half_even(F.col("predicted").cast("double") - F.col("actual").cast("double"), 2)
                     .alias("error"))
