"""Exact row numbers within large groups, without a single-task window.

``row_number() over (partition by file order by key)`` sorts a whole file in
one task.  Here the rows are split into ordered buckets first: counts per
(group, bucket) form a small table whose running sums give each bucket's
starting offset; the final number is that offset plus a row number inside
the bucket.  Each sort touches one bucket only.  The running sums are taken
in two steps, over spans of ``SPAN`` bucket numbers and inside each span, so
the counts of a large group are not sorted in one task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024


def bucketed_row_number(df: DataFrame, group_cols: list[str], bucket: Column,
                        order: list[Column], out: str = "row_no") -> DataFrame:
    """Add ``out`` = 1-based position within ``group_cols`` by
    (``bucket``, ``order``).  ``bucket`` must be monotone in the order, e.g.
    ``floor(key / width)`` for an ascending ``key``."""
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_span", F.floor(F.col("_bucket") / SPAN))
    before = (Window.unboundedPreceding, -1)
    spans = counts.groupBy(*group_cols, "_span").agg(F.sum("_n").alias("_m"))
    above = Window.partitionBy(*group_cols).orderBy("_span").rowsBetween(*before)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_m").over(above), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*group_cols, "_span").orderBy("_bucket").rowsBetween(*before)
    offsets = (counts.join(spans, [*group_cols, "_span"])
               .withColumn("_off", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
               .drop("_n", "_base", "_span"))
    inner = Window.partitionBy(*group_cols, "_bucket").orderBy(*order)
    return (b.join(offsets, [*group_cols, "_bucket"])
             .withColumn(out, (F.col("_off") + F.row_number().over(inner)).cast("long"))
             .drop("_bucket", "_off"))
