"""Exact top-k per group without funnelling a hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt_col: str, buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (which must be a total
    order, i.e. end with a unique tie-break).

    Phase 1 ranks within (group, hash bucket of ``salt_col``) and keeps the
    top k of each bucket; phase 2 ranks the at most ``buckets * k``
    survivors of each group.  The top k of a group is always among the
    survivors, so the result is exact while no task sorts more than one
    bucket of a hot group.
    """
    b = F.pmod(F.hash(F.col(salt_col)), F.lit(buckets))
    w1 = Window.partitionBy(*group_cols, b).orderBy(*order)
    first = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
