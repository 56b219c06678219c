"""Materialise an intermediate table once and cut its lineage.

Used for the daily-demand aggregate, which every forecasting, packing,
backtest and feedback plan reads several times: without it each branch
re-scans and re-joins the raw facts.  The table is written as Parquet under
the shared folder named by ``spark.checkpoint.dir`` and read back, so later
plans start from a small columnar table (with statistics for the planner)
and a lost executor never forces recomputation from the raw tables.
(An eager ``DataFrame.checkpoint()`` would evaluate the plan twice unless
cached first.)

All tables of one application stand in one folder, which is deleted when the
driver's Python ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_RUN = uuid.uuid4().hex
_cleaned: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:                      # the context is gone: nothing can be reached any more
        pass


def table_path(df: DataFrame, name: str = "table") -> str:
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/larder-tables-{_RUN}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_delete, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    path = table_path(df, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
