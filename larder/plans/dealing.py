"""Deal rows over as many tasks as their number asks for.

Spark joins small shuffle partitions into ones of ``spark.sql.adaptive.advisoryPartitionSizeInBytes``
as they are written, compressed: tens of megabytes that become a hash table of many times that
where nearly every row is a group of its own.  ``deal`` bounds the rows of a task instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

TASK_ROWS = 250_000              # rows of a task, about
LEAST_TASKS = 8                  # tables of fewer tasks than these are left to Spark


def tasks_for(rows: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks for ``rows`` rows; 0: so few that Spark's own choice will do."""
    n = -(-rows // task_rows)
    return n if n >= LEAST_TASKS else 0


def deal(df: DataFrame, tasks: int, *key: str | Column) -> DataFrame:
    """``df`` in ``tasks`` partitions by ``key``; unchanged if ``tasks`` is 0."""
    return df.repartition(tasks, *key) if tasks else df
