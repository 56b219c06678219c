"""Continuous usage imports with Structured Streaming (optional wrapper over A7 + J1).

New CSV files dropped into a folder are picked up by the file source; each
micro-batch goes through the same batch code (records, title-row skip,
layout, row validation) and is upserted into the keyed usage table, of which
it rewrites the days it has rows of.  The upsert is idempotent — replaying a batch after a failure
replaces the same keys with the same values — so ``foreachBatch`` with a
checkpoint location gives effectively-once results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import imports as IM
from ..plans.materialize import materialize
from ..sources import keyed_table, sinks
from ..sources.records import USAGE_LAYOUTS, import_records

USAGE_SCHEMA = ("store_id long, item_id long, usage_date date, quantity_used double, "
                "source string, notes string")


KEY = ["store_id", "item_id", "usage_date"]


def process_usage_batch(spark: SparkSession, batch: DataFrame, stores: DataFrame, items: DataFrame,
                        as_of, table: str, rejects: str | None = None,
                        incremental: bool = True) -> None:
    """Check a batch's files, upsert the valid rows and append everything else to ``rejects``
    (default: the table's name and ``-rejects``), files that cannot be read included."""
    lines = batch.select("file", F.col("_start").alias("start"),
                         F.monotonically_increasing_id().alias("seq"), "value")
    rows, problems = import_records(lines, USAGE_LAYOUTS)
    checked = materialize(IM.validate(rows, stores, items, as_of, "date", "quantity",
                                      store_col="store", sku_col="item"), "stream-checked")
    names = ({"store_id": "store_id", "item_id": "item_id", "usage_date": "date"},
             {"quantity_used": "quantity", "notes": "notes"})
    columns = ["store_id", "item_id", "usage_date", "quantity_used", "source", "notes"]
    if incremental:
        none = spark.createDataFrame([], USAGE_SCHEMA)
        new = IM.upsert(none, checked, *names).select(*columns)
        keyed_table.upsert(new, table, KEY, keyed_table.day_segments("usage_date"), USAGE_SCHEMA)
    else:
        new = IM.upsert(sinks.read_latest(spark, table, USAGE_SCHEMA), checked, *names)
        sinks.write_version(new.select(*columns), table)
    told = problems.select("file", "line_no", F.lit("skipped").alias("status"),
                           F.col("problem").alias("reason"))
    (checked.where(F.col("status") != "imported").unionByName(told, allowMissingColumns=True)
     .write.mode("append").parquet(rejects or f"{table.rstrip('/')}-rejects"))


def start_usage_import(spark: SparkSession, input_dir: str, stores: DataFrame, items: DataFrame,
                       as_of, table: str, checkpoint: str, rejects: str | None = None,
                       available_now: bool = False, incremental: bool = True) -> StreamingQuery:
    """New files of ``input_dir`` into the usage table.  ``incremental``: a keyed table, of
    which a batch rewrites its own days only; else whole versions (``sinks``)."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", 100).load(input_dir)
                  .select("value", F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("_start")))

    def each(batch: DataFrame, epoch: int) -> None:
        process_usage_batch(spark, batch, stores, items, as_of, table, rejects, incremental)

    w = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
