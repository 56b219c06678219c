"""Spark session helpers.

The library never owns the cluster configuration: every operator takes the
caller's ``SparkSession``.  ``get_session`` is only a convenience for tests,
``bench.py`` and local runs; on a cluster the job submitter's settings win
because ``getOrCreate`` returns the existing session unchanged.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale, applied only when building a local session.
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(cores: int | str = "*", shuffle_partitions: int = 8,
                app_name: str = "larder") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _scratch(master: str) -> str:
    """A folder of our own, for local runs only: other machines could not see it."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder that the driver and all executors share; "
            f"it is not set and the master is {master!r}")
    return tempfile.mkdtemp(prefix="larder-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter sets ``spark.checkpoint.dir`` to a shared,
    fault-tolerant location; we read it from the session and refuse to run
    without it.  Only with a local master (local runs, tests), where driver
    and executors are one process, an unset value gets a scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:                      # no SparkContext on this client (e.g. Spark Connect)
        if not configured:
            _scratch("a remote session")
        return configured
    configured = configured or sc.getCheckpointDir()
    if not configured:
        configured = _scratch(sc.master)
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
