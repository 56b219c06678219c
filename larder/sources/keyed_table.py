"""Keyed tables that a batch updates in part (A12, J1), and atomic claims of versions.

A table is a folder of Parquet segments and a chain of manifests::

    <base>/data/<commit>/seg=<segment>/part-*.parquet
    <base>/_manifests/<version>.json          {"segments": {segment: commit}}

A segment is a range of keys that the caller names by a column (a day of
usage, say, with a hash bucket of the other keys where days are large).  An
upsert reads and writes only the segments that its batch has keys of; the new
manifest takes the other segments over from the one before.

Writers do not lock.  A manifest is written beside and renamed to the next
version, which one writer can do only; the loser reads the new manifest and
tries again: at once if other segments were changed, else by merging anew
with the changed ones.  A writer that dies leaves files that no manifest
names; ``vacuum`` deletes these and those of superseded versions.

A manifest has one short entry a segment and is read by the driver.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 20


class CommitConflict(RuntimeError):
    """Another writer was always first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, source: str, target: str) -> bool:
    """Rename ``source`` to ``target`` unless that exists; of several callers one succeeds."""
    jvm, src, fs = _fs(spark, source)
    _, dst, _ = _fs(spark, target)
    if fs.getUri().getScheme() == "file":
        # Java's rename replaces files here; a link to an existing name fails, as does a
        # directory's rename to a folder that has files
        a, b = src.toUri().getPath(), dst.toUri().getPath()
        try:
            if os.path.isdir(a):
                os.rename(a, b)
            else:
                os.link(a, b)
                os.unlink(a)
            return True
        except OSError:
            if os.path.exists(b):
                return False
            raise
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(src, dst, none)
        return True
    except Exception:
        if fs.exists(dst):
            return False
        raise


def _names(spark: SparkSession, folder: str) -> list[str]:
    _, path, fs = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{base}/_manifests")
                  if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> tuple[int, dict]:
    """(version, {segment: commit}) of the newest version or the given one; (0, {}) without any."""
    if version is None:
        version = (versions(spark, base) or [0])[-1]
    if not version:
        return 0, {}
    text = spark.read.option("wholetext", True).text(f"{base}/_manifests/{version}.json").first()[0]
    return version, json.loads(text)["segments"]


def _publish(spark: SparkSession, base: str, version: int, segments: dict) -> bool:
    jvm, folder, fs = _fs(spark, f"{base}/_manifests")
    fs.mkdirs(folder)
    beside = f"{base}/_manifests/_{uuid.uuid4().hex}"
    out = fs.create(jvm.org.apache.hadoop.fs.Path(beside), False)
    out.write(bytearray(json.dumps({"segments": segments}, sort_keys=True).encode()))
    out.close()
    if claim(spark, beside, f"{base}/_manifests/{version}.json"):
        return True
    fs.delete(jvm.org.apache.hadoop.fs.Path(beside), False)
    return False


def _paths(base: str, segments: dict) -> list[str]:
    return [f"{base}/data/{commit}/seg={seg}" for seg, commit in sorted(segments.items())]


def read(spark: SparkSession, base: str, schema: str, segments=None,
         version: int | None = None) -> DataFrame:
    """The newest version (or an older one), or only its given segments."""
    _, found = manifest(spark, base.rstrip("/"), version)
    if segments is not None:
        found = {s: c for s, c in found.items() if s in set(segments)}
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*_paths(base.rstrip("/"), found))


def day_segments(date: str, *keys: str, buckets: int = 1) -> Column:
    """A day's segment, in ``buckets`` parts by a hash of the other keys."""
    part = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys and buckets > 1 else F.lit(0)
    return F.concat_ws("_", F.date_format(date, "yyyyMMdd"), part.cast("string"))


def upsert(new: DataFrame, base: str, key: list[str], segment: Column, schema: str) -> int:
    """Rows of ``new`` (one a key) replace those of equal keys, else are added; returns the
    version.  ``segment`` must follow from the key; its text is used in paths, so letters,
    digits, ``-`` and ``_`` only."""
    spark, base = new.sparkSession, base.rstrip("/")
    columns = read(spark, base, schema, segments=()).columns
    batch = new.select(*columns).withColumn("seg", segment)
    touched = [r[0] for r in batch.select("seg").distinct().collect()]
    bad = [s for s in touched if s is None or not s.replace("-", "").replace("_", "").isalnum()]
    if bad:
        raise ValueError(f"segments without a plain name: {bad[:5]}")
    if not touched:
        return manifest(spark, base)[0]
    attempts = 0
    while attempts < ATTEMPTS:
        version, segments = manifest(spark, base)
        seen = {s: segments.get(s) for s in touched}
        current = read(spark, base, schema, touched, version) if version else \
            spark.createDataFrame([], schema)
        kept = current.join(batch.select(*key), key, "left_anti").select(*columns)
        commit = uuid.uuid4().hex
        (kept.withColumn("seg", segment).unionByName(batch)
         .repartition("seg", F.pmod(F.xxhash64(*key), F.lit(16)))     # a large segment: 16 tasks
         .write.partitionBy("seg").parquet(f"{base}/data/{commit}"))
        while attempts < ATTEMPTS:
            attempts += 1
            if _publish(spark, base, version + 1, segments | {s: commit for s in touched}):
                return version + 1
            version, segments = manifest(spark, base)
            if any(segments.get(s) != c for s, c in seen.items()):
                break                                   # others changed these segments: merge anew
    raise CommitConflict(f"{base}: no version could be claimed in {ATTEMPTS} attempts")


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep`` and the segments that no kept one names.  Not
    while a writer is at work, whose files no manifest names yet."""
    base, every = base.rstrip("/"), versions(spark, base.rstrip("/"))
    live = every[-max(1, keep):]
    named = {(c, s) for v in live for s, c in manifest(spark, base, v)[1].items()}
    jvm, _, fs = _fs(spark, base)
    gone = [f"{base}/_manifests/{v}.json" for v in every if v not in live]
    for commit in _names(spark, f"{base}/data"):
        parts = [n[4:] for n in _names(spark, f"{base}/data/{commit}") if n.startswith("seg=")]
        dead = [s for s in parts if (commit, s) not in named]
        gone += [f"{base}/data/{commit}"] if len(dead) == len(parts) else [
            f"{base}/data/{commit}/seg={s}" for s in dead]
    for path in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    return gone
