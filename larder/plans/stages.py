"""Stages of a long run that a rerun takes over (K9).

A run's stage tables stand under a folder that its input version names::

    <base>/<version>/<stage>/part-*.parquet

A stage is written beside its place and takes it by one rename, so a folder of a stage's
name is a whole result: a rerun reads it and does not compute anything for it.  Of two runs
at once the first to finish a stage has its table taken by both.  What a killed run leaves
half-written has a name that begins with ``_writing-``; ``clean`` deletes it, and the
folders of other versions.

The version must change with everything that the results follow from: ``input_version`` is
a digest of the input files' paths, lengths and times and of the given parameters.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.keyed_table import claim
from .materialize import materialize


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_version(spark: SparkSession, folders: list[str], **parameters) -> str:
    """Digest of all files below ``folders`` (path, length, time of change) and of the
    parameters, which must be plain values."""
    found = []
    for folder in folders:
        path, fs = _path(spark, folder)
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    told = json.dumps([sorted(found), parameters], sort_keys=True)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


class Stages:
    """Stage tables of one version of a run."""

    def __init__(self, spark: SparkSession, base: str, version: str):
        if not version.isalnum():
            raise ValueError(f"a version is letters and digits: {version!r}")
        self.spark, self.base, self.version = spark, base.rstrip("/"), version
        self.made: list[str] = []          # stages that this run computed itself

    @property
    def folder(self) -> str:
        return f"{self.base}/{self.version}"

    def finished(self) -> list[str]:
        path, fs = _path(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if not n.startswith("_"))

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; ``make`` is called only if it is not there yet."""
        place = f"{self.folder}/{name}"
        path, fs = _path(self.spark, place)
        if not fs.exists(path):
            beside = f"{self.folder}/_writing-{uuid.uuid4().hex}"
            make().write.mode("errorifexists").parquet(beside)
            if claim(self.spark, beside, place):
                self.made.append(name)
            else:
                fs.delete(_path(self.spark, beside)[0], True)
        return self.spark.read.parquet(place)

    def clean(self) -> list[str]:
        """Delete other versions' folders and half-written tables; not while another run is
        at work under the same base.  Returns what went."""
        gone = []
        for folder, dead in ((self.base, lambda n: n != self.version),
                             (self.folder, lambda n: n.startswith("_"))):
            path, fs = _path(self.spark, folder)
            for status in fs.listStatus(path) if fs.exists(path) else []:
                if dead(status.getPath().getName()):
                    fs.delete(status.getPath(), True)
                    gone.append(status.getPath().getName())
        return sorted(gone)


class Scratch:
    """The same face without a base: every table is made anew and goes with the session."""

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return materialize(make(), name)
