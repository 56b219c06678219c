"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor rereads files, it does not recompute
    the plan) and computes a table once that several later plans read.
    """
    path = table_path(df, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes.

    ``bytes.lower`` touches only A-Z and ``bytes.split`` splits on exactly
    these six white-space characters.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def id_remainder(doc_id: int, modulus: int) -> int:
    """crc32 of the id's decimal text, modulo ``modulus`` (-1 for a null id)."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def fold(col, modulus: int):
    """The same remainder as a Spark column; -1 for a null id."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(-1))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
