"""Compact rows for blocks of documents: packed word lists and arrays of word numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import types as T


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def table_of(rows: list[tuple], schema: T.StructType) -> pa.Table:
    fields = arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)],
                                schema=fields)


def pack(sizes, body: bytes) -> bytes:
    """Item sizes and the items' bytes, end to end, compressed."""
    sizes = np.asarray(sizes, np.uint32)
    return zstandard.compress(np.uint32(len(sizes)).tobytes() + sizes.tobytes() + body, 3)


def unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4), raw[4 + 4 * n:]


def planes(numbers: np.ndarray) -> bytes:
    """Four byte planes: the high ones are almost constant and compress to nothing."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
