"""Numeric column helpers (all JVM-side expressions, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c, digits: int = 0) -> Column:
    """Round half to even on the scaled double, like numpy's ``round``.

    Spark's ``round`` is half-up and ``bround`` works on the decimal value;
    scaling and ``rint`` reproduces numpy (1.015 -> 1.01, 2.5 -> 2.0).
    """
    scale = float(10 ** digits)
    if digits == 0:
        return F.rint(col(c))
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def clip(c, lo: float | None, hi: float | None) -> Column:
    """Clamp a column; nulls stay null (``greatest``/``least`` skip nulls)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def safe_ratio(num, den, default=None) -> Column:
    """``num / den`` with ``default`` when ``den`` is 0 or null."""
    d = col(den)
    out = F.try_divide(col(num), F.when(d != 0, d))
    return out if default is None else F.coalesce(out, F.lit(default))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def round_all(df, digits: int = 6):
    """Normalise a result for comparison with an oracle: doubles rounded
    half-even to ``digits`` places, narrow integers widened to ``long``."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("double", "float"):
            out.append(half_even(F.col(f.name), digits).alias(f.name))
        elif t in ("integer", "short", "byte"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
