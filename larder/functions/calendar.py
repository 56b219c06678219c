"""Calendar parts and cyclical encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def dow(c) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col(c))


def calendar_columns(date_col="date") -> dict[str, Column]:
    d = col(date_col)
    w = dow(d)
    dom = F.dayofmonth(d)
    two_pi = 2.0 * math.pi
    return {
        "dow": w,
        "day_of_month": dom,
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "is_weekend": (w >= 5).cast("int"),
        "is_monday": (w == 0).cast("int"),
        "is_friday": (w == 4).cast("int"),
        "dow_sin": F.sin(F.lit(two_pi) * w / F.lit(7.0)),
        "dow_cos": F.cos(F.lit(two_pi) * w / F.lit(7.0)),
        "dom_sin": F.sin(F.lit(two_pi) * dom / F.lit(31.0)),
        "dom_cos": F.cos(F.lit(two_pi) * dom / F.lit(31.0)),
    }


def add_calendar(df, date_col="date"):
    return df.withColumns(calendar_columns(date_col))


def horizon(start: Column, days: int) -> Column:
    """Array of ``days`` consecutive dates starting at ``start``."""
    return F.sequence(start, F.date_add(start, days - 1))


def fmt_header(c) -> Column:
    return F.date_format(col(c), "MM/dd/yyyy")


def fmt_key(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def fmt_tab(c) -> Column:
    return F.date_format(col(c), "MM-dd")


def date_lit(d) -> Column:
    """A literal date column that remembers its Python value (so parameter
    tables derived from it need no Spark job)."""
    c = F.lit(d)
    c._larder_value = d
    return c


def lit_value(c):
    """The Python value behind ``date_lit`` (None for other columns).

    Read from the instance dict: ``Column.__getattr__`` turns unknown
    attribute names into field accessors instead of raising."""
    return vars(c).get("_larder_value") if hasattr(c, "__dict__") else None
