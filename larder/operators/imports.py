"""Row-level import validation, quarantine and upsert (A7-A9, B4-B9, C1,
D27, J1).

Input rows are text fields plus ``file`` and ``line_no`` (record number in
the file, header = 1, first data row = 2).  Every rule is a column
expression; the first failing rule wins, in the order store, item, date,
future date, quantity.  Valid rows and rejects stay DataFrames: nothing is
collected, and the reject report has one row per rejected record.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import count_if
from ..plans.materialize import materialize

# Date formats accepted by the importer, in the order tried.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy")
REJECT_REASONS = ("unknown_store", "unknown_sku", "invalid_date", "future_date",
                  "invalid_quantity")


def parse_date(c: Column) -> Column:
    """First format that parses, else null."""
    s = F.trim(c)
    return F.coalesce(*[F.try_to_date(s, f) for f in DATE_FORMATS])


def parse_quantity(c: Column) -> Column:
    """Text -> double (null when not a number)."""
    return F.trim(c).try_cast("double")


def valid_quantity(q: Column, max_qty: float = C.CSV_MAX_QUANTITY) -> Column:
    """Finite, >= 0, <= max."""
    return (q.isNotNull() & ~F.isnan(q) & (F.abs(q) < F.lit(float("inf")))
            & (q >= 0) & (q <= max_qty))


def clean_notes(c: Column) -> Column:
    """Trimmed, blank -> null; the whole text is kept."""
    t = F.trim(c)
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).otherwise(t)


def one_id_per_key(dimension: DataFrame, key: str, out: str, name: str) -> DataFrame:
    """Active rows' ids by upper-cased trimmed ``key``: one id each (the largest, i.e. the last)."""
    active = dimension.where(F.coalesce("active", F.lit(True))) if "active" in dimension.columns \
        else dimension
    return (active.where(F.col(key).isNotNull()).groupBy(F.upper(F.trim(key)).alias(out))
            .agg(F.max("id").alias(name)))


def ids_per_key(dimension: DataFrame, code: str, name: str, out: str, prefix: str) -> DataFrame:
    """``one_id_per_key`` of codes and of names in one table, stored: ``out``, ``prefix`` +
    ``_code`` and ``_name``.  One join finds both, and where the table is too large to be sent
    to all tasks, Spark can split a key that many rows name."""
    both = [one_id_per_key(dimension, code, out, f"{prefix}_code"),
            one_id_per_key(dimension, name, out, f"{prefix}_name")]
    found = both[0].unionByName(both[1], allowMissingColumns=True)
    return materialize(found.groupBy(out).agg(*[F.max(c).alias(c) for c in found.columns
                                                if c != out]), "import-ids")


def lookup_ids(rows: DataFrame, stores: DataFrame, items: DataFrame, store_col: str = "store_code",
               sku_col: str = "sku", name_first: bool | Column = False) -> DataFrame:
    """Store / item ids by upper-cased trimmed code (and, for the
    enquiry layout, by name first, then by code).  ``name_first`` may be a
    column, for rows of several layouts."""
    r = rows.withColumn("_s", F.upper(F.trim(store_col))).withColumn("_i", F.upper(F.trim(sku_col)))
    if isinstance(name_first, Column) or name_first:
        r = (r.join(ids_per_key(stores, "code", "name", "_s", "_sid"), "_s", "left")
              .join(ids_per_key(items, "sku", "item_name", "_i", "_iid"), "_i", "left"))
        named = name_first if isinstance(name_first, Column) else F.lit(True)
        sid = F.coalesce(F.when(named, F.col("_sid_name")), "_sid_code")
        iid = F.coalesce(F.when(named, F.col("_iid_name")), "_iid_code")
    else:
        r = (r.join(one_id_per_key(stores, "code", "_s", "_sid_code"), "_s", "left")
              .join(one_id_per_key(items, "sku", "_i", "_iid_code"), "_i", "left"))
        sid, iid = F.col("_sid_code"), F.col("_iid_code")
    out = r.withColumn("store_id", sid).withColumn("item_id", iid)
    return out.drop(*[c for c in out.columns if c.startswith("_sid") or c.startswith("_iid")
                      or c in ("_s", "_i")])


def validate(rows: DataFrame, stores: DataFrame, items: DataFrame, as_of,
             date_col: str = "usage_date", qty_col: str = "quantity_used",
             row_notice: int | None = None, store_col: str = "store_code",
             sku_col: str = "sku", name_first: bool | Column = False,
             note_notice: int = C.CSV_MAX_NOTE_LENGTH) -> DataFrame:
    """Validate import rows against the store and item dimensions.

    ``stores``: ``id, code``; ``items``: ``id, sku``; rows that are not
    ``active`` are not found and one id stands for a key (C1, B11).  Returns
    every input row with ``status`` (imported / skipped), ``reason``,
    ``store_id``, ``item_id``, the parsed date, the quantity (null unless it
    is a valid quantity), the whole notes and two flags: ``over_notice``
    (beyond ``row_notice`` rows of its file, if given) and ``note_too_long``.
    Flagged rows are imported like any other: nothing is cut.
    """
    as_of = F.lit(dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)
    if "notes" not in rows.columns:                 # the notes column is optional
        rows = rows.withColumn("notes", F.lit(None).cast("string"))
    if isinstance(name_first, Column) or name_first:
        r = lookup_ids(rows, stores, items, store_col, sku_col, name_first)
    else:
        sm = one_id_per_key(stores, "code", "_code", "store_id")
        im = one_id_per_key(items, "sku", "_sku", "item_id")
        r = (rows.withColumn("_code", F.upper(F.trim(store_col)))
                 .withColumn("_sku", F.upper(F.trim(sku_col)))
                 .join(sm, "_code", "left").join(im, "_sku", "left"))
    d = parse_date(F.col(date_col))
    q = parse_quantity(F.col(qty_col))
    reason = (F.when(F.col("store_id").isNull(), F.lit("unknown_store"))
               .when(F.col("item_id").isNull(), F.lit("unknown_sku"))
               .when(d.isNull(), F.lit("invalid_date"))
               .when(d > as_of, F.lit("future_date"))
               .when(~valid_quantity(q), F.lit("invalid_quantity")))
    over = F.lit(False) if row_notice is None else F.col("line_no") - 1 > row_notice
    notes = clean_notes(F.col("notes"))
    return r.select("file", "line_no",
                    F.when(reason.isNull(), F.lit("imported")).otherwise(F.lit("skipped"))
                    .alias("status"), reason.alias("reason"),
                    "store_id", "item_id", d.alias("date"),
                    F.when(valid_quantity(q), q).alias("quantity"), notes.alias("notes"),
                    over.alias("over_notice"),
                    F.coalesce(F.length(notes) > note_notice, F.lit(False)).alias("note_too_long"))


def validate_records(rows: DataFrame, stores: DataFrame, items: DataFrame, as_of,
                     row_notice: int | None = None) -> DataFrame:
    """``validate`` for rows of ``sources.records.import_records``: the enquiry layout's stores
    and items are looked up by name, then by code; the others by code."""
    return validate(rows, stores, items, as_of, "date", "quantity", row_notice, "store", "item",
                    F.col("layout") == "sales_enquiry")


def import_summary(checked: DataFrame) -> DataFrame:
    """Per file imported / skipped counts and whether the row notice was passed."""
    s = F.col("status")
    return checked.groupBy("file").agg(count_if(s == "imported").alias("imported"),
                                       count_if(s == "skipped").alias("skipped"),
                                       F.bool_or("over_notice").alias("row_limit_exceeded"))


def upsert(existing: DataFrame, checked: DataFrame, key: dict[str, str], value_cols: dict[str, str],
           source: str = "csv_import") -> DataFrame:
    """Valid rows replace existing rows with the same key, else insert;
    within a batch the last record of the file wins.

    ``key`` / ``value_cols`` map target column -> column of ``checked``.
    The result is a new version of the table (write it to a new path).
    """
    ok = checked.where(F.col("status") == "imported")
    kcols = [F.col(v).alias(t) for t, v in key.items()]
    latest = ok.groupBy(*kcols).agg(F.max_by(F.struct(*[F.col(v).alias(t) for t, v in value_cols.items()]),
                                             F.struct("file", "line_no")).alias("_v"))
    key = list(key)
    new = latest.select(*key, *[F.col(f"_v.{t}").alias(t) for t in value_cols],
                        F.lit(source).alias("source"))
    keep = existing.join(new.select(*key), key, "left_anti")
    return keep.unionByName(new, allowMissingColumns=True)
