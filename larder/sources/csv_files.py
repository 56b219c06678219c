"""Header-driven CSV ingestion.

Files are read as text lines with their path (``_metadata``), numbered
within each file by split offset (exact, without a whole-file sort), and
parsed with ``from_csv`` using the layout of the file's own header line.
Files with different column sets are unioned by name, so a file that lacks
a column is read correctly (positional reading would shift its columns).
Only the header lines — one short line per file — reach the driver, to
build one parse schema per distinct layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rownum import bucketed_row_number
from ..operators.dimensions import normalize_product

# The two sales layouts (source column -> canonical column),
# the markers that identify them, and the files that are outputs, not inputs.
SALES_ORDER_COLUMNS = {"CustomerName": "store", "ProductDescription": "product",
                       "OrderDate": "date", "OrderQuantity": "qty"}
SALES_ENQUIRY_COLUMNS = {"Customer": "store", "Product": "product",
                         "Order Date": "date", "Quantity": "qty"}
ENQUIRY_MARKER = "Sales Enquiry"
OUTPUT_PREFIXES = ("packing_list_", "forecast_accuracy")
SALES_DATE_FORMATS = ("M/d/yyyy", "yyyy-M-d", "M-d-yyyy", "M/d/yyyy H:mm", "yyyy-M-d H:mm:ss")
BOM = "﻿"
DELIMITERS = (",", "\t", ";", "|")


def numbered_lines(spark: SparkSession, path: str, skip_blank: bool = False) -> DataFrame:
    """``file, file_name, line_no, value`` for every line of every file.

    ``skip_blank``: lines without text are no records and get no number."""
    t = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"))
    if skip_blank:
        t = t.where(F.trim("value") != "")
    n = bucketed_row_number(t, ["file"], F.col("_start"), [F.col("_seq")], out="line_no")
    return n.select("file", "file_name", "line_no", "value")


def is_title_row(line: Column) -> Column:
    """A10: blank, or several fields of which more than half are empty."""
    s = F.trim(line)
    parts = F.split(s, ",")
    empty = F.size(F.filter(parts, lambda p: F.trim(p) == ""))
    return (s == "") | ((F.size(parts) > 1) & (empty / F.size(parts) > 0.5))


def sniff_delimiter(header: str) -> str:
    """The candidate delimiter occurring most often in the header line
    (comma on ties or when none occurs)."""
    counts = [(header.count(d), -i, d) for i, d in enumerate(DELIMITERS)]
    best = max(counts)
    return best[2] if best[0] > 0 else ","


def _split_header(h: str, delimiter: str = ",") -> list[str]:
    import csv
    import io
    return next(csv.reader(io.StringIO(h.lstrip(BOM)), delimiter=delimiter))


def read_sales_files(spark: SparkSession, path: str, stores: tuple | None = None,
                     aliases: dict | None = None, dedup: bool = True,
                     drop_bad: bool = False) -> DataFrame:
    """A3: every sales CSV under ``path`` -> ``store, product, date, qty``.

    The first line decides the layout: an enquiry export (title row, header
    on line 2), a sales-order export (header on line 1), otherwise the
    sales-order layout is tried.  Output files are skipped.  Rows of other
    stores are dropped (exact match), blank quantities become 0, product
    names are trimmed and normalised, exact duplicates are removed (G2).
    ``drop_bad=True`` drops rows whose date or quantity does not parse
    instead (the seed loaders' rule, A5).
    """
    lines = numbered_lines(spark, path)
    for p in OUTPUT_PREFIXES:
        lines = lines.where(~F.col("file_name").startswith(p))
    first = F.regexp_replace(F.col("value"), f"^{BOM}", "")
    kind = lines.where(F.col("line_no") == 1).select(
        "file", F.when(first.contains(ENQUIRY_MARKER), F.lit("enquiry")).otherwise(F.lit("order"))
        .alias("kind"))
    lines = lines.join(kind, "file")
    header_no = F.when(F.col("kind") == "enquiry", F.lit(2)).otherwise(F.lit(1))
    headers = (lines.where(F.col("line_no") == header_no)
                    .select("file", "kind", F.col("value").alias("header")))
    layouts = [(r["kind"], r["header"]) for r in headers.select("kind", "header").distinct().collect()]
    data = lines.join(headers, ["file", "kind"]).where(F.col("line_no") > header_no)
    frames = []
    for kind_, header in layouts:
        cols = _split_header(header)
        mapping = SALES_ENQUIRY_COLUMNS if kind_ == "enquiry" else SALES_ORDER_COLUMNS
        if not set(mapping) <= set(cols):
            continue                      # told by sales_file_problems
        schema = ", ".join(f"`c{i}` string" for i in range(len(cols)))
        parsed = (data.where((F.col("kind") == kind_) & (F.col("header") == header))
                      .select(F.from_csv("value", schema).alias("r")))
        frames.append(parsed.select(*[F.col(f"r.c{cols.index(src)}").alias(dst)
                                      for src, dst in mapping.items()]))
    if not frames:
        raise ValueError(f"No valid sales data found in {path}")
    raw = frames[0]
    for f in frames[1:]:
        raw = raw.unionByName(f)
    if stores:
        raw = raw.where(F.col("store").isin(list(stores)))
    else:
        raw = raw.where(F.col("store").isNotNull() & (F.col("store") != ""))
    d = F.trim("date")
    q = F.trim("qty").try_cast("double")
    out = raw.select(
        "store", normalize_product(F.col("product"), aliases or {}).alias("product"),
        F.coalesce(*[F.to_date(F.try_to_timestamp(d, F.lit(fmt))) for fmt in SALES_DATE_FORMATS])
        .alias("date"),
        (q if drop_bad else F.coalesce(q, F.lit(0.0))).alias("qty"))
    if drop_bad:
        out = out.where(F.col("date").isNotNull() & F.col("qty").isNotNull())
    return out.dropDuplicates(["store", "product", "date", "qty"]) if dedup else out


def sales_file_problems(spark: SparkSession, path: str) -> DataFrame:
    """Sales files under ``path`` that ``read_sales_files`` cannot read: ``file, missing``."""
    lines = numbered_lines(spark, path)
    for p in OUTPUT_PREFIXES:
        lines = lines.where(~F.col("file_name").startswith(p))
    first = F.regexp_replace(F.col("value"), f"^{BOM}", "")
    enquiry = F.max(F.when(F.col("line_no") == 1, first.contains(ENQUIRY_MARKER)))
    heads = lines.where(F.col("line_no") <= 2).groupBy("file").agg(
        enquiry.alias("enquiry"), F.max(F.when(F.col("line_no") == 1, first)).alias("one"),
        F.max(F.when(F.col("line_no") == 2, first)).alias("two"))
    header = F.coalesce(F.when(F.col("enquiry"), F.col("two")).otherwise(F.col("one")), F.lit(""))
    names = F.transform(F.split(F.regexp_replace(header, '"', ""), ","), F.trim)
    wanted = F.when(F.col("enquiry"), F.array(*[F.lit(c) for c in SALES_ENQUIRY_COLUMNS])) \
              .otherwise(F.array(*[F.lit(c) for c in SALES_ORDER_COLUMNS]))
    missing = F.array_join(F.array_except(wanted, names), ", ")
    return heads.select("file", missing.alias("missing")).where(F.col("missing") != "")


def import_rows(spark: SparkSession, path: str, required: tuple[str, ...],
                delimiter: str | None = ",") -> tuple[DataFrame, DataFrame]:
    """A7-A11 text side: import files -> (rows, header_problems).

    Leading title rows are skipped (A10); the header is matched
    case-insensitively without BOM (A11).  ``rows``: ``file, line_no`` and
    one string column per header field (lower-cased names); record numbers
    count from the header (= 1) as the reference does.  Files missing a
    required column produce one row in ``header_problems`` and no data.
    """
    return import_rows_from_lines(spark, numbered_lines(spark, path, skip_blank=True), required,
                                  delimiter)


def import_rows_from_lines(spark: SparkSession, lines: DataFrame, required: tuple[str, ...],
                           delimiter: str | None = ",") -> tuple[DataFrame, DataFrame]:
    """``import_rows`` over already numbered lines (``file, line_no, value``).
    ``delimiter=None`` sniffs it per header layout (A9)."""
    title = is_title_row(F.col("value"))
    first_real = lines.where(~title).groupBy("file").agg(F.min("line_no").alias("hdr_no"))
    j = lines.join(first_real, "file")
    headers = j.where(F.col("line_no") == F.col("hdr_no")).select("file", F.col("value").alias("header"))
    problems, frames = [], []
    for r in headers.select("header").distinct().collect():
        sep = delimiter or sniff_delimiter(r["header"])
        cols = [c.strip().lstrip(BOM).lower() for c in _split_header(r["header"], sep)]
        missing = [c for c in required if c not in cols]
        if missing:
            problems.append((r["header"], ", ".join(missing)))
            continue
        schema = ", ".join(f"`c{i}` string" for i in range(len(cols)))
        part = (j.join(headers, "file").where((F.col("header") == r["header"])
                                              & (F.col("line_no") > F.col("hdr_no")))
                 .select("file", (F.col("line_no") - F.col("hdr_no") + 1).alias("line_no"),
                         F.from_csv("value", schema, {"sep": sep}).alias("r")))
        frames.append(part.select("file", "line_no",
                                  *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(cols)]))
    rows = None
    for f in frames:
        rows = f if rows is None else rows.unionByName(f, allowMissingColumns=True)
    bad = headers.join(spark.createDataFrame(problems or [("", "")], "header string, missing string"),
                       "header").where(F.col("missing") != "")
    return rows, bad.select("file", "missing")


def read_par_levels(spark: SparkSession, path: str, normalize: bool = False,
                    store_names: dict | None = None, aliases: dict | None = None) -> DataFrame:
    """Par levels ``store, product, max_qty`` from a CSV export of the
    par sheet (header row, then store, product, max quantity).

    Rows missing any of the three are skipped.  ``normalize=False`` keeps
    raw names and whole numbers (batch side); ``normalize=True`` maps store
    names to codes, normalises product names and keeps fractional values,
    dropping unparsable quantities (seed side).
    """
    raw = spark.read.option("header", True).csv(path)
    c = raw.columns[:3]
    r = raw.select(F.col(c[0]).alias("store"), F.col(c[1]).alias("product"),
                   F.col(c[2]).alias("max_qty"))
    r = r.where(F.col("store").isNotNull() & (F.trim("store") != "") & F.col("product").isNotNull()
                & (F.trim("product") != "") & F.col("max_qty").isNotNull())
    q = F.trim("max_qty").try_cast("double")
    if not normalize:
        return r.select("store", "product", q.cast("long").alias("max_qty")).where(F.col("max_qty").isNotNull())
    from ..operators.lanes import _lookup
    store = F.coalesce(_lookup(store_names or {}, F.trim("store")), F.trim("store"))
    return r.select(store.alias("store"), normalize_product(F.col("product"), aliases or {}).alias("product"),
                    q.alias("max_qty")).where(F.col("max_qty").isNotNull())
