"""CSV records of any layout in one parallel pass.

Huge files stay split, so no task may need what stands before its split:

* **Records.**  A line break inside quotes does not end a record.  A line
  opens a record if an even number of quotes stand before it in its file.
  Each split (file, start) numbers its lines and counts, for both states it
  may begin in, the records it opens; the splits' states and offsets are
  running sums over the small table of splits.  Only records of several
  lines are grouped; the others go straight on.
* **Layouts.**  Each file's header (its first record that is no title row)
  is split at its most frequent delimiter, and the layout with the fewest
  missing columns is taken, the first one on ties.  Headers stay on Spark: a
  file's delimiter and column places are joined to its records, so files of
  all layouts are read by one scan and one plan, whatever their number.  They
  are stored first: the planner sees how small they are and leaves the records
  where they are, instead of bringing a file's records into one task.

A quote that is never closed would make the rest of its file one record;
records beyond ``MAX_RECORD`` characters are told as problems, not gathered.
A quote inside a field that does not begin with one counts like any other.
Blank records are skipped and get no number; a file's header is record 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .csv_files import BOM, DELIMITERS, is_title_row

MAX_RECORD = 131_072
TITLE_RECORDS = 64               # title rows stand in a file's first records

# The columns of the import layouts (canonical name: column), in order of preference.
ORDER_LAYOUTS = {
    "sales_enquiry": {"date": "order date", "store": "customer", "item": "product",
                      "quantity": "quantity"},
    "legacy": {"store": "store_code", "item": "sku", "date": "order_date",
               "quantity": "quantity_ordered"},
}
USAGE_LAYOUTS = {"usage": {"store": "store_code", "item": "sku", "date": "usage_date",
                           "quantity": "quantity_used"}}
SNAPSHOT_LAYOUTS = {"snapshot": {"store": "store_code", "item": "sku", "date": "snapshot_date",
                                 "quantity": "quantity_on_hand"}}
OPTIONAL = {"notes": "notes"}
WITHOUT_NOTES = ("sales_enquiry",)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, seq, value``: the lines of every file, by split and order in it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"), "value")


def _quotes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def records(lines: DataFrame, max_record: int = MAX_RECORD,
            store=materialize) -> tuple[DataFrame, DataFrame]:
    """(``file, record, value``, problems ``file, record, chars``) of numbered lines.

    ``record`` counts a file's records that are not blank from 1.  The lines
    with their places in their split are stored once: the text is read and
    shuffled once, and what follows reads the columns it needs.
    """
    split = ["file", "start"]
    before = Window.partitionBy(*split).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*split).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    quotes, blank = _quotes(F.col("value")) % 2, F.trim("value") == ""
    local = lines.withColumn("_odd", F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2)
    opens = [((F.col("_odd") == h) & ~blank).cast("long") for h in (0, 1)]
    local = local.withColumns({"_open0": F.sum(opens[0]).over(upto),
                               "_open1": F.sum(opens[1]).over(upto)})
    local = store(local, "numbered-lines")
    # what each split does to the state it begins in, and how many records it opens
    splits = local.groupBy(*split).agg(
        (F.max_by(F.col("_odd") + quotes, "seq") % 2).alias("_flip"),
        F.max("_open0").alias("_n0"), F.max("_open1").alias("_n1"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = splits.withColumn("_state", F.coalesce(F.sum("_flip").over(earlier), F.lit(0)) % 2)
    opened = F.when(F.col("_state") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    splits = splits.withColumn("_base", F.coalesce(F.sum(opened).over(earlier), F.lit(0)))
    j = local.join(splits.select(*split, "_state", "_base"), split)
    inside = (F.col("_odd") + F.col("_state")) % 2 == 1
    number = F.col("_base") + F.when(F.col("_state") == 0, F.col("_open0")).otherwise(F.col("_open1"))
    j = j.select("file", number.alias("record"), "start", "seq", "value",
                 inside.alias("_inside"), (inside != (quotes == 1)).alias("_goes_on"))
    single = j.where(~F.col("_inside") & ~F.col("_goes_on") & ~blank).select(
        "file", "record", "value")
    parts = j.where(F.col("_inside") | F.col("_goes_on"))
    sizes = parts.groupBy("file", "record").agg(F.sum(F.length("value") + 1).alias("chars"))
    whole = (parts.join(sizes.where(F.col("chars") <= max_record), ["file", "record"])
             .groupBy("file", "record").agg(F.array_join(F.transform(
                 F.sort_array(F.collect_list(F.struct("start", "seq", "value"))),
                 lambda x: x["value"]), "\n").alias("value")))
    return single.unionAll(whole), sizes.where(F.col("chars") > max_record)


def fields(value: Column, delimiter: Column) -> Column:
    """The fields of a record: plain ones are split, those with quotes are read by a pattern."""
    out = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        pattern = f'"[^"]*+(?:""[^"]*+)*+"(?=[{d}]|$)|[^{d}]*'
        # a delimiter before each field makes every field start alike
        found = F.regexp_extract_all(F.concat(F.lit(d), value), F.lit(f"[{d}](?:{pattern})"), F.lit(0))
        quoted = F.transform(found, lambda x: F.when(
            F.substring(x, 2, 1) == '"',
            F.replace(F.regexp_replace(x, f'^[{d}]"|"$', ""), F.lit('""'), F.lit('"')))
            .otherwise(F.substr(x, F.lit(2))))
        out = F.when(delimiter == d, F.when(F.contains(value, F.lit('"')), quoted).otherwise(
            F.split(value, f"[{d}]"))).otherwise(out)
    return out


def headers(recs: DataFrame, layouts: dict[str, dict[str, str]]) -> DataFrame:
    """A row a file: its header's record number, delimiter, layout, missing columns and the
    place of each canonical column (0: absent)."""
    first = recs.where(F.col("record") <= TITLE_RECORDS).withColumn(
        "value", F.regexp_replace("value", f"^{BOM}", ""))
    real = first.where(~is_title_row(F.col("value")))
    heads = real.groupBy("file").agg(F.min("record").alias("header"),
                                     F.min_by("value", "record").alias("_h"))
    bare = F.regexp_replace("_h", '"(?:[^"]|"")*"', "")
    count = [F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*count)
    delimiter = F.lit(DELIMITERS[0])
    for d, n in reversed(list(zip(DELIMITERS, count))):
        delimiter = F.when((n == most) & (most > 0), F.lit(d)).otherwise(delimiter)
    heads = heads.withColumn("delimiter", delimiter)
    names = F.transform(fields(F.col("_h"), F.col("delimiter")),
                        lambda x: F.lower(F.trim(F.regexp_replace(x, BOM, ""))))
    heads = heads.withColumn("_names", names)
    choices = []
    for rank, (name, columns) in enumerate(layouts.items()):
        missing = F.array_except(F.array(*[F.lit(c) for c in columns.values()]), F.col("_names"))
        optional = {} if name in WITHOUT_NOTES else OPTIONAL
        places = {**{k: F.array_position("_names", c).cast("int") for k, c in columns.items()},
                  **{k: F.array_position("_names", optional[k]).cast("int") if k in optional
                     else F.lit(0) for k in OPTIONAL}}
        choices.append(F.struct(
            F.size(missing).alias("n"), F.lit(rank).alias("rank"), F.lit(name).alias("layout"),
            F.array_join(missing, ", ").alias("missing"),
            *[places[k].alias(k) for k in ("store", "item", "date", "quantity", *OPTIONAL)]))
    return heads.withColumn("_best", F.array_min(F.array(*choices))).select(
        "file", "header", "delimiter", "_best.layout", "_best.missing",
        *[F.col(f"_best.{k}").alias(f"_{k}") for k in ("store", "item", "date", "quantity", *OPTIONAL)])


def import_records(lines: DataFrame, layouts: dict[str, dict[str, str]],
                   max_record: int = MAX_RECORD) -> tuple[DataFrame, DataFrame]:
    """(rows ``file, line_no, layout, store, item, date, quantity, notes``, problems
    ``file, line_no, problem``) of all files, as text; the header is record 1."""
    recs, large = records(lines, max_record)
    heads = materialize(headers(recs, layouts), "file-headers")
    data = recs.join(heads.where(F.col("missing") == ""), "file").where(
        F.col("record") > F.col("header"))
    data = data.withColumn("_f", fields(F.col("value"), F.col("delimiter")))
    rows = data.select(
        "file", (F.col("record") - F.col("header") + 1).alias("line_no"), "layout",
        *[F.when(F.col(f"_{c}") > 0, F.get("_f", F.col(f"_{c}") - 1)).alias(c)
          for c in ("store", "item", "date", "quantity", *OPTIONAL)])
    text = F.concat(F.lit("missing columns: "), F.col("missing"))
    problems = heads.where(F.col("missing") != "").select(
        "file", F.lit(1).cast("long").alias("line_no"), text.alias("problem")).unionAll(
        large.join(heads, "file", "left").select(
            "file", (F.col("record") - F.coalesce("header", F.lit(1)) + 1).alias("line_no"),
            F.lit("record too long: a quote is not closed").alias("problem")))
    return rows, problems
