"""Parallel CSV records and layouts against Python's csv module."""

import csv
import datetime as dt
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from larder.operators import imports as IM
from larder.sources import records as RC


def _lines(spark, files, split):
    """Each file's lines, dealt to splits of ``split`` lines."""
    rows = [(name, i // split * 100, i, line) for name, text in files.items()
            for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, start long, seq long, value string").repartition(5)


def _plain(text, delimiter=","):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and any(
        x.strip() for x in r)]


def _messy(seed, n=60):
    rng = random.Random(seed)
    parts = ["a", 'say ""x""', "two\nlines", "\n\n", "semi;colon", "com,ma", "tab\tbed", "", " pad "]
    rows = [["k%d" % i, *(rng.choice(parts) for _ in range(3))] for i in range(n)]
    out = []
    for r in rows:
        cells = ['"' + c + '"' if any(x in c for x in '\n",;\t"') or rng.random() < 0.2 else c for c in r]
        out.append(",".join(cells))
        if rng.random() < 0.1:
            out.append("")
    return "\n".join(["k,a,b,c", *out])


@pytest.mark.parametrize("split", [1, 2, 7, 1000])
def test_records_equal_plain_reader_for_any_splits(spark, split):
    files = {f"f{s}": _messy(s) for s in range(3)}
    recs, large = RC.records(_lines(spark, files, split))
    got = recs.withColumn("f", RC.fields(F.col("value"), F.lit(","))).collect()
    assert large.count() == 0
    for name, text in files.items():
        own = sorted((r.record, list(r.f)) for r in got if r.file == name)
        want = _plain(text)
        assert [i for i, _ in own] == list(range(1, len(want) + 1))
        assert [f for _, f in own] == want


def test_fields_of_every_delimiter(spark):
    for d in RC.DELIMITERS:
        rows = [["x", "", f"in{d}side", 'quo"te', "", "end"], ["", "", ""], ['"', '""', "z"],
                ["q" * 5 + '"' * 4000, "1", ""]]
        out = io.StringIO()
        csv.writer(out, delimiter=d, lineterminator="\n").writerows(rows)
        lines = out.getvalue().rstrip("\n").split("\n")
        df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
        got = df.orderBy("i").select(RC.fields(F.col("value"), F.lit(d)).alias("f")).collect()
        assert [list(r.f) for r in got] == rows


def test_unclosed_quote_is_told_and_not_gathered(spark):
    files = {"bad": "store_code,sku,usage_date,quantity_used\nA,B,2026-01-01,1\n\"open,B\n" + "x,y\n" * 500,
             "good": "store_code,sku,usage_date,quantity_used\nA,B,2026-01-01,1"}
    rows, problems = RC.import_records(_lines(spark, files, 50), RC.USAGE_LAYOUTS, max_record=1000)
    assert sorted((r.file, r.line_no) for r in rows.collect()) == [("bad", 2), ("good", 2)]
    assert [(r.file, r.line_no, r.problem) for r in problems.collect()] == [
        ("bad", 3, "record too long: a quote is not closed")]


def test_layouts_of_orders_usage_and_snapshots(spark):
    folder = tempfile.mkdtemp(prefix="larder-test-", dir="/tmp")
    texts = {
        "enquiry.csv": "Sales Enquiry as of 03/14/2026,,,,\n\nOrder No.,Order Date,Customer,Product,Quantity\n"
                       "1,03/01/2026,k-town,oat milk,4\n2,03/01/2026,GARDENA,MILK-WHL,\"5\"\n"
                       "3,2099-01-01,GARDENA,MILK-WHL,5\n4,03/01/2026,nobody,MILK-WHL,5\n",
        "legacy.csv": "﻿STORE_CODE;sku ;Order_Date;quantity_ordered;notes\n"
                      "gardena;milk-oat;2026-03-02;6;\"late;\nand \"\"cold\"\"\"\nK-Town;milk-oat;2026-03-02;6;\n",
        "tabs.txt": "sku\tstore_code\tquantity_ordered\torder_date\nMILK-WHL\tKTOWN\tinf\t2026-03-02\n",
        "short.csv": "store_code|sku|order_date\nGARDENA|MILK-WHL|2026-03-02\n",
        "tie.csv": "customer,sku\nGARDENA,MILK-WHL\n", "empty.csv": ""}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    stores = spark.createDataFrame([(1, "Gardena", "GARDENA"), (2, "K-Town", "KTOWN")],
                                   "id long, name string, code string")
    items = spark.createDataFrame([(1, "Whole Milk", "MILK-WHL"), (2, "Oat Milk", "MILK-OAT")],
                                  "id long, item_name string, sku string")
    rows, problems = RC.import_records(RC.text_lines(spark, folder), RC.ORDER_LAYOUTS)
    checked = IM.validate_records(rows, stores, items, dt.date(2026, 3, 14))
    got = {(os.path.basename(r.file), r.line_no): r for r in checked.collect()}
    assert {k: (r.status, r.reason, r.store_id, r.item_id, r.quantity) for k, r in got.items()} == {
        ("enquiry.csv", 2): ("imported", None, 2, 2, 4.0),       # by name
        ("enquiry.csv", 3): ("imported", None, 1, 1, 5.0),       # by code
        ("enquiry.csv", 4): ("skipped", "future_date", 1, 1, 5.0),
        ("enquiry.csv", 5): ("skipped", "unknown_store", None, 1, 5.0),
        ("legacy.csv", 2): ("imported", None, 1, 2, 6.0),
        ("legacy.csv", 3): ("skipped", "unknown_store", None, 2, 6.0),   # a name is no code here
        ("tabs.txt", 2): ("skipped", "invalid_quantity", 2, 1, None)}
    assert got["legacy.csv", 2].notes == 'late;\nand "cold"'
    told = {os.path.basename(r.file): r.problem for r in problems.collect()}
    assert told == {"short.csv": "missing columns: quantity_ordered",
                    "tie.csv": "missing columns: order date, product, quantity"}
    # snapshots take the same path (A8) and the same upsert
    with open(os.path.join(folder, "snap.csv"), "w") as f:
        f.write("store_code,sku,snapshot_date,quantity_on_hand\nGARDENA,MILK-WHL,2026-03-01,3\n"
                "GARDENA,MILK-WHL,2026-03-01,4\nGARDENA,MILK-OAT,2026-03-01,-1\n")
    rows, problems = RC.import_records(RC.text_lines(spark, os.path.join(folder, "snap.csv")),
                                       RC.SNAPSHOT_LAYOUTS)
    assert problems.count() == 0
    checked = IM.validate_records(rows, stores, items, dt.date(2026, 3, 14))
    old = spark.createDataFrame([(1, 1, dt.date(2026, 3, 1), 9.0, "seed", None),
                                 (2, 2, dt.date(2026, 3, 1), 8.0, "seed", None)],
                                "store_id long, item_id long, snapshot_date date, "
                                "quantity_on_hand double, source string, notes string")
    new = IM.upsert(old, checked, {"store_id": "store_id", "item_id": "item_id", "snapshot_date": "date"},
                    {"quantity_on_hand": "quantity", "notes": "notes"})
    assert sorted((r.store_id, r.item_id, r.quantity_on_hand) for r in new.collect()) == [
        (1, 1, 4.0), (2, 2, 8.0)]
