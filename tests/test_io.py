"""CSV ingestion, import validation, versioned tables, streaming import."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from larder.operators import imports as IM
from larder.sources import csv_files as CF
from larder.sources import sinks
from larder.streaming.imports import start_usage_import


def _dir():
    return tempfile.mkdtemp(prefix="larder-test-", dir="/tmp")


def test_sales_files_header_driven(spark):
    d = _dir()
    with open(os.path.join(d, "enquiry.csv"), "w") as f:
        f.write("Sales Enquiry as of 03/14/2026,,,,,\n")
        f.write("Order No.,Order Date,Warehouse,Customer,Product,Quantity\n")
        f.write('1,3/1/2026,W,Gardena, Whole Milk ,4\n')
        f.write('2,3/1/2026,W,Gardena,Whole Milk,4\n')            # exact duplicate after trim
        f.write('3,3/2/2026,W,KTOWN,Oat Milk,\n')                 # blank quantity -> 0
        f.write('4,3/2/2026,W,Elsewhere,Oat Milk,9\n')            # other store dropped
        f.write(',,,,Totals,99\n')
    with open(os.path.join(d, "enquiry_no_wh.csv"), "w") as f:    # lacks a column
        f.write("Sales Enquiry as of 03/15/2026,,,,\n")
        f.write("Order No.,Order Date,Customer,Product,Quantity\n")
        f.write('5,3/3/2026,KTOWN,Cup 12oz,"20"\n')
    with open(os.path.join(d, "orders.csv"), "w", encoding="utf-8-sig") as f:
        f.write("CustomerName,ProductDescription,OrderDate,OrderQuantity\n")
        f.write("Gardena,Espresso Beans,2026-03-04,2\n")
    with open(os.path.join(d, "packing_list_Gardena_2026-03-14.csv"), "w") as f:
        f.write("Product,03/14/2026\nX,1\n")
    df = CF.read_sales_files(spark, d, stores=("Gardena", "KTOWN"))
    got = sorted((r.store, r.product, r.date.isoformat(), r.qty) for r in df.collect())
    assert got == [("Gardena", "Espresso Beans", "2026-03-04", 2.0),
                   ("Gardena", "Whole Milk", "2026-03-01", 4.0),
                   ("KTOWN", "Cup 12oz", "2026-03-03", 20.0),
                   ("KTOWN", "Oat Milk", "2026-03-02", 0.0)]


def test_import_validation_rules(spark):
    d = _dir()
    with open(os.path.join(d, "usage.csv"), "w") as f:
        f.write(",,,\n")                                          # title row skipped
        f.write("﻿Store_Code,SKU,usage_date,quantity_used,notes\n")
        f.write("gardena,milk-whl,2026-03-01,5,  ok  \n")         # line 2: valid (case-insensitive)
        f.write("NOPE,MILK-WHL,2026-03-01,5,\n")                  # 3 unknown store
        f.write("GARDENA,NOPE,2026-03-01,5,\n")                   # 4 unknown sku
        f.write("GARDENA,MILK-WHL,31/31/2026,5,\n")               # 5 invalid date
        f.write("GARDENA,MILK-WHL,2099-01-01,5,\n")               # 6 future
        f.write("GARDENA,MILK-WHL,03/02/2026,NaN,\n")             # 7 NaN
        f.write("GARDENA,MILK-WHL,03-02-2026,inf,\n")             # 8 inf
        f.write("GARDENA,MILK-WHL,2026-03-02,-1,\n")              # 9 negative
        f.write("GARDENA,MILK-WHL,2026-03-02,1000000,\n")         # 10 too large
        f.write("GARDENA,MILK-WHL,2026-03-03,7,\n")               # 11 valid
        f.write("GARDENA,MILK-WHL,2026-03-03,8,\n")               # 12 valid, beyond the notice of 10: flagged, not cut
    rows, bad = CF.import_rows(spark, d, ("store_code", "sku", "usage_date", "quantity_used"))
    assert bad.count() == 0
    stores = spark.createDataFrame([(1, "GARDENA")], "id long, code string")
    items = spark.createDataFrame([(1, "MILK-WHL")], "id long, sku string")
    chk = IM.validate(rows, stores, items, dt.date(2026, 3, 14), row_notice=10)
    got = {r.line_no: (r.status, r.reason) for r in chk.collect()}
    assert got[2] == ("imported", None) and got[11] == ("imported", None)
    assert [got[i][1] for i in range(3, 11)] == ["unknown_store", "unknown_sku", "invalid_date",
                                                "future_date"] + ["invalid_quantity"] * 4
    assert got[12] == ("imported", None) and chk.where("line_no = 12").first().over_notice
    s = IM.import_summary(chk).first()
    assert (s.imported, s.skipped, s.row_limit_exceeded) == (3, 8, True)
    assert chk.where("line_no = 2").first().notes == "ok"


def test_shared_folder_is_required():
    from larder.session import _scratch
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            _scratch(master)


def test_lookup_takes_one_active_id(spark):
    rows = spark.createDataFrame([("f", 2, "a ", "X", "2026-03-01", "1")],
                                 "file string, line_no long, store_code string, sku string, "
                                 "usage_date string, quantity_used string")
    stores = spark.createDataFrame([(1, "A", True), (2, "a", True), (3, "A", False)],
                                   "id long, code string, active boolean")
    items = spark.createDataFrame([(5, "x", True)], "id long, sku string, active boolean")
    got = IM.validate(rows, stores, items, dt.date(2026, 3, 14)).collect()
    assert [(r.store_id, r.item_id) for r in got] == [(2, 5)]


def test_blank_lines_and_unread_files(spark):
    d = _dir()
    with open(os.path.join(d, "u.csv"), "w") as f:
        f.write('"store;code";sku;usage_date;quantity_used\n\nA;X;2026-03-01;1\n   \nB;Y;2026-03-01;2\n')
    rows, bad = CF.import_rows(spark, d, ("store;code", "sku"), delimiter=";")
    assert sorted((r.line_no, r.sku) for r in rows.collect()) == [(2, "X"), (3, "Y")]
    assert bad.count() == 0
    assert [r.missing for r in CF.sales_file_problems(spark, d).collect()] == [
        "CustomerName, ProductDescription, OrderDate, OrderQuantity"]


def test_missing_header_reported(spark):
    d = _dir()
    with open(os.path.join(d, "bad.csv"), "w") as f:
        f.write("store_code,sku,quantity_used\nA,B,1\n")
    rows, bad = CF.import_rows(spark, d, ("store_code", "sku", "usage_date", "quantity_used"))
    assert rows is None and bad.first().missing == "usage_date"


def test_versioned_table_and_stream(spark):
    d, table, ck = _dir(), _dir() + "/usage", _dir() + "/ck"
    stores = spark.createDataFrame([(1, "GARDENA")], "id long, code string")
    items = spark.createDataFrame([(1, "MILK-WHL")], "id long, sku string")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("store_code,sku,usage_date,quantity_used\nGARDENA,MILK-WHL,2026-03-01,5\n"
                "GARDENA,MILK-WHL,2026-03-01,6\n")                 # last row of the file wins
    q = start_usage_import(spark, d, stores, items, dt.date(2026, 3, 14), table, ck, available_now=True,
                           incremental=False)
    q.awaitTermination(120)
    t = sinks.read_latest(spark, table)
    assert [(r.usage_date.isoformat(), r.quantity_used) for r in t.collect()] == [("2026-03-01", 6.0)]
    v1 = sinks.write_version(t.withColumn("quantity_used", F.lit(1.0)), table)
    assert v1.endswith("v=2") and sinks.read_latest(spark, table).first().quantity_used == 1.0


def test_orders_layout_sniffed_and_name_first(spark):
    d = _dir()
    with open(os.path.join(d, "orders.txt"), "w") as f:
        f.write("store_code;sku;order_date;quantity_ordered\n")
        f.write("K-Town;Oat Milk;2026-03-01;3\n")                 # names, not codes
        f.write("KTOWN;MILK-OAT;2026-03-02;4\n")                  # codes
    assert CF.sniff_delimiter("a;b;c|d") == ";" and CF.sniff_delimiter("a\tb\tc") == "\t"
    rows, bad = CF.import_rows(spark, d, ("store_code", "sku", "order_date", "quantity_ordered"),
                               delimiter=None)
    stores = spark.createDataFrame([(2, "K-Town", "KTOWN")], "id long, name string, code string")
    items = spark.createDataFrame([(2, "Oat Milk", "MILK-OAT")], "id long, item_name string, sku string")
    chk = IM.validate(rows, stores, items, dt.date(2026, 3, 14), date_col="order_date",
                      qty_col="quantity_ordered", name_first=True)
    got = sorted((r.line_no, r.status, r.store_id, r.item_id, r.quantity) for r in chk.collect())
    assert got == [(2, "imported", 2, 2, 3.0), (3, "imported", 2, 2, 4.0)]
