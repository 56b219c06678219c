"""Sales files of all layouts, the first forecaster's and the seed's rules."""

import datetime as dt
import os
import tempfile

from larder.sources import sales as SL


def _folder(files):
    d = tempfile.mkdtemp(prefix="larder-test-", dir="/tmp")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    return d


ENQUIRY = ("Sales Enquiry as of 03/14/2026,,,,,\nOrder No.,Order Date,Warehouse,Customer,Product,Quantity\n"
           "1,3/1/2026,W,Gardena, Whole Milk ,4\n2,3/1/2026,W,Gardena,Whole Milk,4\n"
           '3,3/2/2026,"W\nest",KTOWN,Oat Milk,\n4,3/2/2026,W,Elsewhere,Oat Milk,9\n,,,,Totals,99\n')
ORDERS = ("﻿CustomerName,ProductDescription,OrderDate,OrderQuantity,Note\n"
          'Gardena,Espresso Beans,2026-03-04,2,"a, b"\nKTOWN,CS Vienna Cream,03/05/2026,,\n'
          "KTOWN,Vienna Cream,03/05/2026,x,\nKTOWN,Tea,soon,3,\n")


def _rows(df):
    return sorted((r.store, r.product, r.date.isoformat() if r.date else "", r.qty) for r in df.collect())


def test_all_layouts_in_one_pass_with_problems(spark):
    d = _folder({"enquiry.csv": ENQUIRY, "orders.csv": ORDERS, "other.csv": "a,b\n1,2\n",
                 "notes.txt": "not,a,sales,file\n", "packing_list_Gardena.csv": "Product,x\nX,1\n"})
    rows, problems = SL.read_sales(spark, d, stores=("Gardena", "KTOWN"))
    assert _rows(rows) == [
        ("Gardena", "Espresso Beans", "2026-03-04", 2.0), ("Gardena", "Whole Milk", "2026-03-01", 4.0),
        ("KTOWN", "CS Vienna Cream", "2026-03-05", 0.0), ("KTOWN", "Oat Milk", "2026-03-02", 0.0),
        ("KTOWN", "Tea", "", 3.0), ("KTOWN", "Vienna Cream", "2026-03-05", 0.0)]
    assert [(os.path.basename(r.file), r.problem) for r in problems.collect()] == [
        ("other.csv", "missing columns: customername, productdescription, orderdate, orderquantity")]
    every, _ = SL.read_sales(spark, d, dedup=False)
    assert len(_rows(every)) == 8                                  # Elsewhere and the duplicate too


def test_first_forecaster_and_seed(spark):
    d = _folder({"orders.csv": ORDERS + "Elsewhere,Tea,03/05/2026,1,\nGardena,Tea,3/6/2026,1,\n"
                                        "Gardena,Tea,3/6/2026,1,\n"})
    rows, problems = SL.read_sales_v1(spark, d)
    assert _rows(rows) == [("Gardena", "Tea", "2026-03-06", 1.0)] * 2 + [
        ("KTOWN", "Vienna Cream", "2026-03-05", 0.0)]              # merged name, blank is zero
    assert sorted((r.line_no, r.problem) for r in problems.collect()) == [
        (2, "invalid date"), (4, "invalid quantity"), (5, "invalid date")]
    rows, problems = SL.read_sales_seed(spark, d, {"Gardena": "GARDENA", "Elsewhere": "ELSE"},
                                        {"Tea": "Green Tea"})
    assert _rows(rows) == [("ELSE", "Green Tea", "2026-03-05", 1.0)] + [
        ("GARDENA", "Green Tea", "2026-03-06", 1.0)] * 2
    assert problems.count() == 0


def test_by_date_places(spark):
    rows = [("b", "x", dt.date(2026, 1, 2), 1.0), ("a", "x", dt.date(2026, 1, 2), 1.0),
            ("a", "x", dt.date(2025, 12, 31), 9.0), ("a", "x", None, 0.0)]
    df = spark.createDataFrame(rows, "store string, product string, date date, qty double")
    got = sorted((r.place, r.store, r.date) for r in SL.by_date(df).collect())
    assert got == [(1, "a", dt.date(2025, 12, 31)), (2, "a", dt.date(2026, 1, 2)),
                   (3, "b", dt.date(2026, 1, 2)), (4, "a", None)]
