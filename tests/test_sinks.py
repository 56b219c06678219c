"""Packing-list and feedback exports, par levels: written, read back and compared."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from larder.operators import evaluate as EV
from larder.sources import csv_files as CF
from larder.sources import sinks

D0 = dt.date(2026, 3, 14)


def _dir():
    return tempfile.mkdtemp(prefix="larder-test-", dir="/tmp")


def test_packing_lists_keep_their_order_over_files(spark):
    dates = [D0 + dt.timedelta(days=i) for i in range(2)]
    rows = [(s, f"p{i:03d}", j, d, float((i * 7) % 50 + j), float((i * 7) % 50 * 2 + 1),
             float((i * 7) % 50 * 2 + 1), 9.0 if i % 2 else None)
            for s, n in (("big", 300), ("small", 2)) for i in range(n) for j, d in enumerate(dates)]
    plist = spark.createDataFrame(rows, "store string, product string, day_idx int, date date, "
                                        "qty double, total double, capped_total double, par double")
    par = spark.createDataFrame([("big", "p001", 5), ("big", "unpacked", 4), ("small", "zero", 0)],
                                "store string, product string, max_qty long")
    out = _dir() + "/lists"
    table = sinks.packing_list_table(plist, dates, par)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_packing_lists(table, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len([f for f in os.listdir(out + "/store=big") if f.endswith(".csv")]) > 1
    got = [(r["Product"], r["03/14/2026"], r["2-Week Total"], r["Max (Par)"]) for r in
           sinks.read_packing_list(spark, out, "big").orderBy("file", "row").collect()]
    totals = {p: t for s, p, *_, t, _ in [(*r[:6], r[6], r[7]) for r in rows] if s == "big"}
    want = sorted(totals, key=lambda p: (-totals[p], p))
    assert [g[0] for g in got] == [*want, "DAILY TOTAL", "unpacked"]
    first = int(want[0][1:]) * 7 % 50
    assert got[0][1:] == (str(first), str(int(totals[want[0]])), "9" if int(want[0][1:]) % 2 else None)
    daily = sum((i * 7) % 50 for i in range(300))
    assert got[-2][1] == str(daily) and got[-2][2] == str(2 * daily + 300)
    assert got[-1] == ("unpacked", None, "0", "4")
    zero = [r for r in got if r[1] is None and r[0].startswith("p")]
    assert zero and all(int(r[0][1:]) * 7 % 50 == 0 for r in zero)          # blank is zero


def test_feedback_export_reads_back(spark):
    rows = [("A", "x", D0 - dt.timedelta(days=i), 5.0, 4.0 if i else None, "low", "m") for i in range(5)]
    history = spark.createDataFrame(rows, "store string, product string, date date, predicted double, "
                                          "actual double, volume_tier string, model_version string")
    history = history.withColumn("error", F.col("predicted") - F.col("actual")) \
                     .withColumn("recorded_at", F.col("date").cast("timestamp_ntz"))
    out = _dir()
    sinks.export_feedback(history, out)
    got = sinks.read_feedback_export(spark, out, 2026).orderBy("date").collect()
    assert [(r.date, r.predicted, r.actual, r.error) for r in got if r.actual is not None] == [
        (D0 - dt.timedelta(days=i), 5.0, 4.0, 1.0) for i in (4, 3, 2, 1)]
    assert spark.read.option("header", True).csv(out + "/accuracy_summary").count() >= 1
    assert spark.read.option("header", True).csv(out + "/confidence").count() >= 1


def test_par_levels_of_both_sides(spark):
    d = _dir()
    with open(os.path.join(d, "par.csv"), "w") as f:
        f.write("Store,Product,Max\nGardena,Whole Milk,4\nK-Town, Oat Milk ,2.5\n,Cup,3\nGardena,,3\n"
                "Gardena,Tea,many\nGardena,Cup,\n")
    raw = {(r.store, r.product): r.max_qty for r in CF.read_par_levels(spark, d).collect()}
    assert raw[("Gardena", "Whole Milk")] == 4 and ("Gardena", "Tea") not in raw
    seed = CF.read_par_levels(spark, d, normalize=True, store_names={"K-Town": "KTOWN"},
                              aliases={"Whole Milk": "Milk"})
    assert sorted((r.store, r.product, r.max_qty) for r in seed.collect()) == [
        ("Gardena", "Milk", 4.0), ("KTOWN", "Oat Milk", 2.5)]


def test_product_weights_by_hand(spark):
    rows = [("A", p, D0 + dt.timedelta(days=i), 10.0, "daily", 10.0 + e, 10.0 - 2 * e,
             None if p == "nogbt" else 10.0 + 4 * e)
            for p, n, e in (("x", 7, 1), ("nogbt", 8, 2), ("few", 6, 1), ("exact", 7, 0)) for i in range(n)]
    bt = spark.createDataFrame(rows, "store string, product string, date date, actual double, lane string, "
                                     "pred_dow double, pred_exp double, pred_gbt double")
    got = {r["product"]: (r["dow"], r["exp"], r["gbt"]) for r in
           EV.product_weights(bt, {"gbt": 0.4}).collect()}
    assert set(got) == {"x", "nogbt", "exact"}
    assert got["x"] == (0.571, 0.286, 0.143)                 # 1 : 1/2 : 1/4
    assert got["nogbt"] == (0.476, 0.238, 0.286)             # 0.4 of the others' sum
    assert got["exact"] == (0.333, 0.333, 0.333)             # errors of zero count as 0.001
