"""Tasks whose rows stay bounded, and joins that leave a file's records where they are."""

import datetime as dt
import re

from pyspark.sql import functions as F

from larder.operators import catalogue as CT
from larder.operators import imports as IM
from larder.operators import reports as RT
from larder.sources import derived as D
from larder.sources import records as RC

DAY = dt.date(2026, 3, 14)


def _most(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_normalized_demand_in_bounded_tasks(spark):
    closure = CT.alias_closure(spark.createDataFrame(
        [("p1", "p0"), ("p2", "p1"), ("p9", "p8")], "variant string, target string"))
    rows = [("S%d" % (i % 3), " p%d" % (i % 40) if i % 50 else None, DAY + dt.timedelta(days=i % 25),
             float(i)) for i in range(2000)]
    lines = spark.createDataFrame(rows, "store string, product string, date date, qty double")
    few = CT.normalized_demand(lines, closure, task_rows=100)
    canonical = {"p1": "p0", "p2": "p0", "p9": "p8"}
    want = {}
    for store, product, date, qty in rows:
        name = product and canonical.get(product.strip(), product.strip())
        want[store, name, date] = want.get((store, name, date), 0.0) + qty
    assert {(r.store, r["product"], r.date): r.qty for r in few.collect()} == want
    assert _most(few) < 250 < len(want) / 2


def _plan_tables(spark, folder):
    ship = lambda i: dt.datetime(1995, 1, 1) + dt.timedelta(days=(i + i // 60) % 30)
    spark.createDataFrame(
        [(i // 4, i % 4, i % 60 if i % 70 else None, i % 7, float(i % 50), 0.05, "ANR"[i % 3], ship(i))
         for i in range(2000)] + [(1, 0, 4, 4, 4.0, 0.09, "A", ship(4))],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
        "l_discount double, l_returnflag string, l_shipdate timestamp_ntz"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, ship(i), ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")[i % 4])
                           for i in range(500)],
                          "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string"
                          ).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_plan_lines_and_pick_list_in_bounded_tasks(spark, tmp_path):
    folder = _plan_tables(spark, str(tmp_path))
    plain, few = D.plan_lines(spark, folder), D.plan_lines(spark, folder, task_rows=100)
    assert sorted(map(str, few.collect())) == sorted(map(str, plain.collect()))
    assert _most(few) < 250 < plain.count() / 2
    # the sums find a plan's lines of an item where they are
    items = spark.createDataFrame(
        [(i, f"name {i}", f"P-{i}", "C%d" % (i % 2)) for i in range(55)]
        + [(3, "name 3", "P-3", "C1"), (5, None, "P-5", "C1"), (None, "none", "P-", "C0")],
        "id long, item_name string, sku string, category string")
    got = RT.pick_list(few, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(plan_id" in plan and len(re.findall(r"hashpartitioning\(plan_id", plan)) == 1
    for of in ({}, {"category": "C1"}, {"search": " NAME 1"}):
        chosen = items.where((F.col("category") == of["category"]) if "category" in of else
                             F.col("item_name").ilike("%name 1%") if "search" in of else F.lit(True))
        want = (plain.join(chosen.withColumnRenamed("id", "item_id"), "item_id")
                .groupBy("plan_id", "item_id", "item_name", "sku", "category")
                .agg(F.sum("recommended_quantity"), F.sum(F.coalesce("actual_quantity", F.lit(0.0))),
                     F.count(F.lit(1))))
        got = RT.pick_list(few, items, **of)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_records_stay_where_they_are(spark):
    head = "store_code,sku,usage_date,quantity_used"
    rows = [(name, i // 500 * 100, i, head if not i else f"ST{i},{hash((name, i))},2026-03-14,{i}")
            for name in ("a", "b") for i in range(6000)]
    lines = spark.createDataFrame(rows, "file string, start long, seq long, value string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        found, _ = RC.import_records(lines, RC.USAGE_LAYOUTS)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[file#\d+\], \[file#\d+\]", plan)
        assert found.count() == 2 * 5999
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ids_by_code_and_name_from_one_join(spark, app):
    stores = spark.createDataFrame(
        [(1, " a ", "b", True), (2, "B", "a", True), (3, "a", "c", True), (4, "c", None, True),
         (9, "a", "b", False), (5, None, "d", True)], "id long, name string, code string, active boolean")
    rows = spark.createDataFrame([(c, "MILK-WHL", n) for c in ("a", "b", "c", "d", "x", None)
                                  for n in (True, False)],
                                 "store_code string, sku string, named boolean")
    found = IM.lookup_ids(rows, stores, app["items"], name_first=F.col("named"))
    got = {(r.store_code, r.named): r.store_id for r in found.collect()}
    assert got == {("a", True): 3, ("a", False): 2, ("b", True): 2, ("b", False): 1, ("c", True): 4,
                   ("c", False): 3, ("d", True): 5, ("d", False): 5, ("x", True): None,
                   ("x", False): None, (None, True): None, (None, False): None}
    assert len(re.findall("Join ", found._jdf.queryExecution().optimizedPlan().toString())) == 2
