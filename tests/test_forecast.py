"""Lanes, DOW, features, Holt-Winters, lifecycle: invariants and small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions.numeric import half_even
from larder.operators import demand as DM
from larder.operators import dow as DW
from larder.operators import lanes as LN
from larder.operators import models as MD
from larder.plans import plan_lifecycle as PL
from conftest import AS_OF

D0 = dt.date(2026, 1, 1)


def _daily(spark, rows):
    return spark.createDataFrame([(s, p, D0 + dt.timedelta(days=d), float(q)) for s, p, d, q in rows],
                                 "store string, product string, date date, qty double")


def test_half_even(spark):
    r = spark.range(1).select(half_even(F.lit(1.015), 2).alias("a"), half_even(F.lit(2.5), 0).alias("b"),
                              half_even(F.lit(3.5), 0).alias("c")).first()
    assert (r.a, r.b, r.c) == (1.01, 2.0, 4.0)


def test_lanes_and_identity(spark):
    rows = [("S", "daily", d, 5) for d in range(100)]
    rows += [("S", "inter", d, 4) for d in range(0, 100, 5)]          # 20% of days
    rows += [("S", "monthly", d, 9) for d in (10, 40, 70)]             # needs the 90-day window
    rows += [("S", "dead", 0, 3), ("S", "zero", 99, 0)]
    daily = _daily(spark, rows)
    got = {r["product"]: r for r in LN.lanes(daily).collect()}
    assert got["daily"].lane == "daily"
    assert got["inter"].lane == "intermittent"
    # I3 = plain mean of the chosen window
    inter = got["inter"]
    assert abs(inter.lane_rate - inter.window_qty / inter.n_days) < 1e-12
    assert got["monthly"].window_days == 90 and got["monthly"].n_order_days == 3
    assert got["dead"].lane == "dormant" and got["zero"].lane == "dormant"


def test_dense_conserves_sum(spark):
    daily = _daily(spark, [("A", "x", d, d % 3) for d in range(0, 30, 2)] + [("B", "y", 5, 7)])
    dense = DM.dense_demand(daily)
    assert dense.count() == 2 * 29                 # global span: days 0..28
    a = {r.store: r.s for r in dense.groupBy("store").agg(F.sum("qty").alias("s")).collect()}
    b = {r.store: r.s for r in daily.groupBy("store").agg(F.sum("qty").alias("s")).collect()}
    assert a == b


def test_dow_v2_matches_direct(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(0, 6, 40)
    daily = _daily(spark, [("S", "p", d, int(q[d])) for d in range(40) if q[d] > 0])
    pred = {r.day_idx: r.pred for r in DW.dow_forecast(daily, 2).collect()}
    dates = [D0 + dt.timedelta(days=d) for d in range(40)]
    w = np.array([0.95 ** (39 - d) for d in range(40)])
    trend = np.clip(q[-22:].mean() / q.mean(), 0.3, 3.0)
    for i in range(14):
        day = D0 + dt.timedelta(days=40 + i)
        m = np.array([x.weekday() == day.weekday() for x in dates])
        expect = max(0.0, float((q[m] * w[m]).sum() / w[m].sum() * trend))
        assert abs(pred[i] - expect) < 1e-9


def test_plan_lifecycle(app, spark):
    plans = spark.createDataFrame([], "id long, plan_date date, status string, "
                                      "generated_at timestamp_ntz, generated_by_user_id long")
    lines = spark.createDataFrame([], "id long, plan_id long, store_id long, item_id long, "
                                      "recommended_quantity double, actual_quantity double, status string")
    out = PL.generate_plan(plans, lines, app["usage"], app["orders"], app["snapshots"], app["settings"],
                           app["items"], AS_OF, plan_id=7)
    assert out["lines"].count() == 8 and out["stats"].first().lines == 8
    with pytest.raises(PL.PlanError):
        PL.generate_plan(out["plans"], out["lines"], app["usage"], app["orders"], app["snapshots"],
                         app["settings"], app["items"], AS_OF, plan_id=8)
    again = PL.generate_plan(out["plans"], out["lines"], app["usage"], app["orders"], app["snapshots"],
                             app["settings"], app["items"], AS_OF, plan_id=8, regenerate=True)
    assert again["plans"].count() == 1 and again["lines"].count() == 8
    lines2 = again["lines"]
    ids = {(r.store_id, r.item_id): r.id for r in lines2.collect()}
    assert len(set(ids.values())) == 8 and None not in ids.values()
    assert lines2.where("explanation_text IS NULL").count() == 0
    one, two = ids[1, 1], ids[1, 2]
    nan = float("nan")
    ev = spark.createDataFrame([(one, "picked", 5.0, "x" * 600, dt.datetime(2026, 3, 14, 9)),
                                (one, "loaded", None, None, dt.datetime(2026, 3, 14, 10)),
                                (two, "lost", None, None, dt.datetime(2026, 3, 14, 9)),
                                (two, None, nan, None, dt.datetime(2026, 3, 14, 9)),
                                (two, None, float("inf"), None, dt.datetime(2026, 3, 14, 9)),
                                (two, None, None, None, dt.datetime(2026, 3, 14, 9)),
                                (-99, "picked", None, None, dt.datetime(2026, 3, 14, 9))],
                               "line_id long, status string, actual_quantity double, picker_note string, "
                               "changed_at timestamp")
    up = PL.update_line_status(lines2, ev)
    line = up["lines"].where(F.col("id") == one).first()
    assert (line.status, line.actual_quantity, line.picker_note) == ("loaded", 5.0, "x" * 600)
    assert up["lines"].where(F.col("id") == two).first().status == "pending"
    assert sorted(r.reject_reason for r in up["rejected"].collect()) == [
        "invalid_quantity", "invalid_quantity", "invalid_status", "nothing_to_change", "unknown_line"]
    audit = [(r.old_value, r.new_value, r.note_too_long)
             for r in up["audit"].orderBy("changed_at").collect()]
    assert audit == [("pending", "status: pending -> picked; actual_qty: None -> 5.0; note updated",
                      True), ("picked", "status: picked -> loaded", False)]
    bulk = PL.bulk_update_status(lines2, ev.select("line_id"), "delivered", dt.datetime(2026, 3, 15))
    assert bulk["lines"].where("status = 'delivered'").count() == 2 and bulk["audit"].count() == 3
    gone = PL.delete_draft_plan(again["plans"], again["lines"], 7)
    assert gone["plans"].count() == 0 and gone["lines"].count() == 0


def test_lit_value_only_for_tagged_columns(spark):
    from larder.functions.calendar import date_lit, lit_value
    assert lit_value(date_lit(D0)) == D0
    assert lit_value(F.lit(D0)) is None          # plain literals carry no value


def test_backfill_fills_days_without_sales(spark):
    from larder.plans import forecast_run as FR
    rows = [("A", "x", d, 1 + d % 3) for d in range(90)]
    rows += [("A", "rare", d, 4) for d in range(0, 90, 6)] + [("A", "dead", 0, 1)]
    daily = _daily(spark, rows)
    history = spark.createDataFrame(
        [("A", p, D0 + dt.timedelta(days=79), 1.0) for p in ("x", "rare", "dead")],
        "store string, product string, date date, predicted double")
    weights = {"dow": 1.0, "exp": 0.0, "gbt": 0.0}
    got = {(r["product"], (r["date"] - D0).days): r for r in
           FR.backfill(history, daily, weights, use_gbt=False).collect()}
    assert len(got) == 3 * 10                          # every series, every day after the history
    assert got["x", 85].actual == 2 and got["rare", 85].actual == 0 and got["dead", 85].actual == 0
    assert all(got["dead", d].predicted == 0 for d in range(80, 90))
    window = [4 if d % 6 == 0 else 0 for d in range(80)][-28:]
    orders = [q for q in window if q]
    expected = round(len(orders) / 28 * sum(orders) / len(orders), 2)
    assert got["rare", 83].predicted == expected
    r = got["rare", 84]
    assert r.error == round(expected - 4, 2) and r.model_version == "v2_backfill"
