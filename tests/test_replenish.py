"""Replenishment rules: the reference's unit assertions as DataFrame tests."""

import datetime as dt

from pyspark.sql import functions as F

from larder.config import AppParams
from larder.operators import replenish as RP
from conftest import AS_OF


def _recs(app, params=None, **over):
    t = dict(app, **over)
    return RP.build_recommendations(t["usage"], t["orders"], t["snapshots"], t["settings"],
                                    t["items"], AS_OF, params or AppParams())


def test_rounding_rules(spark):
    rows = [(3.2, "round_up_integer", 1), (5.0, "round_up_case_pack", 4), (8.0, "round_up_case_pack", 4),
            (3.2, "none", 1), (0.0, "round_up_integer", 1), (-1.0, "round_up_case_pack", 4),
            (3.0, "round_up_case_pack", 0)]
    df = spark.createDataFrame(rows, "q double, rule string, cp int")
    got = [r[0] for r in df.select(RP.apply_rounding(F.col("q"), F.col("rule"), F.col("cp"))).collect()]
    assert got == [4.0, 8.0, 8.0, 3.2, 0.0, 0.0, 3.0]


def test_coverage(spark):
    df = spark.createDataFrame([(3, 7), (3, 0), (10, 7)], "p int, w int")
    got = [r[0] for r in df.select(RP.coverage(F.col("p"), F.col("w"))).collect()]
    assert abs(got[0] - 3 / 7) < 1e-12 and got[1] == 0.0 and got[2] == 1.0


def test_worked_example(app):
    r = {(x.store_id, x.item_id): x for x in _recs(app).collect()}
    assert len(r) == 8
    for s in (1, 2):
        assert [r[(s, i)].recommended_quantity for i in (1, 2, 3, 4)] == [12.0, 12.0, 12.0, 20.0]
        for i in (1, 2, 3, 4):
            x = r[(s, i)]
            assert x.confidence_level == "high"
            assert x.lane == "daily"
            assert x.on_hand == 0.0          # 3 - 5 x 1 day, floored at 0
            assert x.forecast_avg_daily_usage == 5.0 and x.data_points == 7
            assert "unusual_recommendation" not in x.warning_flags   # 20 is not > 2 x par


def test_no_data_falls_back_to_par(app, spark):
    empty = app["usage"].limit(0)
    r = _recs(app, usage=empty, snapshots=app["snapshots"].limit(0)).where("item_id = 1").collect()
    for x in r:
        assert x.forecast_avg_daily_usage == 10.0      # par fallback
        assert x.confidence_level == "low"
        assert x.recommended_quantity == 12.0          # target 12, case pack 4
        assert {"sparse_usage_history", "low_confidence", "missing_snapshot"} <= set(x.warning_flags)


def test_missing_snapshot_downgrades(app):
    r = _recs(app, snapshots=app["snapshots"].limit(0)).collect()
    assert {x.confidence_level for x in r} == {"medium"}
    assert all("missing_snapshot" in x.warning_flags for x in r)


def test_min_send_enforced(app, spark):
    settings = app["settings"].withColumn("par_level", F.lit(5.0)).withColumn("safety_stock", F.lit(0.0)) \
        .withColumn("min_send_quantity", F.lit(10.0)).withColumn("rounding_rule", F.lit("none"))
    snaps = app["snapshots"].withColumn("quantity_on_hand", F.lit(4.0))
    r = _recs(app, settings=settings, snapshots=snaps).collect()
    assert all(x.recommended_quantity >= 10 for x in r)


def test_orders_take_priority(app, spark):
    orders = spark.createDataFrame([(1, 1, AS_OF - dt.timedelta(days=1), 9.0)],
                                   "store_id long, item_id long, order_date date, quantity_ordered double")
    p = AppParams()
    sw = RP.setting_windows(app["settings"], p)
    from larder.operators.demand import overlay_demand
    ov = overlay_demand(app["usage"], orders, AS_OF, 60)
    st = RP.pair_statistics(sw, ov, F.lit(AS_OF), p).where("store_id = 1 AND item_id = 1").first()
    assert st.n_s == 7 and abs(st.avg_s - (6 * 5 + 9) / 7) < 1e-12 and st.src_s == "blended"


def test_weighted_average(app, spark):
    rising = spark.createDataFrame(
        [(1, 1, AS_OF - dt.timedelta(days=d), float(8 - d)) for d in range(1, 8)],
        "store_id long, item_id long, usage_date date, quantity_used double")
    from larder.operators.demand import overlay_demand
    ov = overlay_demand(rising, app["orders"], AS_OF, 60)
    sw = RP.setting_windows(app["settings"].where("store_id = 1 AND item_id = 1"), AppParams())
    simple = RP.pair_statistics(sw, ov, F.lit(AS_OF), AppParams(), decay=1.0).first()
    decayed = RP.pair_statistics(sw, ov, F.lit(AS_OF), AppParams(), decay=0.8).first()
    assert abs(simple.wavg_s - simple.avg_s) < 1e-12
    assert decayed.wavg_s > simple.avg_s


def test_dow_matches(app, spark):
    from larder.operators.demand import overlay_demand
    ov = overlay_demand(app["usage"], app["orders"], AS_OF, 60)
    sw = RP.setting_windows(app["settings"].where("store_id = 1 AND item_id = 1"),
                            AppParams()).withColumn("ws", F.lit(7)).withColumn("wl", F.lit(14))
    st = RP.pair_statistics(sw, ov, F.lit(AS_OF), AppParams(), dow_multiplier=0.5).first()
    assert st.dowm_s == 1


def test_plan_stats(app):
    s = RP.plan_stats(_recs(app)).first()
    assert s.lines == 8 and s.stores == 2 and s.zero_skipped == 0


def test_explanation_text(app):
    x = _recs(app).where("store_id = 1 AND item_id = 1").first()
    assert x.explanation_text.startswith("Based on 30-day average usage history. On-hand: 3.00 (as of ")
    assert "projected to 0.00" in x.explanation_text
    assert x.explanation_text.endswith("Rounded up to case pack of 4.")
