"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` each.

Each query reads the driver's tables through ``larder.sources`` and runs
library operators over the whole input.  Double outputs are rounded
half-even to 6 places so the DuckDB oracle (``larder.checks.oracle``) can
compare values exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.numeric import round_all
from .operators import catalogue as CT
from .operators import demand as DM
from .operators import dow as DW
from .operators import features as FT
from .operators import lanes as LN
from .operators import replenish as RP
from .operators import packing as PK
from .operators import evaluate as EV
from .operators import feedback as FB
from .operators import reports as RT
from .operators import imports as IM
from .operators import dimensions as DI
from .operators import models as MD
from .plans import forecast_run as FR
from .plans import plan_lifecycle as PL
from .config import ProductConfig
from .config import CSV_ROW_NOTICE, AppParams
from .plans.materialize import materialize
from .sources import derived as D
from .sources import records as RC
from .sources import sales as SL

Query = Callable[[SparkSession, str], DataFrame]


def _daily(spark, sf, kind):
    """Daily demand, materialised once per query (see plans.materialize)."""
    return materialize(DM.daily_demand(D.demand_lines(spark, sf, kind)), f"daily-{kind}")


def daily_demand_dense(spark, sf):
    return round_all(DM.dense_demand(_daily(spark, sf, "type")))


def data_profile(spark, sf):
    return DM.data_profile(D.demand_lines(spark, sf, "type"))


def sales_distinct(spark, sf):
    d = DM.distinct_lines(D.demand_lines(spark, sf, "brand"))
    return round_all(d.groupBy("store", "product").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("qty").alias("qty")))


def _lane_classify(kind):
    def q(spark, sf):
        s = LN.lanes(_daily(spark, sf, kind))
        return round_all(s.select("store", "product", "window_days", "n_days", "n_order_days",
                                  "zero_rate", "lane",
                                  F.coalesce("lane_rate", F.lit(0.0)).alias("lane_rate")))
    return q


def alias_closure(spark, sf):
    """The chains of written names resolved."""
    return CT.alias_closure(D.part_aliases(spark, sf))


def normalized_demand(spark, sf):
    """D1 by canonical name."""
    return round_all(CT.normalized_demand(D.part_lines(spark, sf), alias_closure(spark, sf)))


def _rules(spark, sf, kind="brand"):
    """Daily demand and the products' configuration on its last day."""
    daily = _daily(spark, sf, kind)
    last = DM.date_bound_values(daily)[1]
    return daily, ProductConfig(rules=CT.rules_at(D.product_rules(spark, sf), last))


def rules_in_force(spark, sf):
    return _rules(spark, sf)[1].rules


def rule_problems(spark, sf):
    return CT.rule_problems(D.product_rules(spark, sf)).groupBy("problem").agg(
        F.count(F.lit(1)).alias("n"))


def lane_rules(spark, sf):
    """I1, I3 and I4 with overrides and the periodic set taken from the rule table."""
    daily, pc = _rules(spark, sf, "type")
    return round_all(LN.lanes(daily, pc).select(
        "store", "product", "n_days", "n_order_days", "lane",
        F.coalesce("lane_rate", F.lit(0.0)).alias("lane_rate")))


def lane_rules_forecast(spark, sf):
    """Lane forecast and safety stock with the rule table."""
    daily, pc = _rules(spark, sf)
    first, last = DM.date_bounds(daily)
    preds = DW.lane_forecast(daily, pc, first=first, last=last)
    return round_all(PK.apply_safety_stock(preds, PK.series_stats(daily, first, last), pc))


def lane_forecast(spark, sf):
    return round_all(DW.lane_forecast(_daily(spark, sf, "brand")))


def _dow_forecast(version, kind):
    def q(spark, sf):
        return round_all(DW.dow_forecast(_daily(spark, sf, kind), version=version))
    return q


def _dow_profile(version, kind):
    def q(spark, sf):
        return round_all(DW.dow_profile(_daily(spark, sf, kind), version=version))
    return q


def _dense(spark, sf, kind):
    return DM.dense_demand(_daily(spark, sf, kind))


def feature_calendar(spark, sf):
    fm = FT.add_calendar(_dense(spark, sf, "type"))
    return round_all(fm.drop("qty"))


def feature_lags(spark, sf):
    d = _dense(spark, sf, "type")
    return round_all(d.select("store", "product", "date", "qty",
                              *[c.alias(n) for n, c in FT.lag_columns().items()]))


def feature_recency(spark, sf):
    d = _dense(spark, sf, "type")
    return round_all(d.select("store", "product", "date",
                              *[c.alias(n) for n, c in FT.recency_columns().items()]))


def feature_product(spark, sf):
    return round_all(FT.product_stats(_dense(spark, sf, "brand")))


def future_features(spark, sf):
    return round_all(FT.future_features(_dense(spark, sf, "brand")))


def recency_weights(spark, sf):
    d = _dense(spark, sf, "brand")
    rows = d.select("store", "product", "date",
                    F.lag("qty", 14).over(FT.ordered_window()).alias("l14")).where(F.col("l14").isNotNull())
    w = FT.recency_weights(rows.drop("l14"), ["store"])
    return round_all(w)


def _app(spark, sf):
    return dict(usage=D.app_usage(spark, sf), orders=D.app_orders(spark, sf),
                snapshots=D.app_snapshots(spark, sf), settings=D.app_settings(spark, sf),
                items=D.app_items(spark, sf))


def _app_stats(spark, sf, params):
    t = _app(spark, sf)
    p = F.lit(D.APP_AS_OF)
    sw = RP.setting_windows(t["settings"], params).join(
        t["items"].select(F.col("id").alias("item_id"), "item_name", "case_pack_quantity"),
        "item_id", "left")
    span = int(sw.agg(F.max(F.greatest("wl", "ws", F.lit(params.routing_window)))).first()[0]
               or params.routing_window)
    ov = DM.overlay_demand(t["usage"], t["orders"], p, span)
    return RP.pair_statistics(sw, ov, p, params)


def overlay_demand(spark, sf):
    t = _app(spark, sf)
    return round_all(DM.overlay_demand(t["usage"], t["orders"], D.APP_AS_OF,
                                       AppParams().window_long))


def avg_orders(spark, sf):
    st = _app_stats(spark, sf, AppParams())
    return round_all(st.select(
        "store_id", "item_id", F.col("avg_s").alias("avg_short"), F.col("n_s").alias("count_short"),
        F.col("src_s").alias("source_short"), F.col("avg_l").alias("avg_long"),
        F.col("n_l").alias("count_long"), F.col("src_l").alias("source_long")))


def weighted_avg_orders(spark, sf):
    st = _app_stats(spark, sf, AppParams(forecast_method="historical_weighted_v1",
                                         dow_multiplier=0.5))
    return round_all(st.select(
        "store_id", "item_id", F.col("wavg_s").alias("wavg_short"),
        F.col("n_s").alias("count_short"), F.col("dowm_s").alias("dow_matches_short"),
        F.col("wavg_l").alias("wavg_long"), F.col("n_l").alias("count_long"),
        F.col("dowm_l").alias("dow_matches_long")))


def demand_stats(spark, sf):
    st = _app_stats(spark, sf, AppParams())
    return round_all(st.select(
        "store_id", "item_id", F.col("r_zero_rate").alias("zero_rate"),
        F.col("r_avg_demand").alias("avg_demand"), F.col("r_avg_nonzero").alias("avg_nonzero"),
        F.col("r_cv").alias("cv"), F.col("r_n_days").alias("n_days"),
        F.col("r_n_order_days").alias("n_order_days")))


def latest_on_hand(spark, sf):
    return round_all(RP.latest_on_hand(D.app_snapshots(spark, sf), D.APP_AS_OF))


LANES_EXAMPLE = ProductConfig(
    lane_overrides={"Item 1": "periodic", "Item 3": "daily", "Item 5": "dormant",
                    "Item 7": "intermittent"},
    periodic=frozenset(f"Item {i}" for i in range(0, 400, 2)))


def recommendation_lanes(spark, sf):
    """Recommendations with periodic items and an override for every lane."""
    t = _app(spark, sf)
    r = RP.build_recommendations(t["usage"], t["orders"], t["snapshots"], t["settings"],
                                 t["items"], D.APP_AS_OF, AppParams(), LANES_EXAMPLE)
    return round_all(r.select(*RP.RECOMMENDATION_COLUMNS,
                              F.concat_ws(",", "warning_flags").alias("warning_flags")))


def _recommendations(spark, sf, params):
    t = _app(spark, sf)
    return RP.build_recommendations(t["usage"], t["orders"], t["snapshots"], t["settings"],
                                    t["items"], D.APP_AS_OF, params)


def _recommendation(params):
    def q(spark, sf):
        r = _recommendations(spark, sf, params)
        return round_all(r.select(*RP.RECOMMENDATION_COLUMNS,
                                  F.concat_ws(",", "warning_flags").alias("warning_flags")))
    return q


def plan_stats(spark, sf):
    return RP.plan_stats(_recommendations(spark, sf, AppParams()))


PLANS_SCHEMA = ("id long, plan_date date, status string, generated_at timestamp_ntz, "
                "generated_by_user_id long")


def plan_generate(spark, sf):
    """J4 over the app tables: the lines of a new plan."""
    t = _app(spark, sf)
    out = PL.generate_plan(
        spark.createDataFrame([], PLANS_SCHEMA),
        spark.createDataFrame([], "id long, plan_id long"), t["usage"], t["orders"],
        t["snapshots"], t["settings"], t["items"], D.APP_AS_OF, plan_id=1)
    return round_all(out["lines"].select(
        F.col("plan_id").cast("int").alias("plan_id"), "store_id", "item_id",
        "recommended_quantity", "status", "confidence_level", "forecast_method",
        "forecast_avg_daily_usage", "forecast_on_hand", "forecast_target",
        F.col("id").isNotNull().alias("has_id"),
        (F.length("explanation_text") > 0).alias("has_text")))


def _line_status(spark, sf):
    lines = D.keyed_plan_lines(spark, sf).withColumn("picker_note", F.lit(None).cast("string"))
    return PL.update_line_status(lines, D.status_events(spark, sf))


def line_status_apply(spark, sf):
    return round_all(_line_status(spark, sf)["lines"].select(
        "id", "plan_id", "status", "actual_quantity", "picker_note"))


def line_status_audit(spark, sf):
    return _line_status(spark, sf)["audit"].select("entity_id", "old_value", "new_value",
                                                   "changed_at", "seq")


def line_status_rejects(spark, sf):
    return _line_status(spark, sf)["rejected"].select("line_id", "seq", "reject_reason")


SPORADIC_EXAMPLE = ProductConfig(sporadic=frozenset({"Brand#3", "Brand#13", "Brand#23"}))


def _packing(spark, sf):
    """Brand lane forecast -> safety stock -> schedule -> whole units."""
    daily = _daily(spark, sf, "brand")
    first, last = DM.date_bounds(daily)
    fc = DW.lane_forecast(daily, SPORADIC_EXAMPLE, first=first, last=last)
    safe = PK.apply_safety_stock(fc, PK.series_stats(daily, first, last), SPORADIC_EXAMPLE)
    lanes = LN.lanes(daily, SPORADIC_EXAMPLE, first, last)
    sched = PK.delivery_schedule(lanes)
    qty = PK.packing_quantities(safe, sched)
    par = D.par_levels_for(daily)
    plist = PK.packing_list(qty, par)
    return dict(safe=safe, sched=sched, qty=qty, plist=plist, par=par)


def safety_stock(spark, sf):
    return round_all(_packing(spark, sf)["safe"])


def delivery_schedule(spark, sf):
    return round_all(_packing(spark, sf)["sched"])


def packing_list(spark, sf):
    return round_all(_packing(spark, sf)["plist"])


def packing_totals(spark, sf):
    return round_all(PK.packing_totals(_packing(spark, sf)["plist"]))


def check_stock(spark, sf):
    p = _packing(spark, sf)
    return PK.check_stock(p["plist"], p["par"])


def _backtest(spark, sf):
    return EV.backtest(_daily(spark, sf, "brand"))


def backtest_lanes(spark, sf):
    return round_all(_backtest(spark, sf))


def accuracy_by_lane(spark, sf):
    return round_all(EV.accuracy_report(EV.fill_ensemble(_backtest(spark, sf))))


def lane_distribution(spark, sf):
    return EV.lane_distribution(_backtest(spark, sf))


def worst_products(spark, sf):
    return round_all(EV.worst_products(EV.fill_ensemble(_backtest(spark, sf))))


def _matched(spark, sf):
    daily = _daily(spark, sf, "type")
    first, last = DM.date_bounds(daily)
    return FB.match_actuals(D.forecast_history_for(daily, last), daily)


def match_actuals(spark, sf):
    return round_all(_matched(spark, sf))


def correction_factors(spark, sf):
    return round_all(FB.correction_factors(_matched(spark, sf)))


def confidence_score(spark, sf):
    return round_all(FB.confidence_scores(_matched(spark, sf)))


def accuracy_summary(spark, sf):
    return round_all(FB.accuracy_summary(_matched(spark, sf)))


def forecast_vs_actual(spark, sf):
    return FB.forecast_vs_actual(_matched(spark, sf))


def feedback_summary(spark, sf):
    return round_all(FB.feedback_summary(_matched(spark, sf)))


def gap_rows(spark, sf):
    daily = _daily(spark, sf, "type")
    first, last = DM.date_bounds(daily)
    hist = D.forecast_history_for(daily, last)
    older = hist.where(F.col("date") <= F.date_sub(last, 10))
    return round_all(FB.gap_rows(older, DM.dense_demand(daily, first, last)))


def history_upsert(spark, sf):
    daily = _daily(spark, sf, "type")
    first, last = DM.date_bounds(daily)
    fc = DW.lane_forecast(daily, first=first, last=last)
    tiers = FT.volume_tiers(DM.dense_demand(daily, first, last))
    model = (F.when(F.col("lane") == "dormant", F.lit("dormant"))
              .when(F.col("lane") == "intermittent", F.lit("intermittent_v1"))
              .when(F.col("lane") == "periodic", F.lit("periodic_v1"))
              .otherwise(F.lit("ensemble_v2")))
    entries = fc.join(tiers, ["store", "product"]).select(
        "store", "product", "date", F.col("pred").alias("predicted"), "volume_tier",
        model.alias("model_version"))
    hist = D.forecast_history_for(daily, last)
    ts = F.date_add(last, 1).cast("timestamp_ntz")
    return round_all(FB.record_forecasts(hist, entries, ts))


def _pick_list(category=None, search=None):
    def q(spark, sf):
        return round_all(RT.pick_list(D.plan_lines(spark, sf), D.plan_items(spark, sf),
                                      category, search))
    return q


def status_pivot(spark, sf):
    return RT.status_pivot(D.plan_lines(spark, sf))


def store_breakdown(spark, sf):
    return RT.store_breakdown(D.plan_lines(spark, sf), D.plan_stores(spark, sf))


def dashboard(spark, sf):
    return round_all(RT.dashboard(D.plan_lines(spark, sf), D.plans(spark, sf)))


def delivery_progress(spark, sf):
    return round_all(RT.delivery_progress(D.plan_lines(spark, sf)))


def exceptions(spark, sf):
    return RT.exceptions(D.plan_lines(spark, sf))


def activity_top(spark, sf):
    return RT.activity_top(D.plan_lines(spark, sf), D.audit_logs(spark, sf))


def _accuracy(spark, sf):
    return RT.prediction_accuracy(D.plan_lines(spark, sf), D.plans(spark, sf),
                                  D.plan_orders(spark, sf))


def prediction_accuracy(spark, sf):
    return round_all(_accuracy(spark, sf))


def prediction_summary(spark, sf):
    return round_all(RT.prediction_summary(_accuracy(spark, sf)))


def plan_categories(spark, sf):
    return RT.plan_categories(D.plan_lines(spark, sf), D.plan_items(spark, sf))


def _checked(spark, sf, row_notice=None):
    return IM.validate(D.raw_import(spark, sf), D.plan_stores(spark, sf), D.plan_items(spark, sf),
                       D.IMPORT_AS_OF, row_notice=row_notice)


def _import_validate(row_notice=None):
    def q(spark, sf):
        return round_all(_checked(spark, sf, row_notice))
    return q


def _order_files(spark, sf):
    return RC.import_records(D.order_file_lines(spark, sf), RC.ORDER_LAYOUTS)


def order_import(spark, sf):
    """Order files of both layouts, three delimiters and quoted line breaks, checked in one pass."""
    rows, _ = _order_files(spark, sf)
    return round_all(IM.validate_records(rows, D.plan_stores(spark, sf), D.plan_items(spark, sf),
                                         D.IMPORT_AS_OF))


def order_file_problems(spark, sf):
    return _order_files(spark, sf)[1]


def import_summary(spark, sf):
    return IM.import_summary(_checked(spark, sf, CSV_ROW_NOTICE))


def import_upsert(spark, sf):
    new = IM.upsert(D.plan_usage(spark, sf), _checked(spark, sf),
                    {"store_id": "store_id", "item_id": "item_id", "usage_date": "date"},
                    {"quantity_used": "quantity", "notes": "notes"})
    return round_all(new.select("store_id", "item_id", "usage_date", "quantity_used", "source",
                                "notes"))


OBSOLETE_EXAMPLE = frozenset({"Brand#25"})
CATEGORY_EXAMPLE = {"Brand#1": "Dairy", "Brand#2": "Coffee", "Brand#3": "Supplies"}


def _names(spark, sf):
    return DI.product_names(D.demand_lines(spark, sf, "brand"), D.par_levels(spark, sf, "brand"),
                            OBSOLETE_EXAMPLE)


def item_dimension(spark, sf):
    return round_all(DI.item_dimension(_names(spark, sf), CATEGORY_EXAMPLE))


def settings_from_facts(spark, sf):
    return DI.settings_from_facts(D.demand_lines(spark, sf, "brand"), D.par_levels(spark, sf, "brand"))


def par_coverage(spark, sf):
    return DI.par_coverage(_names(spark, sf), D.par_levels(spark, sf, "brand"))


def quality_summary(spark, sf):
    chk = DI.quality_checks(D.faulty_settings(spark, sf), D.faulty_items(spark, sf))
    return DI.quality_summary(chk)


# ---- models (no SQL twin: fitted models / numerical optimisation) -------

def holt_winters(spark, sf):
    daily = _daily(spark, sf, "type")
    first, last = DM.date_bounds(daily)
    pairs = LN.lanes(daily, None, first, last).where(F.col("lane") == "daily")
    return round_all(MD.holt_winters(DM.dense_demand(daily, first, last), last, only=pairs))


def _gbt_train(spark, sf, kind="type"):
    """The dense grid, its last day and the daily lane's weighted training rows."""
    daily = _daily(spark, sf, kind)
    first, last = DM.date_bounds(daily)
    dense = materialize(DM.dense_demand(daily, first, last), f"dense-{kind}")
    pairs = LN.lanes(daily, None, first, last).where(F.col("lane") == "daily")
    rows = FT.complete_rows(FT.feature_matrix(dense.join(pairs, ["store", "product"],
                                                         "left_semi")))
    return dense, last, materialize(FT.recency_weights(rows, ["store"]), f"gbt-train-{kind}")


def gbt_forecast(spark, sf):
    dense, _, train = _gbt_train(spark, sf)
    fut = FT.future_features(dense)
    return round_all(MD.predict_gbt(MD.fit_gbt(train), fut).select(
        "store", "product", "day_idx", "date", "pred_gbt"))


def gbt_recursive(spark, sf):
    dense, last, train = _gbt_train(spark, sf)
    return round_all(MD.recursive_gbt(MD.fit_gbt(train), dense, last))


def sporadic_recursive(spark, sf):
    """The two-stage model over the brands' series without high volume."""
    daily = materialize(_daily(spark, sf, "brand"), "daily-brand")
    first, last = DM.date_bounds(daily)
    dense = materialize(DM.dense_demand(daily, first, last), "dense-brand")
    rare = FT.volume_tiers(dense).where(F.col("volume_tier") != "high")
    rows = FT.complete_rows(FT.feature_matrix(dense.join(rare, ["store", "product"],
                                                         "left_semi")))
    models = MD.fit_sporadic(materialize(FT.recency_weights(rows, ["store"]), "sporadic-train"))
    return round_all(MD.recursive_sporadic(models, dense, last, only=rare))


def backfill(spark, sf):
    daily = _daily(spark, sf, "type")
    first, last = DM.date_bounds(daily)
    hist = D.forecast_history_for(daily, last)
    older = hist.where(F.col("date") <= F.date_sub(last, 10))
    return round_all(FR.backfill(older, daily))


def feature_importance(spark, sf):
    rows = MD.feature_importance(MD.fit_gbt(_gbt_train(spark, sf)[2]))
    return round_all(spark.createDataFrame(rows, "store string, feature string, importance double"))


def ensemble_forecast(spark, sf):
    res = FR.run_forecast(D.demand_lines(spark, sf, "type"))
    return round_all(res.predictions)


def ensemble_weights(spark, sf):
    daily = _daily(spark, sf, "type")
    return EV.ensemble_weights(EV.backtest(daily, predictors=FR.predictors()))


def global_weights(spark, sf):
    return EV.ensemble_weights(D.backtest_rows(_daily(spark, sf, "type")))


def product_weights(spark, sf):
    rows = materialize(D.backtest_rows(_daily(spark, sf, "type")), "backtest-rows")
    shared = EV.ensemble_weights(rows).first().asDict()       # three numbers
    return EV.product_weights(rows, shared)


def packing_order(spark, sf):
    """each store's rows with their place in the printed list."""
    listed = packing_list(spark, sf).select("store", "product", "total").distinct()
    place = Window.partitionBy("store").orderBy(F.col("total").desc(), "product")
    return listed.select("*", F.row_number().over(place).cast("long").alias("place"))


def confidence_order(spark, sf):
    scores = FB.confidence_scores(_matched(spark, sf))
    return round_all(FB.confidence_order(scores).select("store", "product", "score", "place"))


def accuracy_order(spark, sf):
    acc = round_all(_accuracy(spark, sf))
    return RT.accuracy_place(acc).select("plan_id", "id", "status", "diff", "place")


def sales_by_date(spark, sf):
    lines = DM.distinct_lines(D.demand_lines(spark, sf, "type")).select(
        "store", "product", F.col("date").cast("date").alias("date"), "qty")
    return round_all(SL.by_date(lines))


def top_corrections(spark, sf):
    return round_all(FB.top_corrections(FB.correction_factors(_matched(spark, sf))))


def plan_stores(spark, sf):
    return RT.plan_stores(D.plan_lines(spark, sf), D.plan_stores(spark, sf))


def packing_v1(spark, sf):
    return round_all(PK.packing_v1(DW.dow_forecast(_daily(spark, sf, "type"), version=1)))


def delivery_sheet(spark, sf):
    return round_all(RT.delivery_sheet(D.plan_lines(spark, sf), D.plan_items(spark, sf)))


def registry() -> dict[str, Query]:
    return {
        "daily_demand_dense": daily_demand_dense,
        "data_profile": data_profile,
        "sales_distinct": sales_distinct,
        "lane_classify": _lane_classify("brand"),
        "lane_classify_events": _lane_classify("events"),
        "alias_closure": alias_closure,
        "normalized_demand": normalized_demand,
        "rules_in_force": rules_in_force,
        "rule_problems": rule_problems,
        "lane_rules": lane_rules,
        "lane_rules_forecast": lane_rules_forecast,
        "lane_forecast": lane_forecast,
        "dow_forecast_v2": _dow_forecast(2, "type"),
        "dow_forecast_v1": _dow_forecast(1, "type"),
        "dow_profile_v2": _dow_profile(2, "brand"),
        "dow_profile_v1": _dow_profile(1, "brand"),
        "feature_calendar": feature_calendar,
        "feature_lags": feature_lags,
        "feature_recency": feature_recency,
        "feature_product": feature_product,
        "future_features": future_features,
        "recency_weights": recency_weights,
        "overlay_demand": overlay_demand,
        "avg_orders": avg_orders,
        "weighted_avg_orders": weighted_avg_orders,
        "demand_stats": demand_stats,
        "latest_on_hand": latest_on_hand,
        "recommendation": _recommendation(AppParams()),
        "recommendation_weighted": _recommendation(
            AppParams(forecast_method="historical_weighted_v1", dow_multiplier=0.5)),
        "recommendation_lanes": recommendation_lanes,
        "plan_stats": plan_stats,
        "safety_stock": safety_stock,
        "delivery_schedule": delivery_schedule,
        "packing_list": packing_list,
        "packing_totals": packing_totals,
        "check_stock": check_stock,
        "backtest_lanes": backtest_lanes,
        "accuracy_by_lane": accuracy_by_lane,
        "lane_distribution": lane_distribution,
        "worst_products": worst_products,
        "match_actuals": match_actuals,
        "correction_factors": correction_factors,
        "confidence_score": confidence_score,
        "accuracy_summary": accuracy_summary,
        "forecast_vs_actual": forecast_vs_actual,
        "feedback_summary": feedback_summary,
        "gap_rows": gap_rows,
        "history_upsert": history_upsert,
        "pick_list": _pick_list(),
        "pick_list_search": _pick_list("STANDARD", "ring"),
        "status_pivot": status_pivot,
        "store_breakdown": store_breakdown,
        "plan_generate": plan_generate,
        "line_status_apply": line_status_apply,
        "line_status_audit": line_status_audit,
        "line_status_rejects": line_status_rejects,
        "dashboard": dashboard,
        "delivery_progress": delivery_progress,
        "exceptions": exceptions,
        "activity_top": activity_top,
        "prediction_accuracy": prediction_accuracy,
        "prediction_summary": prediction_summary,
        "plan_categories": plan_categories,
        "import_validate": _import_validate(),
        "import_validate_capped": _import_validate(5000),
        "order_import": order_import,
        "order_file_problems": order_file_problems,
        "import_summary": import_summary,
        "import_upsert": import_upsert,
        "item_dimension": item_dimension,
        "settings_from_facts": settings_from_facts,
        "par_coverage": par_coverage,
        "quality_summary": quality_summary,
        "top_corrections": top_corrections,
        "plan_stores": plan_stores,
        "packing_v1": packing_v1,
        "delivery_sheet": delivery_sheet,
        "holt_winters": holt_winters,
        "gbt_forecast": gbt_forecast,
        "gbt_recursive": gbt_recursive,
        "sporadic_recursive": sporadic_recursive,
        "feature_importance": feature_importance,
        "backfill": backfill,
        "ensemble_weights": ensemble_weights,
        "global_weights": global_weights,
        "product_weights": product_weights,
        "packing_order": packing_order,
        "confidence_order": confidence_order,
        "accuracy_order": accuracy_order,
        "sales_by_date": sales_by_date,
        "ensemble_forecast": ensemble_forecast,
    }
