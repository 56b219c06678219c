"""Rules-based demand forecast and replenishment recommendation
(C2, C3, C9, D2, D3, D4, H5, H6, H7, H12, I2, I6-I13, B17, D24).

The reference evaluates these rules one (store, item) pair at a time with
several database round trips per pair.  Here the whole settings table goes
through one plan:

1. the order-over-usage overlay (full outer join on the key) restricted to
   the largest look-back window any setting needs;
2. ONE hash aggregate per setting computing every windowed statistic
   (simple and weighted averages for the short and long window, the
   routing-window demand statistics, source flags);
3. the latest snapshot on or before the plan date (``max_by`` aggregate);
4. pure column expressions for lane routing, the lane builders, on-hand
   projection, par / safety / min-send / rounding and warning flags.

Quantities are doubles; every ``ceil`` is taken after a 6-place half-even
rounding so floating noise cannot push an exact whole number up a unit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AppParams, ProductConfig
from ..functions.numeric import count_if, half_even
from .demand import overlay_demand
from .lanes import _lookup, with_rules

ID = ["store_id", "item_id"]


def _lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def ceil6(x: Column) -> Column:
    """Ceiling after removing floating noise below 1e-6."""
    return F.ceil(half_even(x, 6)).cast("double")


def apply_rounding(qty: Column, rule: Column, case_pack: Column) -> Column:
    """H5: <= 0 -> 0; integer ceil; ceil to case pack (pack <= 0 -> 1); none."""
    cp = F.when(case_pack.isNull() | (case_pack <= 0), F.lit(1.0)).otherwise(case_pack.cast("double"))
    return (F.when(qty <= 0, F.lit(0.0))
             .when(rule == "round_up_integer", ceil6(qty))
             .when(rule == "round_up_case_pack", ceil6(qty / cp) * cp)
             .otherwise(qty))


def coverage(points: Column, window: Column) -> Column:
    """H7: min(points / window, 1); window <= 0 -> 0."""
    return F.when(window <= 0, F.lit(0.0)).otherwise(F.least(points / window, F.lit(1.0)))


def setting_windows(settings: DataFrame, params: AppParams) -> DataFrame:
    """Active settings with their short/long windows (per-pair override)."""
    uw = F.col("usage_window_days")
    has = uw.isNotNull() & (uw > 0)
    return (settings.where(F.col("active"))
                    .withColumn("ws", F.when(has, uw).otherwise(F.lit(params.window_short)))
                    .withColumn("wl", F.when(has, F.greatest(uw * 2, F.lit(params.window_long)))
                                .otherwise(F.lit(params.window_long))))


def latest_on_hand(snapshots: DataFrame, plan_date) -> DataFrame:
    """Newest snapshot with ``snapshot_date <= plan_date`` per pair."""
    p = _lit_date(plan_date)
    s = snapshots.where(F.col("snapshot_date") <= p)
    return s.groupBy(*ID).agg(
        F.max_by("quantity_on_hand", "snapshot_date").alias("on_hand"),
        F.max("snapshot_date").alias("on_hand_date"))


def _source(any_order: Column, any_usage: Column, n: Column) -> Column:
    return (F.when(n == 0, F.lit("none"))
             .when(any_order & any_usage, F.lit("blended"))
             .when(any_order, F.lit("actual_orders"))
             .otherwise(F.lit("daily_usage")))


def pair_statistics(settings_w: DataFrame, overlay: DataFrame, plan_date,
                    params: AppParams, decay: float | None = None,
                    dow_multiplier: float | None = None) -> DataFrame:
    """D2 + D3 + D4 for every active setting in one aggregate.

    Columns per window ``s`` (short) and ``l`` (long): ``n_s`` records,
    ``avg_s`` simple average, ``wavg_s`` weighted average, ``dowm_s`` weekday
    matches, ``src_s`` source label; routing window: ``r_*`` statistics.
    """
    p = _lit_date(plan_date)
    decay = params.decay if decay is None else decay
    m = params.dow_multiplier if dow_multiplier is None else dow_multiplier
    ago = F.datediff(p, F.col("date"))
    q = F.col("qty")
    same_dow = F.weekday("date") == F.weekday(p)
    dw = F.when(same_dow, F.lit(1.0 + m)).otherwise(F.lit(1.0)) if m > 0 else F.lit(1.0)
    w = F.pow(F.lit(float(decay)), ago - 1) * dw

    j = settings_w.join(overlay, ID, "left")
    aggs = []
    for tag, win in (("s", F.col("ws")), ("l", F.col("wl"))):
        inside = F.col("date").isNotNull() & (ago <= win)
        aggs += [
            count_if(inside).alias(f"n_{tag}"),
            F.sum(F.when(inside, q)).alias(f"sum_{tag}"),
            F.sum(F.when(inside, q * w)).alias(f"wq_{tag}"),
            F.sum(F.when(inside, w)).alias(f"w_{tag}"),
            (count_if(inside & same_dow) if m > 0 else F.lit(0).cast("long")).alias(f"dowm_{tag}"),
            F.coalesce(F.bool_or(inside & F.col("has_order")), F.lit(False)).alias(f"ord_{tag}"),
            F.coalesce(F.bool_or(inside & F.col("has_usage")), F.lit(False)).alias(f"use_{tag}"),
        ]
    inside = F.col("date").isNotNull() & (ago <= params.routing_window)
    pos = inside & (q > 0)
    aggs += [
        count_if(inside).alias("r_n_days"),
        count_if(pos).alias("r_n_order_days"),
        F.sum(F.when(inside, q)).alias("r_sum"),
        F.sum(F.when(pos, q)).alias("r_sum_nz"),
        F.stddev_samp(F.when(pos, q)).alias("r_sd_nz"),
    ]
    keep = [c for c in settings_w.columns if c not in ID]
    g = j.groupBy(*ID, *keep).agg(*aggs)
    out = {}
    for tag in ("s", "l"):
        n = F.col(f"n_{tag}")
        out[f"avg_{tag}"] = F.when(n > 0, F.col(f"sum_{tag}") / n).otherwise(F.lit(0.0))
        out[f"wavg_{tag}"] = F.when((n > 0) & (F.col(f"w_{tag}") != 0),
                                    F.col(f"wq_{tag}") / F.col(f"w_{tag}")).otherwise(F.lit(0.0))
        out[f"src_{tag}"] = _source(F.col(f"ord_{tag}"), F.col(f"use_{tag}"), n)
    nd, no = F.col("r_n_days"), F.col("r_n_order_days")
    avg_nz = F.when(no > 0, F.col("r_sum_nz") / no).otherwise(F.lit(0.0))
    out["r_zero_rate"] = F.when(nd > 0, F.lit(1.0) - no / nd).otherwise(F.lit(1.0))
    out["r_avg_demand"] = F.when(nd > 0, F.col("r_sum") / nd).otherwise(F.lit(0.0))
    out["r_avg_nonzero"] = avg_nz
    out["r_cv"] = F.when((no > 1) & (avg_nz > 0), F.col("r_sd_nz") / avg_nz).otherwise(F.lit(0.0))
    return g.withColumns(out)


def route(params: AppParams, rule: dict[str, Column]) -> Column:
    """I2 over the routing-window statistics (item name drives overrides)."""
    override = rule["override"]
    zr = F.col("r_zero_rate")
    return (F.when(override.isNotNull(), override)
             .when(F.col("r_n_days") == 0, F.lit("dormant"))
             .when(zr >= params.dormant_zero_rate, F.lit("dormant"))
             .when(zr >= params.intermittent_zero_rate, F.lit("intermittent"))
             .when(rule["periodic"], F.lit("periodic"))
             .otherwise(F.lit("daily")))


def _ladder(params: AppParams, weighted: bool) -> dict[str, Column]:
    """I6 / I7 window ladder for the daily lane."""
    ns, nl = F.col("n_s"), F.col("n_l")
    a_s, a_l = (F.col("wavg_s"), F.col("wavg_l")) if weighted else (F.col("avg_s"), F.col("avg_l"))
    k = params.min_data_points
    use_short = ns >= k
    use_long = ~use_short & (nl >= k)
    some = ~use_short & ~use_long & ((ns > 0) | (nl > 0))
    some_long = some & (nl > ns)
    pick_long = use_long | some_long
    none_ = ~use_short & ~use_long & ~some
    conf = (F.when(use_short, F.lit("high")).when(use_long, F.lit("medium")).otherwise(F.lit("low")))
    avg = F.when(none_, F.lit(0.0)).when(pick_long, a_l).otherwise(a_s)
    window = F.when(none_, F.lit(0)).when(pick_long, F.col("wl")).otherwise(F.col("ws"))
    points = F.when(none_, F.lit(0)).when(pick_long, nl).otherwise(ns)
    source = F.when(none_, F.lit("none")).when(pick_long, F.col("src_l")).otherwise(F.col("src_s"))
    dowm = F.when(none_, F.lit(0)).when(pick_long, F.col("dowm_l")).otherwise(F.col("dowm_s"))
    return {"d_avg": avg, "d_conf": conf, "d_conf0": conf, "d_window": window.cast("long"),
            "d_points": points.cast("long"), "d_source": source, "d_dowm": dowm.cast("long"),
            "d_sparse": ~use_short & ~use_long}


def forecast(stats: DataFrame, on_hand: DataFrame, params: AppParams,
             product_config: ProductConfig | None = None) -> DataFrame:
    """Lane, expected daily demand, confidence, flags, on-hand."""
    weighted = params.forecast_method == "historical_weighted_v1"
    stats, rule, extra = with_rules(stats, product_config, "item_name")
    df = (stats.withColumn("lane", route(params, rule)).drop(*extra)
          .withColumns(_ladder(params, weighted)))
    lane = F.col("lane")
    rw = params.routing_window
    nd, no = F.col("r_n_days"), F.col("r_n_order_days")
    freq = F.when(nd > 0, no / nd)
    inter = F.when(no == 0, F.lit(0.0)).otherwise(half_even(freq * F.col("r_avg_nonzero"), 4))
    peri = F.when(no == 0, F.lit(0.0)).otherwise(half_even(
        F.col("r_avg_nonzero") / F.greatest(nd / F.when(no > 0, no), F.lit(float(params.delivery_window))), 4))
    lane_conf_low = ((lane == "intermittent") & (no < 3)) | ((lane == "periodic") & (no < 4))

    avg = (F.when(lane == "dormant", F.lit(0.0)).when(lane == "intermittent", inter)
            .when(lane == "periodic", peri).otherwise(F.col("d_avg")))
    window = F.when(lane == "daily", F.col("d_window")).otherwise(F.lit(rw)).cast("long")
    points = (F.when(lane == "daily", F.col("d_points"))
               .when(lane == "dormant", nd).otherwise(no)).cast("long")
    cov = F.when(lane == "daily", coverage(F.col("d_points"), F.col("d_window"))) \
           .otherwise(coverage(nd, F.lit(rw)))
    source = (F.when(lane == "daily", F.col("d_source"))
               .when(no > 0, F.lit("actual_orders")).otherwise(F.lit("none")))
    method = (F.when(lane == "dormant", F.lit("dormant_v1"))
               .when(lane == "intermittent", F.lit("intermittent_v1"))
               .when(lane == "periodic", F.lit("periodic_v1"))
               .otherwise(F.lit(params.forecast_method)))

    # confidence before the on-hand assessment
    d_conf = F.col("d_conf")
    low_cov = F.lit(False)
    sparse_dow = F.lit(False)
    if weighted:
        low_cov = (F.col("d_cov") > 0) & (F.col("d_cov") < 0.5) & (d_conf == "high")
        d_conf = F.when(low_cov, F.lit("medium")).otherwise(d_conf)
        if params.dow_multiplier > 0:
            expected = F.greatest(F.lit(1), F.floor(F.col("d_window") / 7))
            sparse_dow = (F.col("d_window") > 0) & (F.col("d_dowm") < expected) & (d_conf == "high")
            d_conf = F.when(sparse_dow, F.lit("medium")).otherwise(d_conf)
    conf0 = (F.when(lane == "daily", d_conf)
              .when(lane == "dormant", F.lit("low"))
              .when(lane_conf_low, F.lit("low")).otherwise(F.lit("medium")))
    df = df.withColumn("d_cov", coverage(F.col("d_points"), F.col("d_window")))
    df = df.withColumns({"low_cov": low_cov, "sparse_dow": sparse_dow}).withColumn("conf0", conf0)

    df = df.join(on_hand, ID, "left")
    missing = F.col("on_hand_date").isNull()
    days_since = F.datediff(F.col("plan_date"), F.col("on_hand_date"))
    projected = F.when((days_since > 0) & (F.col("avg_daily_usage") > 0),
                       F.greatest(F.lit(0.0), F.col("on_hand") - F.col("avg_daily_usage") * days_since)) \
                 .otherwise(F.col("on_hand"))
    conf = F.when(missing & (F.col("conf0") == "high"), F.lit("medium")).otherwise(F.col("conf0"))

    low = F.col("conf0") == "low"
    is_daily = lane == "daily"
    flags = F.array_compact(F.array(
        F.when(lane == "dormant", F.lit("dormant_product")),
        F.when(lane == "intermittent", F.lit("intermittent_demand")),
        F.when(lane == "periodic", F.lit("periodic_demand")),
        F.when((lane == "dormant") | (is_daily & F.col("d_sparse")) | (~is_daily & lane_conf_low),
               F.lit("sparse_usage_history")),
        F.when(is_daily & F.col("low_cov"), F.lit("low_data_coverage")),
        F.when(is_daily & F.col("sparse_dow"), F.lit("sparse_dow_history")),
        F.when(low, F.lit("low_confidence")),
        F.when(missing, F.lit("missing_snapshot"))))
    return (df.withColumns({"avg_daily_usage": avg, "window_days": window,
                            "data_points": points, "data_coverage": cov,
                            "data_source": source, "forecast_method": method,
                            "snapshot_qty": F.col("on_hand"), "snapshot_age": days_since})
              .withColumns({"on_hand": projected, "confidence_level": conf,
                            "warnings": flags}))


# Phrases of the explanation text and the source labels.
SIMPLE_LABELS = {"actual_orders": "actual orders", "blended": "orders + usage",
                 "daily_usage": "usage history"}
WEIGHTED_LABELS = {"actual_orders": "orders", "blended": "orders+usage", "daily_usage": "usage"}


def _label(src: Column, labels: dict, default: str) -> Column:
    return F.coalesce(_lookup(labels, src), F.lit(default))


def _num(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def explanation_steps(params: AppParams) -> Column:
    """The forecast part of the explanation, as an array of phrases."""
    lane = F.col("lane")
    ws, wl = F.col("ws").cast("string"), F.col("wl").cast("string")
    nd, no = F.col("r_n_days"), F.col("r_n_order_days")
    rw = str(params.routing_window)
    pick_long = F.col("d_window") == F.col("wl")
    use_short = F.col("d_conf0") == "high"
    weighted = params.forecast_method == "historical_weighted_v1"
    if weighted:
        lab = _label(F.when(pick_long, F.col("src_l")).otherwise(F.col("src_s")), WEIGHTED_LABELS, "usage")
        dec = str(params.decay)
        first = (F.when(use_short, F.concat(F.lit("Weighted "), ws, F.lit("-day avg "), lab,
                                            F.lit(f" (decay={dec})")))
                  .when(F.col("d_conf0") == "medium",
                        F.concat(F.lit("Weighted "), wl, F.lit("-day avg "), lab,
                                 F.lit(f" (decay={dec}, insufficient "), ws, F.lit("-day data)")))
                  .when(F.col("d_points") > 0, F.lit("Limited order history available (weighted)"))
                  .otherwise(F.lit("No order history available")))
    else:
        lab = _label(F.when(pick_long, F.col("src_l")).otherwise(F.col("src_s")), SIMPLE_LABELS,
                     "usage history")
        first = (F.when(use_short, F.concat(F.lit("Based on "), ws, F.lit("-day average "), lab))
                  .when(F.col("d_conf0") == "medium",
                        F.concat(F.lit("Based on "), wl, F.lit("-day average "), lab,
                                 F.lit(" (insufficient "), ws, F.lit("-day data)")))
                  .when(F.col("d_points") > 0, F.lit("Limited order history available"))
                  .otherwise(F.lit("No order history available")))
    extra = [F.when(F.col("low_cov"), F.concat(F.lit("Data coverage "),
                                                _num(F.col("d_cov") * 100, 0), F.lit("% of "),
                                                F.col("d_window").cast("string"), F.lit("-day window")))]
    if weighted and params.dow_multiplier > 0:
        extra += [F.lit(f"DOW weighting x{1 + params.dow_multiplier:.1f} applied"),
                  F.when(F.col("sparse_dow"), F.concat(
                      F.lit("Only "), F.col("d_dowm").cast("string"),
                      F.lit(" same-weekday data point(s) in "), F.col("d_window").cast("string"),
                      F.lit("-day window")))]
    freq = no / F.when(nd > 0, nd)
    lane_text = (
        F.when(lane == "dormant", F.when(nd > 0, F.concat(
            F.lit("Dormant: "), no.cast("string"), F.lit("/"), nd.cast("string"),
            F.lit(f" order-days in {rw}-day window (zero rate "),
            _num(F.col("r_zero_rate") * 100, 0), F.lit("%)")))
            .otherwise(F.lit("Dormant: no demand history in lookback window")))
        .when((lane == "intermittent") & (no == 0), F.lit("Intermittent: no orders in lookback window"))
        .when(lane == "intermittent", F.concat(
            F.lit("Intermittent: "), no.cast("string"), F.lit(" orders in "), nd.cast("string"),
            F.lit(" days (freq "), _num(freq * 100, 0), F.lit("%, avg "),
            _num(F.col("r_avg_nonzero"), 1), F.lit(" when ordered → "),
            _num(F.col("avg_daily_usage"), 2), F.lit("/day expected)")))
        .when((lane == "periodic") & (no == 0), F.lit("Periodic: no orders in lookback window"))
        .when(lane == "periodic", F.concat(
            F.lit("Periodic: "), no.cast("string"), F.lit(" orders in "), nd.cast("string"),
            F.lit(" days (avg interval "), _num(nd / F.when(no > 0, no), 1), F.lit("d, avg size "),
            _num(F.col("r_avg_nonzero"), 1), F.lit(" → "), _num(F.col("avg_daily_usage"), 2),
            F.lit("/day over "), _num(F.greatest(nd / F.when(no > 0, no), F.lit(
                float(params.delivery_window))), 1), F.lit("d window)"))))
    on_hand = (F.when(F.col("on_hand_date").isNull(),
                      F.lit("No inventory snapshot found — assuming 0 on hand"))
                .when((F.col("snapshot_age") > 0) & (F.col("avg_daily_usage") > 0), F.concat(
                    F.lit("On-hand: "), _num(F.col("snapshot_qty"), 2), F.lit(" (as of "),
                    F.col("on_hand_date").cast("string"), F.lit("), projected to "),
                    _num(F.col("on_hand"), 2), F.lit(" by "), F.col("plan_date").cast("string"),
                    F.lit(" ("), F.col("snapshot_age").cast("string"), F.lit("d × "),
                    _num(F.col("avg_daily_usage"), 4), F.lit("/d)")))
                .otherwise(F.concat(F.lit("On-hand: "), _num(F.col("snapshot_qty"), 2),
                                    F.lit(" (as of "), F.col("on_hand_date").cast("string"), F.lit(")"))))
    daily_steps = F.array(first, *extra)
    return F.array_compact(F.concat(
        F.when(lane == "daily", daily_steps).otherwise(F.array(lane_text)), F.array(on_hand)))


def recommend(fc: DataFrame) -> DataFrame:
    """Par fallback, target, need, min-send, rounding, whole units, flag."""
    par = F.coalesce(F.col("par_level"), F.lit(0.0))
    safety = F.coalesce(F.col("safety_stock"), F.lit(0.0))
    min_send = F.coalesce(F.col("min_send_quantity"), F.lit(0.0))
    rule = F.coalesce(F.col("rounding_rule"), F.lit("none"))
    cp = F.coalesce(F.col("case_pack_quantity"), F.lit(1))
    avg = F.when((F.col("avg_daily_usage") == 0) & (F.col("data_points") == 0), par) \
           .otherwise(F.col("avg_daily_usage"))
    on_hand = F.coalesce(F.col("on_hand"), F.lit(0.0))
    target = F.greatest(par, avg + safety)
    need = F.greatest(F.lit(0.0), target - on_hand)
    need = F.when((need > 0) & (need < min_send), min_send).otherwise(need)
    need = apply_rounding(need, rule, cp)
    need = F.when(need > 0, ceil6(need)).otherwise(need)
    df = fc.withColumns({"forecast_avg_daily_usage": avg, "forecast_target": target})
    df = df.withColumn("recommended_quantity", need)
    if "explain" in df.columns:
        pre = F.greatest(F.lit(0.0), target - on_hand)
        pre = F.when((pre > 0) & (pre < min_send), min_send).otherwise(pre)
        rounded = apply_rounding(pre, rule, cp)
        steps = F.array_compact(F.array(
            F.when((F.col("avg_daily_usage") == 0) & (F.col("data_points") == 0),
                   F.lit("Using par level as fallback demand estimate")),
            F.when((F.greatest(F.lit(0.0), target - on_hand) > 0)
                   & (F.greatest(F.lit(0.0), target - on_hand) < min_send),
                   F.concat(F.lit("Raised to minimum send quantity ("), _num(min_send, 2), F.lit(")"))),
            F.when((rounded != pre) & (rounded > 0) & (rule == "round_up_case_pack"),
                   F.concat(F.lit("Rounded up to case pack of "), cp.cast("string"))),
            F.when((rounded != pre) & (rounded > 0) & (rule == "round_up_integer"),
                   F.lit("Rounded up to whole unit")),
            F.when((ceil6(rounded) != rounded) & (rounded > 0), F.lit("Rounded up to whole unit"))))
        df = df.withColumn("explanation_text", F.concat(
            F.concat_ws(". ", F.concat(F.col("explain"), steps)), F.lit(".")))
    unusual = (F.col("recommended_quantity") > par * 2) & (par > 0)
    return df.withColumn("warning_flags", F.when(
        unusual, F.concat(F.col("warnings"), F.array(F.lit("unusual_recommendation"))))
        .otherwise(F.col("warnings")))


def build_recommendations(usage: DataFrame, orders: DataFrame, snapshots: DataFrame,
                          settings: DataFrame, items: DataFrame, plan_date,
                          params: AppParams | None = None,
                          product_config: ProductConfig | None = None,
                          store=None) -> DataFrame:
    """Recommendation for every active (store, item) setting (J4 body).

    ``store`` (e.g. ``plans.materialize``) may write the forecast, one row a
    setting, between the lane rules and the text: with the text in use both
    in one generated method grow beyond the compiler's limit.
    """
    params = params or AppParams()
    p = _lit_date(plan_date)
    sw = setting_windows(settings, params)
    sw = sw.join(items.select(F.col("id").alias("item_id"), "item_name", "case_pack_quantity"),
                 "item_id", "left").withColumn("plan_date", p)
    span = int(sw.agg(F.max(F.greatest("wl", "ws", F.lit(params.routing_window)))).first()[0]
               or params.routing_window)
    ov = overlay_demand(usage, orders, p, span)
    st = pair_statistics(sw, ov, p, params)
    oh = latest_on_hand(snapshots, p)
    fc = forecast(st, oh, params, product_config)
    if store is not None:
        fc = store(fc, "plan-forecast")
    return recommend(fc.withColumn("explain", explanation_steps(params)))


RECOMMENDATION_COLUMNS = [
    "store_id", "item_id", "lane", "recommended_quantity", "confidence_level",
    "forecast_method", "forecast_avg_daily_usage", "on_hand", "forecast_target",
    "window_days", "data_points", "data_source"]


def plan_lines_from(recs: DataFrame) -> DataFrame:
    """Only positive recommendations become plan lines."""
    return recs.where(F.col("recommended_quantity") > 0)


def plan_stats(recs: DataFrame) -> DataFrame:
    """D24 over the unfiltered recommendations."""
    pos = F.col("recommended_quantity") > 0
    return recs.agg(
        count_if(pos).alias("lines"),
        F.countDistinct(F.when(pos, F.col("store_id"))).alias("stores"),
        count_if(pos & (F.col("confidence_level") == "low")).alias("low_confidence"),
        count_if(pos & (F.size("warning_flags") > 0)).alias("with_warnings"),
        count_if(~pos).alias("zero_skipped"))
