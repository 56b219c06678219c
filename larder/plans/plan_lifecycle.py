"""Replenishment-plan lifecycle as table transformations.

The guards of the reference (plan exists, only drafts are replaced or
deleted, active settings required) are checks on small lookups; the work
itself — recommendations for every active setting, status changes for any
number of lines — is one set-based plan each.  Every function returns new
versions of the tables plus audit rows; callers persist them with
``larder.sources.sinks.write_version`` / ``append_audit``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import AppParams, ProductConfig
from ..operators import replenish as RP
from .materialize import materialize

AUDIT_SCHEMA = ("entity_type string, entity_id long, action string, old_value string, "
                "new_value string, changed_by_user_id long, changed_at timestamp_ntz")


# Phrases of the audit text.
AUDIT_TEXT = {"status": "status: ", "quantity": "actual_qty: ", "note": "note updated",
              "bulk": "status -> "}


class PlanError(ValueError):
    pass


def _audit(df: DataFrame, entity_type: str, id_col, action, old, new, user, now) -> DataFrame:
    return df.select(F.lit(entity_type).alias("entity_type"), F.col(id_col).cast("long").alias("entity_id"),
                     action.alias("action"), old.cast("string").alias("old_value"),
                     new.cast("string").alias("new_value"),
                     F.lit(user).cast("long").alias("changed_by_user_id"),
                     F.lit(now).cast("timestamp_ntz").alias("changed_at"))


def line_id(plan_id: Column, store_id: Column, item_id: Column) -> Column:
    """Id of a plan line: a non-negative 63-bit hash of its key."""
    return F.xxhash64(plan_id.cast("long"), store_id, item_id).bitwiseAND(F.lit((1 << 63) - 1))


def generate_plan(plans: DataFrame, lines: DataFrame, usage: DataFrame, orders: DataFrame,
                  snapshots: DataFrame, settings: DataFrame, items: DataFrame, plan_date: dt.date,
                  plan_id: int, regenerate: bool = False, params: AppParams | None = None,
                  product_config: ProductConfig | None = None, user: int | None = None,
                  now: dt.datetime | None = None) -> dict:
    """Lines for every active setting with a positive recommendation."""
    now = now or dt.datetime(plan_date.year, plan_date.month, plan_date.day)
    old = plans.where(F.col("plan_date") == F.lit(plan_date)).select("id", "status").first()
    if old is not None and not regenerate:
        raise PlanError(f"plan for {plan_date} already exists")
    if old is not None and old["status"] != "draft":
        raise PlanError("only a draft plan can be regenerated")
    if settings.where(F.col("active")).limit(1).count() == 0:
        raise PlanError("no active store item settings")
    recs = RP.build_recommendations(usage, orders, snapshots, settings, items, plan_date,
                                    params, product_config, store=materialize)
    pid = old["id"] if old is not None else plan_id
    # The id is a function of the line's key: the same on every run, and known to later events.
    new_lines = RP.plan_lines_from(recs).select(
        line_id(F.lit(pid), F.col("store_id"), F.col("item_id")).alias("id"),
        F.lit(pid).cast("long").alias("plan_id"), "explanation_text", "store_id", "item_id", "recommended_quantity",
        F.lit(None).cast("double").alias("actual_quantity"), F.lit("pending").alias("status"),
        "confidence_level", "warning_flags", F.lit(None).cast("string").alias("picker_note"),
        F.lit(None).cast("timestamp_ntz").alias("last_status_change_at"), "forecast_method",
        F.col("forecast_avg_daily_usage").alias("forecast_avg_daily_usage"),
        F.col("on_hand").alias("forecast_on_hand"), F.col("forecast_target"),
        F.col("window_days").alias("forecast_window_days"))
    kept_lines = lines.where(F.col("plan_id") != pid)
    header = plans.sparkSession.createDataFrame(
        [(pid, plan_date, "draft", now, user)],
        "id long, plan_date date, status string, generated_at timestamp_ntz, generated_by_user_id long")
    new_plans = plans.where(F.col("id") != pid).unionByName(header, allowMissingColumns=True)
    action = F.lit("regenerated" if old is not None else "generated")
    audit = _audit(header, "plan", "id", action, F.lit(None), F.col("status"), user, now)
    return {"plans": new_plans, "lines": kept_lines.unionByName(new_lines, allowMissingColumns=True),
            "audit": audit, "stats": RP.plan_stats(recs)}


def _reject_reason() -> Column:
    q = F.col("actual_quantity")
    nothing = F.col("status").isNull() & q.isNull() & F.col("picker_note").isNull()
    return (F.when(F.col("old.id").isNull(), F.lit("unknown_line"))
             .when(F.col("status").isNotNull() & ~F.col("status").isin(*C.LINE_STATUSES),
                   F.lit("invalid_status"))
             .when(F.isnan(q) | (F.abs(q) == float("inf")), F.lit("invalid_quantity"))
             .when(q < 0, F.lit("negative_quantity"))
             .when(nothing, F.lit("nothing_to_change")))


def update_line_status(lines: DataFrame, events: DataFrame, user: int | None = None,
                       max_note: int = C.CSV_MAX_NOTE_LENGTH) -> dict:
    """Apply status / actual-quantity / picker-note events to lines.

    ``events``: ``line_id, status, actual_quantity, picker_note, changed_at``
    and optionally ``seq``, the order of events with equal times (any number
    a line).  A null field of an event leaves the line's value alone, so each
    column takes its last non-null valid value.  Unknown lines, unknown
    statuses, NaN, infinite and negative quantities and events without any
    value are rejected.  One audit row per applied event tells the changes
    against the values before it.  Notes are kept whole; ``note_too_long``
    in the audit marks those over ``max_note`` characters.
    """
    if "seq" not in events.columns:
        events = events.withColumn("seq", F.xxhash64("status", "actual_quantity", "picker_note"))
    old = lines.select("id", F.struct("id", "status", "actual_quantity").alias("old"))
    ev = (events.join(old, events["line_id"] == old["id"], "left").drop("id")
          .withColumn("reject_reason", _reject_reason()))
    ok = ev.where(F.col("reject_reason").isNull())
    order = F.struct("changed_at", "seq")

    def last(column: str, value: str) -> Column:
        return F.max_by(F.col(value), F.when(F.col(column).isNotNull(), order)).alias(f"_{value}")

    latest = ok.groupBy("line_id").agg(last("status", "status"),
                                       last("actual_quantity", "actual_quantity"),
                                       last("picker_note", "picker_note"),
                                       F.max(F.when(F.col("status").isNotNull(), F.col("changed_at")))
                                       .alias("_at"))
    changed = {"status": "_status", "actual_quantity": "_actual_quantity",
               "picker_note": "_picker_note", "last_status_change_at": "_at"}
    upd = lines.join(latest, lines["id"] == latest["line_id"], "left")
    new_lines = upd.select(*[
        F.coalesce(F.col(changed[c]), F.col(c)).alias(c) if c in changed else F.col(c)
        for c in lines.columns])
    # The events of one line are few: a line changes hands a handful of times.
    before = Window.partitionBy("line_id").orderBy("changed_at", "seq").rowsBetween(
        Window.unboundedPreceding, -1)
    seen = ok.withColumns({
        "old_status": F.coalesce(F.last("status", ignorenulls=True).over(before),
                                 F.col("old.status")),
        "old_quantity": F.coalesce(F.last("actual_quantity", ignorenulls=True).over(before),
                                   F.col("old.actual_quantity"))})
    text = F.concat_ws("; ", *[
        F.when(F.col("status").isNotNull(), F.concat(
            F.lit(AUDIT_TEXT["status"]), F.col("old_status"), F.lit(" -> "), F.col("status"))),
        F.when(F.col("actual_quantity").isNotNull(), F.concat(
            F.lit(AUDIT_TEXT["quantity"]),
            F.coalesce(F.col("old_quantity").cast("string"), F.lit("None")), F.lit(" -> "),
            F.col("actual_quantity").cast("string"))),
        F.when(F.col("picker_note").isNotNull(), F.lit(AUDIT_TEXT["note"]))])
    audit = seen.select(
        F.lit("plan_line").alias("entity_type"), F.col("line_id").alias("entity_id"),
        F.lit("update").alias("action"), F.col("old_status").alias("old_value"),
        text.alias("new_value"), F.lit(user).cast("long").alias("changed_by_user_id"),
        F.col("changed_at").cast("timestamp_ntz").alias("changed_at"), "seq",
        F.coalesce(F.length("picker_note") > max_note, F.lit(False)).alias("note_too_long"))
    rejected = ev.where(F.col("reject_reason").isNotNull()).select(
        "line_id", "status", "actual_quantity", "changed_at", "seq", "reject_reason")
    return {"lines": new_lines, "audit": audit, "rejected": rejected}


def bulk_update_status(lines: DataFrame, line_ids: DataFrame, status: str, changed_at,
                       user: int | None = None) -> dict:
    """J5 for a table of line ids (column ``line_id``): one status for all of them."""
    if status not in C.LINE_STATUSES:
        raise PlanError(f"invalid status: {status}")
    ids = line_ids.select(F.col("line_id").alias("_id")).distinct()
    at = F.lit(changed_at).cast("timestamp_ntz")
    hit = F.col("_id").isNotNull()
    upd = lines.join(ids, lines["id"] == ids["_id"], "left").select(*[
        F.when(hit, F.lit(status)).otherwise(F.col(c)).alias(c) if c == "status" else
        F.when(hit, at).otherwise(F.col(c)).alias(c) if c == "last_status_change_at" else F.col(c)
        for c in lines.columns])
    audit = _audit(ids.withColumn("_new", F.lit(AUDIT_TEXT["bulk"] + status)), "plan_line", "_id",
                   F.lit("bulk_update"), F.lit(None), F.col("_new"), user, changed_at)
    return {"lines": upd, "audit": audit}


def delete_draft_plan(plans: DataFrame, lines: DataFrame, plan_id: int, user: int | None = None,
                      now: dt.datetime | None = None) -> dict:
    """Remove a draft plan and its lines (cascade)."""
    row = plans.where(F.col("id") == plan_id).select("status").first()
    if row is None:
        raise PlanError(f"plan {plan_id} does not exist")
    if row["status"] != "draft":
        raise PlanError("only draft plans can be deleted")
    now = now or dt.datetime(1970, 1, 1)
    gone = plans.where(F.col("id") == plan_id)
    return {"plans": plans.where(F.col("id") != plan_id),
            "lines": lines.where(F.col("plan_id") != plan_id),
            "audit": _audit(gone, "plan", "id", F.lit("deleted"), F.col("status"), F.lit(None), user, now)}
