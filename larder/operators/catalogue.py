"""Product configuration kept as tables (C15, B3): chains of aliases, and lane rules with dates.

An alias table says ``variant -> target``, and a target may be a variant itself.
``alias_closure`` resolves the chains by pointer jumping: every round joins the open names
to their targets' targets, so a chain of n names takes log2(n) rounds, each a stored table.

A rule table has rows ``product, kind, lane, valid_from, valid_to``: an ``override`` names a
lane, ``periodic``, ``sporadic`` and ``obsolete`` put the product into that set.  Dates are
inclusive, a null date is open.  ``rules_at`` gives one row a product for one day, which
``ProductConfig(rules=...)`` hands to the lane, safety-stock and replenishment rules.

Both results are stored before they are joined, so the planner knows their size: it sends
them to all tasks below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles them beyond.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..plans.dealing import TASK_ROWS, deal, tasks_for
from ..plans.materialize import materialize

RULE_KINDS = ("override", "periodic", "sporadic", "obsolete")


def alias_closure(aliases: DataFrame) -> DataFrame:
    """``variant, canonical``: one row a variant, all steps of its chain taken.

    Names are trimmed.  Of several targets of a variant the least counts; null or empty
    names and aliases to the name itself are ignored.  Names that lead into a circle all
    get the circle's least name.
    """
    name = lambda c: F.nullif(F.trim(c), F.lit(""))                        # noqa: E731
    pairs = (aliases.select(name("variant").alias("variant"), name("target").alias("target"))
             .where("variant IS NOT NULL AND target IS NOT NULL AND variant <> target")
             .groupBy("variant").agg(F.min("target").alias("target")))
    # target: the name `reach` steps on; least: the least name of these steps; ended: the
    # chain stops at the target
    links = materialize(pairs.withColumns({"least": F.col("target"), "ended": F.lit(False)}),
                        "alias-links")
    n, reach = links.count(), 1
    while reach <= n and not links.where("NOT ended").isEmpty():
        ahead = links.select(F.col("variant").alias("target"), F.col("target").alias("_target"),
                             F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        jumped = links.where("NOT ended").join(ahead, "target", "left").select(
            "variant", F.coalesce("_target", "target").alias("target"),
            F.least("least", "_least").alias("least"), F.coalesce("_ended", F.lit(True)).alias("ended"))
        links = materialize(links.where("ended").unionByName(jumped), "alias-links")
        reach *= 2
    # what has not ended after more steps than there are names stands in a circle
    circle = links.select(F.col("variant").alias("target"), F.col("least").alias("canonical"))
    return materialize(
        links.where("ended").select("variant", F.col("target").alias("canonical")).unionByName(
            links.where("NOT ended").join(circle, "target").select("variant", "canonical")),
        "alias-closure")


def normalize_by_table(df: DataFrame, closure: DataFrame, name: str = "product") -> DataFrame:
    """B3 with a table: ``name`` trimmed, then its canonical name where it has one."""
    found = closure.select(F.col("variant").alias("_variant"), F.col("canonical").alias("_canonical"))
    return (df.withColumn(name, F.trim(name)).join(found, F.col(name) == F.col("_variant"), "left")
            .withColumn(name, F.coalesce("_canonical", name)).drop("_variant", "_canonical"))


def normalized_demand(lines: DataFrame, closure: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """D1 by canonical product.  Lines are summed by written name first, so a name that
    holds a third of all lines brings one row a store and day to the join.  Both sums are
    dealt by store, product and day over tasks of about ``task_rows`` lines."""
    key, tasks = ["store", "product", "date"], tasks_for(lines.count(), task_rows)
    daily = deal(lines, tasks, *key).groupBy(*key).agg(F.sum("qty").alias("qty"))
    return (deal(normalize_by_table(daily, closure), tasks, *key).groupBy(*key)
            .agg(F.sum("qty").alias("qty")))


def rule_problems(rules: DataFrame) -> DataFrame:
    """The rule rows that ``rules_at`` ignores, with the reason."""
    reason = (F.when(F.coalesce(F.trim("product"), F.lit("")) == "", F.lit("blank_product"))
               .when(~F.coalesce(F.col("kind").isin(*RULE_KINDS), F.lit(False)), F.lit("unknown_kind"))
               .when((F.col("kind") == "override")
                     & ~F.coalesce(F.col("lane").isin(*C.LANES), F.lit(False)), F.lit("unknown_lane"))
               .when(F.col("valid_from") > F.col("valid_to"), F.lit("ends_before_start")))
    return rules.withColumn("problem", reason).where("problem IS NOT NULL")


def rules_at(rules: DataFrame, day: dt.date | Column, closure: DataFrame | None = None) -> DataFrame:
    """``product, lane_override, periodic, sporadic, obsolete`` on ``day``, one row a product.

    Of several overrides in force the one that began last counts (an open start is the
    earliest; of equal starts the least lane).  Rows of ``rule_problems`` are ignored.
    ``closure``: rules of a variant then hold for its canonical product.
    """
    day = day if isinstance(day, Column) else F.lit(day)
    ok = (F.col("kind").isin(*RULE_KINDS) & (F.trim("product") != "")
          & ((F.col("kind") != "override") | F.col("lane").isin(*C.LANES))
          & (F.col("valid_from").isNull() | (F.col("valid_from") <= day))
          & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    live = rules.where(ok)
    live = (normalize_by_table(live, closure) if closure is not None
            else live.withColumn("product", F.trim("product")))
    start = F.coalesce(F.datediff("valid_from", F.lit("0001-01-01").cast("date")), F.lit(-1))
    place = F.when(F.col("kind") == "override", F.struct((-start).alias("before"), "lane"))
    has = lambda kind: F.bool_or(F.col("kind") == kind).alias(kind)        # noqa: E731
    return materialize(live.groupBy("product").agg(
        F.min(place).alias("_o"), has("periodic"), has("sporadic"), has("obsolete"))
        .select("product", F.col("_o.lane").alias("lane_override"),
                "periodic", "sporadic", "obsolete"), "product-rules")


def without_obsolete(names: DataFrame, rules: DataFrame, name: str = "item_name") -> DataFrame:
    """G4 with a table: the names that no rule in force calls obsolete."""
    gone = rules.where("obsolete").select(F.col("product").alias(name))
    return names.join(gone, name, "left_anti")
