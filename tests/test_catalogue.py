"""Product configuration as tables: alias chains, dated rules, and the rules that use them."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.config import ProductConfig
from larder.operators import catalogue as CT
from larder.operators import lanes as LN

ALIAS = "variant string, target string"
RULE = "product string, kind string, lane string, valid_from date, valid_to date"
DAY = dt.date(2024, 6, 1)


def _closure(spark, pairs):
    rows = CT.alias_closure(spark.createDataFrame(pairs, ALIAS)).collect()
    assert len(rows) == len({r.variant for r in rows})
    return {r.variant: r.canonical for r in rows}


def _walked(pairs):
    """One name after the other."""
    target = {}
    for v, t in pairs:
        v, t = (v or "").strip(), (t or "").strip()
        if v and t and v != t:
            target[v] = min(target.get(v, t), t)
    out = {}
    for name in target:
        seen, at = [], target[name]
        while at in target and at not in seen:
            seen.append(at)
            at = target[at]
        out[name] = at if at not in target else min(seen[seen.index(at):])
    return out


def test_chains_circles_and_odd_rows(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(37)]
    pairs = chain + [("a", "b"), ("b", "c"), ("c", "a"), ("aa", "b"),          # a circle, led into
                     (" Ube ", "Ube Milk"), ("two", "zz"), ("two", "b2"), ("self", "self"),
                     (None, "x"), ("x", None), ("", "y"), ("y", "  "), ("a", "b")]
    got = _closure(spark, pairs)
    assert got == _walked(pairs)
    assert got["n0"] == got["n36"] == "n37" and got["aa"] == got["c"] == "a"
    assert got["two"] == "b2" and "self" not in got and "x" not in got
    assert _closure(spark, []) == {}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefghij")), max_size=12))
def test_closure_equals_walk(spark, pairs):
    assert _closure(spark, pairs) == _walked(pairs)


def test_normalized_demand(spark):
    closure = CT.alias_closure(spark.createDataFrame([("b", "c"), ("a", "b")], ALIAS))
    lines = spark.createDataFrame(
        [("S", n, DAY, q) for n, q in ((" a", 1.0), ("b", 2.0), ("c", 4.0), ("d ", 8.0))]
        + [("S", None, DAY, 16.0)], "store string, product string, date date, qty double")
    got = {r["product"]: r.qty for r in CT.normalized_demand(lines, closure).collect()}
    assert got == {"c": 7.0, "d": 8.0, None: 16.0}


def test_rules_by_date(spark):
    d = lambda n: DAY + dt.timedelta(days=n)                               # noqa: E731
    rules = spark.createDataFrame([
        ("p", "override", "daily", None, None), ("p", "override", "dormant", d(-5), d(0)),
        ("p", "override", "periodic", d(1), None),                        # not yet
        ("q", "override", "periodic", d(-9), d(-1)), ("q", "periodic", None, d(0), None),
        ("r", "override", "weekly", None, None), ("r", "odd", None, None, None),
        ("r", "sporadic", None, d(3), d(2)), (None, "periodic", None, None, None),
        ("tie", "override", "periodic", d(-1), None), ("tie", "override", "daily", d(-1), None),
        (" s ", "obsolete", None, None, d(0)), ("s", "obsolete", None, None, d(0))], RULE)
    got = {r["product"]: (r.lane_override, r.periodic, r.sporadic, r.obsolete)
           for r in CT.rules_at(rules, DAY).collect()}
    assert got == {"p": ("dormant", False, False, False), "q": (None, True, False, False),
                   "tie": ("daily", False, False, False), "s": (None, False, False, True)}
    after = {r["product"]: r.lane_override for r in CT.rules_at(rules, d(1)).collect()}
    assert after["p"] == "periodic" and "s" not in after
    problems = {(r["product"], r.problem) for r in CT.rule_problems(rules).collect()}
    assert problems == {("r", "unknown_lane"), ("r", "unknown_kind"), ("r", "ends_before_start"),
                        (None, "blank_product")}
    closure = CT.alias_closure(spark.createDataFrame([("q", "p")], ALIAS))
    joined = {r["product"]: r for r in CT.rules_at(rules, DAY, closure).collect()}
    assert joined["p"].lane_override == "dormant" and joined["p"].periodic and "q" not in joined
    names = spark.createDataFrame([("p",), ("s",)], "item_name string")
    assert [r[0] for r in CT.without_obsolete(names, CT.rules_at(rules, DAY)).collect()] == ["p"]


def test_table_equals_literals(spark):
    """A rule table gives what the same rules give as literals, columns and rows."""
    rows = [("S", p, DAY - dt.timedelta(days=i), 4.0) for p in ("a", "b", "c", "d") for i in range(0, 40, 1 + (p == "d"))]
    daily = spark.createDataFrame(rows, "store string, product string, date date, qty double")
    literal = ProductConfig(lane_overrides={"a": "dormant"}, periodic=frozenset({"b"}))
    rules = spark.createDataFrame([("a", "override", "dormant", None, None),
                                   ("b", "periodic", None, None, None),
                                   ("unknown", "override", "daily", None, None)], RULE)
    table = ProductConfig(rules=CT.rules_at(rules, DAY))
    one, two = LN.lanes(daily, literal), LN.lanes(daily, table)
    assert one.columns == two.columns
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert {r["product"]: r.lane for r in two.collect()}["b"] == "periodic"
    none = ProductConfig(rules=CT.rules_at(rules.limit(0), DAY))
    assert LN.lanes(daily, none).where(F.col("lane") == "daily").count() == 4
