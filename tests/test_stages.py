"""Restartable runs: stages are taken over, versions follow the input, races and leftovers."""

import datetime as dt
import os

import numpy as np
import pytest

from larder.plans import forecast_run as FR
from larder.plans.stages import Stages, input_version

D0 = dt.date(2026, 1, 1)


def _lines(spark):
    rng = np.random.default_rng(5)
    rows = [(s, p, D0 + dt.timedelta(days=d), float(rng.integers(2, 9)))
            for s in ("A", "B") for p in ("x", "y") for d in range(60)]
    rows += [("A", "inter", D0 + dt.timedelta(days=d), 4.0) for d in range(0, 60, 5)]
    return spark.createDataFrame(rows, "store string, product string, date date, qty double")


def _never(*args, **kwargs):
    raise AssertionError("computed again")


def test_killed_run_goes_on(spark, tmp_path, monkeypatch):
    lines, base = _lines(spark), str(tmp_path / "runs")
    run = lambda stages: FR.run_forecast(lines, days=4, use_gbt=False, stages=stages)

    def killed(*args):
        raise KeyboardInterrupt
    first = Stages(spark, base, "v1")
    with monkeypatch.context() as m:
        m.setattr(FR.FT, "volume_tiers", killed)
        with pytest.raises(KeyboardInterrupt):
            run(first)
    assert first.finished() == ["backtest", "daily", "daily-pairs", "dense"]
    second = Stages(spark, base, "v1")
    with monkeypatch.context() as m:
        m.setattr(FR.EV, "backtest", _never)
        m.setattr(FR.DM, "dense_demand", _never)
        done = run(second)
    assert second.made == ["predictions", "packing"]
    third = Stages(spark, base, "v1")
    with monkeypatch.context() as m:
        m.setattr(FR, "_predictions", _never)
        again = run(third)
    assert third.made == []
    plain = FR.run_forecast(lines, days=4, use_gbt=False)
    assert plain.weights == done.weights == again.weights
    for name in ("predictions", "packing"):
        want = getattr(plain, name)
        for got in (getattr(done, name), getattr(again, name)):
            assert got.columns == want.columns
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_race_and_leftovers(spark, tmp_path):
    base = str(tmp_path / "runs")
    one, two = Stages(spark, base, "v2"), Stages(spark, base, "v2")
    Stages(spark, base, "v1").table("t", lambda: spark.range(1))

    def slower():
        one.table("t", lambda: spark.range(3))          # the other run finishes meanwhile
        return spark.range(5)
    assert two.table("t", slower).count() == 3
    assert one.made == ["t"] and two.made == []
    with pytest.raises(Exception):
        one.table("bad", lambda: spark.range(4).selectExpr("raise_error('lost') AS x"))
    assert one.finished() == ["t"]
    left = [n for n in os.listdir(f"{base}/v2") if n.startswith("_writing-")]
    assert sorted(one.clean()) == sorted(["v1", *left])
    assert os.listdir(base) == ["v2"] and [n for n in os.listdir(f"{base}/v2")] == ["t"]
    assert one.table("t", _never).count() == 3
    with pytest.raises(ValueError):
        Stages(spark, base, "../x")


def test_version_follows_input_and_parameters(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(folder)
    v = input_version(spark, [folder], days=14)
    assert v == input_version(spark, [folder], days=14)
    assert v != input_version(spark, [folder], days=15)
    spark.range(1).write.mode("append").parquet(folder)
    assert v != input_version(spark, [folder], days=14)
