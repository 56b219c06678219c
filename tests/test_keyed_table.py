"""Partial upserts, concurrent writers, versions and retention."""

import datetime as dt
import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from larder.sources import keyed_table as KT
from larder.sources import sinks
from larder.streaming.imports import start_usage_import

SCHEMA = "store_id long, item_id long, usage_date date, quantity_used double"
KEY = ["store_id", "item_id", "usage_date"]
D0 = dt.date(2026, 1, 1)


def _dir():
    return tempfile.mkdtemp(prefix="larder-test-", dir="/tmp")


def _rows(spark, rows):
    return spark.createDataFrame([(s, i, D0 + dt.timedelta(days=d), float(q)) for s, i, d, q in rows],
                                 SCHEMA)


def _put(df, base):
    return KT.upsert(df, base, KEY, KT.day_segments("usage_date"), SCHEMA)


def _content(spark, base, **how):
    return {(r.store_id, r.item_id, (r.usage_date - D0).days): r.quantity_used
            for r in KT.read(spark, base, SCHEMA, **how).collect()}


def _files(base):
    return {os.path.join(p, f) for p, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_upsert_writes_only_touched_segments(spark):
    base = _dir() + "/usage"
    assert _content(spark, base) == {}
    want = {(s, i, d): float(d) for s in (1, 2) for i in range(3) for d in range(100)}
    assert _put(_rows(spark, [(*k, q) for k, q in want.items()]), base) == 1
    assert _content(spark, base) == want
    before = _files(base)
    change = {(1, 0, 7): 70.0, (9, 9, 7): 1.0}                      # one day of a hundred
    assert _put(_rows(spark, [(*k, q) for k, q in change.items()]), base) == 2
    want |= change
    assert _content(spark, base) == want
    new = _files(base) - before
    assert before <= _files(base) and all("seg=20260108_0" in f for f in new)
    written = sum(map(os.path.getsize, new)) / sum(map(os.path.getsize, before))
    assert written < 0.05
    assert len(_content(spark, base, segments=["20260108_0"])) == 7  # pruned read
    assert _content(spark, base, version=1)[1, 0, 7] == 7.0          # the version before
    _put(_rows(spark, [(*k, q) for k, q in change.items()]), base)   # a replayed batch
    assert _content(spark, base) == want
    assert _put(_rows(spark, []), base) == 3
    gone = KT.vacuum(spark, base, keep=1)
    assert gone and _content(spark, base) == want and KT.versions(spark, base) == [3]
    assert not any("seg=20260108_0" in f for f in _files(base) & before)


def test_buckets_and_odd_segments(spark):
    base = _dir() + "/usage"
    segment = KT.day_segments("usage_date", "store_id", "item_id", buckets=8)
    rows = _rows(spark, [(s, i, 0, 1) for s in range(10) for i in range(10)])
    KT.upsert(rows, base, KEY, segment, SCHEMA)
    assert len(KT.manifest(spark, base)[1]) == 8
    one = _rows(spark, [(3, 3, 0, 5)])
    KT.upsert(one, base, KEY, segment, SCHEMA)
    assert len(set(KT.manifest(spark, base)[1].values())) == 2       # one of eight parts rewritten
    assert _content(spark, base)[3, 3, 0] == 5 and len(_content(spark, base)) == 100
    with pytest.raises(ValueError):
        KT.upsert(one, base, KEY, F.lit("a/b"), SCHEMA)


def test_concurrent_writers_lose_nothing(spark):
    base = _dir() + "/usage"
    _put(_rows(spark, [(0, 0, d, 0) for d in range(6)]), base)

    def write(n):
        # every writer touches its own day and one that all share
        return _put(_rows(spark, [(n, n, n, n), (n, n, 0, n)]), base)
    with ThreadPoolExecutor(max_workers=4) as pool:
        got = sorted(pool.map(write, range(1, 5)))
    assert got == [2, 3, 4, 5]
    content = _content(spark, base)
    assert all(content[n, n, n] == n and content[n, n, 0] == n for n in range(1, 5))
    assert len(content) == 6 + 8


def test_versions_are_claimed_once(spark):
    base = _dir() + "/history"
    with ThreadPoolExecutor(max_workers=4) as pool:
        paths = list(pool.map(lambda n: sinks.write_version(_rows(spark, [(n, n, 0, n)]), base), range(4)))
    assert sorted(p.rsplit("=", 1)[1] for p in paths) == ["1", "2", "3", "4"]
    held = {spark.read.parquet(p).first().store_id for p in paths}
    assert held == {0, 1, 2, 3}
    sinks.write_version(_rows(spark, [(7, 7, 0, 7)]), base, keep=2)
    assert sinks._versions(spark, base) == [4, 5] and sinks.read_latest(spark, base).first().store_id == 7


def test_streaming_batches_rewrite_their_days_and_tell_bad_files(spark):
    d, table, ck = _dir(), _dir() + "/usage", _dir() + "/ck"
    stores = spark.createDataFrame([(1, "Gardena", "GARDENA")], "id long, name string, code string")
    items = spark.createDataFrame([(1, "Milk", "MILK-WHL")], "id long, item_name string, sku string")
    schema = "store_id long, item_id long, usage_date date, quantity_used double, source string, notes string"

    def run():
        start_usage_import(spark, d, stores, items, dt.date(2026, 3, 14), table, ck,
                           available_now=True).awaitTermination(300)
        return {(r.usage_date.isoformat(), r.quantity_used, r.notes)
                for r in KT.read(spark, table, schema).collect()}
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("store_code,sku,usage_date,quantity_used,notes\nGARDENA,MILK-WHL,2026-03-01,5,\n"
                'GARDENA,MILK-WHL,2026-03-02,6,"two\nlines"\n')
    with open(os.path.join(d, "bad.csv"), "w") as f:
        f.write("store_code,sku\nGARDENA,MILK-WHL\n")
    assert run() == {("2026-03-01", 5.0, None), ("2026-03-02", 6.0, "two\nlines")}
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("store_code,sku,usage_date,quantity_used\nGARDENA,MILK-WHL,2026-03-02,9\nX,Y,2026-03-02,1\n")
    assert run() == {("2026-03-01", 5.0, None), ("2026-03-02", 9.0, None)}
    segments = KT.manifest(spark, table)[1]
    assert segments["20260301_0"] != segments["20260302_0"]
    told = {(os.path.basename(r.file), r.line_no, r.reason)
            for r in spark.read.parquet(table + "-rejects").collect()}
    assert told == {("bad.csv", 1, "missing columns: usage_date, quantity_used"),
                    ("b.csv", 3, "unknown_store")}
