import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.session import get_session  # noqa: E402

AS_OF = dt.date(2026, 3, 14)


@pytest.fixture(scope="session")
def spark():
    return get_session(4, shuffle_partitions=4, app_name="larder-tests")


@pytest.fixture()
def app(spark):
    """2 stores x 4 items, 7 days of 5.0 usage, snapshot 3.0 yesterday,
    par 10 / safety 2 / min-send 2 / case-pack rounding."""
    stores = spark.createDataFrame([(1, "Gardena", "GARDENA", True), (2, "K-Town", "KTOWN", True)],
                                   "id long, name string, code string, active boolean")
    items = spark.createDataFrame(
        [(1, "Whole Milk", "MILK-WHL", "Dairy", 4), (2, "Oat Milk", "MILK-OAT", "Dairy", 6),
         (3, "Espresso Beans", "BEA-HSE", "Coffee", 4), (4, "Cup 12oz", "CUP-12", "Supplies", 20)],
        "id long, item_name string, sku string, category string, case_pack_quantity int")
    settings = spark.createDataFrame(
        [(s, i, 10.0, 2.0, 3.0, 2.0, "round_up_case_pack", None, True) for s in (1, 2) for i in (1, 2, 3, 4)],
        "store_id long, item_id long, par_level double, safety_stock double, reorder_threshold double, "
        "min_send_quantity double, rounding_rule string, usage_window_days int, active boolean")
    usage = spark.createDataFrame(
        [(s, i, AS_OF - dt.timedelta(days=d), 5.0) for s in (1, 2) for i in (1, 2, 3, 4) for d in range(1, 8)],
        "store_id long, item_id long, usage_date date, quantity_used double")
    orders = spark.createDataFrame([], "store_id long, item_id long, order_date date, quantity_ordered double")
    snaps = spark.createDataFrame(
        [(s, i, AS_OF - dt.timedelta(days=1), 3.0) for s in (1, 2) for i in (1, 2, 3, 4)],
        "store_id long, item_id long, snapshot_date date, quantity_on_hand double")
    return dict(stores=stores, items=items, settings=settings, usage=usage, orders=orders,
                snapshots=snaps)
