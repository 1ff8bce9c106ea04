"""The daily cube: equal to the fact it sums, refreshed by months, read instead of the fact."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest

from conftest import SMALL
from martlet import registry
from martlet.operators import anomalies as an
from martlet.plans import cube
from martlet.sources import readers, writers
from martlet.sources.star import Star


def batch_of(shop, first, days, seed):
    """Order lines on the given days, with ids from `first`."""
    rnd = random.Random(seed)
    rows = [{"order_id": f"{first + i:06d}", "order_date": d, "product_id": rnd.randrange(1, 4), "revenue": rnd.randrange(50, 90), "region": rnd.choice(["North", "South"]),
             "return_status": rnd.choice(["Returned", "Not Returned"])} for i, d in enumerate(days)]
    return {"customers": shop.customers((1, "2024-01-10"), (2, "2024-02-03")), "orders": shop.sales(*rows),
            "products": shop.products((1, "pen", "Office"), (2, "cup", "Kitchen"), (3, "mug", "Kitchen"))}


def days(start, n):
    return [date.fromisoformat(start) + timedelta(i) for i in range(n)]


def rows(df):
    return sorted(map(str, df.select("order_date", "region", "category", "revenue", "profit", "orders", "returned").collect()))


def files(folder):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in Path(folder).glob("cells/order_month=*/*.parquet")}


def test_a_late_batch_replaces_its_months_only(spark, shop, tmp_path):
    store, folder = str(tmp_path / "store"), str(tmp_path / "cube")
    assert cube.refresh(spark, store, folder) == []
    writers.append_cleaned(spark, batch_of(shop, 0, days("2024-01-01", 100), 1), store)
    assert [m.month for m in cube.refresh(spark, store, folder)] == [1, 2, 3, 4]
    before = files(folder)
    writers.append_cleaned(spark, batch_of(shop, 500, days("2024-02-20", 15), 2), store)
    assert [m.month for m in cube.refresh(spark, store, folder)] == [2, 3]
    after = files(folder)
    assert {m[-5:-3] for m in after if after[m] != before[m]} == {"02", "03"} and set(after) == set(before)
    direct = an.daily_cells(readers.read_cleaned(spark, store, "orders"), readers.read_cleaned(spark, store, "products"))
    assert rows(cube.read(spark, folder)) == rows(direct)
    assert cube.refresh(spark, store, folder) == [] and files(folder) == after


def test_a_refresh_stopped_before_its_end_is_repeated_and_adds_nothing_twice(spark, shop, tmp_path, monkeypatch):
    store, folder = str(tmp_path / "store"), str(tmp_path / "cube")
    writers.append_cleaned(spark, batch_of(shop, 0, days("2024-01-01", 40), 3), store)
    real = cube.write

    def stopped(cells, place):
        real(cells, place)
        raise RuntimeError("stopped")

    monkeypatch.setattr(cube, "write", stopped)
    with pytest.raises(RuntimeError, match="stopped"):
        cube.refresh(spark, store, folder)
    monkeypatch.setattr(cube, "write", real)
    assert [m.month for m in cube.refresh(spark, store, folder)] == [1, 2]
    assert cube.read(spark, folder).groupBy().sum("orders").first()[0] == 40


def test_cells_give_what_lines_give(spark, shop):
    given = batch_of(shop, 0, [*days("2024-01-01", 60), *days("2024-01-20", 9)], 4)
    orders = given["orders"].unionByName(shop.sales({"order_date": "2024-01-30", "product_id": 99, "revenue": 9000}))
    cells = an.daily_cells(orders, given["products"])
    daily = an.daily_metrics(cells, given["customers"])
    # The unknown product's line counts in revenue, and explains nothing.
    assert daily.where("date = '2024-01-30'").first().revenue > 9000
    lines = an.detect_anomalies(daily, orders, given["products"]).collect()
    assert lines and an.detect_anomalies(daily, cells, given["products"]).collect() == lines
    assert an.daily_cells(orders.limit(0), given["products"]).collect() == []


def test_anomalies_do_not_read_the_fact_again(spark):
    star = Star(spark, SMALL)
    plan = registry._anomalies(star)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "orderkey" not in plan
    once = registry._daily_cells(star)._jdf.queryExecution().optimizedPlan().toString()
    assert once.count("l_orderkey#") and once.count("Relation [l_orderkey") == 1
