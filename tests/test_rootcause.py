from datetime import date

import pytest

from conftest import day, rows_of, value_of
from martlet.operators import rootcause as rc


@pytest.fixture
def two_months(shop):
    sales = shop.sales(
        {"order_date": "2024-01-31", "region": "North", "revenue": 1000, "product_id": 1},
        {"order_date": "2024-01-01", "region": "South", "revenue": 500, "product_id": 2, "payment_method": "Cash"},
        {"order_date": "2024-02-01", "region": "North", "revenue": 700, "product_id": 1},
        {"order_date": "2024-02-29", "region": "East", "revenue": 300, "product_id": 2, "return_status": "Returned"},
        {"order_date": "2024-03-01", "region": "West", "revenue": 9999, "product_id": 2})
    return sales, shop.products((1, "pen", "Office"), (2, "cup", "Home"))


def test_month_bounds():
    assert rc.month_bounds("2024-02") == (date(2024, 2, 1), date(2024, 2, 29))
    assert rc.month_bounds("2023-12")[1] == date(2023, 12, 31)


def test_changes_of_every_slice(two_months):
    got = {(r.dimension_type, r.dimension_value): (r.before, r.after, r.change, r.pct_change) for r in
           rc.compare_periods(*two_months, "2024-01", "2024-02").collect()}
    assert got["region", "South"] == (500, 0, -500, -100.0)
    assert got["region", "East"] == (0, 300, 300, 0.0)       # absent before
    assert got["region", "North"] == (1000, 700, -300, -30.0)
    assert got["category", "Home"] == (500, 300, -200, -40.0)
    assert got["return_status", "Not Returned"] == (1500, 700, -800, -53.3)
    assert ("region", "West") not in got and len(got) == 8  # Card stayed the same


def test_small_moves_are_left_out(shop):
    sales = shop.sales({"order_date": "2024-01-05", "revenue": 1000, "region": "A"}, {"order_date": "2024-02-05", "revenue": 1000, "region": "A"},
                       {"order_date": "2024-02-05", "revenue": "10.09", "region": "B"}, {"order_date": "2024-02-05", "revenue": "9.99", "region": "C"})
    got = rc.compare_periods(sales, shop.products((1, "p", "c")), "2024-01", "2024-02").where("dimension_type = 'region'")
    assert rows_of(got, "dimension_value") == [("B",)]


def test_tops_and_totals(two_months):
    changes = rc.compare_periods(*two_months, "2024-01", "2024-02")
    assert rows_of(rc.top_negative_contributors(changes, 1), "dimension_value", "change") == [("Not Returned", -800)]
    assert rows_of(rc.top_positive_contributors(changes, 2), "change") == [(300,), (300,)]
    total = rc.compare_totals(two_months[0], "2024-01", "2024-02").first()
    assert (total.total_a, total.total_b, total.pct_change) == (1500, 1000, -33.33)
    assert value_of(rc.period_total(two_months[0], day("2024-01-01"), day("2024-01-31"))) == 1500
    assert rc.auto_periods(two_months[0]).first() == ("2024-01", "2024-02")
    assert rows_of(rc.period_breakdown(*two_months, day("2024-01-01"), day("2024-02-29"), "category"), "dimension_value", "value") == [
        ("Office", 1700), ("Home", 800)]


def test_nothing_before_and_unknown_names(two_months):
    assert rc.compare_totals(two_months[0], "2020-01", "2024-02").first().pct_change == 0.0
    assert rc.compare_periods(*two_months, "2020-01", "2020-02").count() == 0
    with pytest.raises(ValueError):
        rc.compare_periods(*two_months, "2024-01", "2024-02", "revenue) FROM x; --")
    with pytest.raises(ValueError):
        rc.period_breakdown(*two_months, day("2024-01-01"), day("2024-01-31"), "customer_id")


def test_lines_of_unknown_products_count_everywhere_but_in_the_category(shop):
    sales = shop.sales(
        {"product_id": 1, "order_date": "2024-01-05", "revenue": 100, "region": "North"},
        {"product_id": 9, "order_date": "2024-01-06", "revenue": 50, "region": "North"},
        {"product_id": 1, "order_date": "2024-02-05", "revenue": 10, "region": "North"})
    goods = shop.products((1, "a", "Toys"))
    got = {(r["dimension_type"], r["dimension_value"]): (float(r["before"]), float(r["after"]))
           for r in rc.compare_periods(sales, goods, "2024-01", "2024-02").collect()}
    assert got["region", "North"] == (150.0, 10.0) and got["category", "Toys"] == (100.0, 10.0)
    assert not any(value is None for _, value in got)
    total = rc.compare_totals(sales, "2024-01", "2024-02").first()
    assert (float(total["total_a"]), float(total["total_b"])) == (150.0, 10.0)


def test_profit_changes_from_quantities_equal_those_of_stored_profit(shop):
    sales = shop.sales(*[{"product_id": 1 + i % 3, "order_date": f"2024-0{1 + i % 2}-05", "revenue": 20 + i, "quantity": 1 + i % 4,
                          "cost": (1 + i % 3) * (1 + i % 4)} for i in range(24)])
    goods = shop.products(*[(k, f"p{k}", f"c{k % 2}", k, 9) for k in (1, 2, 3)])
    stored = rc.compare_periods(sales, goods, "2024-01", "2024-02", "profit").collect()
    assert rc.compare_periods(sales.drop("profit", "cost"), goods, "2024-01", "2024-02", "profit").collect() == stored
