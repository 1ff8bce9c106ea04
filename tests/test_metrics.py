from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import day, rows_of, value_of
from martlet.operators import customers as cu, dashboards, measures, operations as op, products as pr, sales as sa


@pytest.fixture
def six(shop):
    return shop.sales(
        {"customer_id": 1, "product_id": 1, "order_date": "2024-01-05", "revenue": 100, "cost": 60, "return_status": "Returned"},
        {"customer_id": 1, "product_id": 1, "order_date": "2024-01-20", "revenue": 50, "cost": 60, "discount": "0.10"},
        {"customer_id": 2, "product_id": 2, "order_date": "2024-03-01", "revenue": 200, "cost": 90, "region": "South",
         "delivery_days": 6, "discount": "0.11"},
        {"customer_id": 3, "product_id": 3, "order_date": "2024-06-30", "revenue": 10, "cost": 40, "return_status": "Cancelled",
         "discount": "0.21"},
        {"customer_id": 3, "product_id": 2, "order_date": "2024-06-30", "revenue": 20, "cost": 5, "discount": "0.20"},
        {"customer_id": 3, "product_id": 2, "order_date": "2024-06-30", "revenue": 20, "cost": 5},
    )


@pytest.fixture
def goods(shop):
    return shop.products((1, "pen", "Office"), (2, "cup", "Home"), (3, "pen", "Office"), (4, "unsold", "Home"))


def test_category_performance(six, goods):
    got = rows_of(pr.category_performance(six, goods))
    assert got == [("Home", 240, 140, 3, 0.0), ("Office", 160, 0, 3, 33.33)]


def test_products_are_merged_by_name_and_category(six, goods):
    assert rows_of(pr.top_products(six, goods, 1)) == [("cup", "Home", 240, 140, 3)]
    assert rows_of(pr.top_products(six, goods, 1, by="nonsense")) == rows_of(pr.top_products(six, goods, 1, by="revenue"))
    assert rows_of(pr.bottom_products(six, goods, 5))[0][0] == "pen"
    assert rows_of(pr.low_margin_products(six, goods)) == []  # nothing has five orders
    assert rows_of(pr.most_profitable_products(six, goods, 1), "total_profit", "margin_pct") == [(140, 58.33)]


def test_totals_and_ranges(six, shop):
    assert value_of(sa.total_revenue(six)) == 400
    assert value_of(sa.total_revenue(six, day("2024-01-20"), day("2024-03-01"))) == 250
    assert value_of(sa.total_profit(six, end=day("2024-01-20"))) == 30
    assert value_of(sa.profit_margin(six)) == 35.0
    assert value_of(sa.average_order_value(six)) == 66.67


def test_rounding_is_half_up_also_below_zero(shop):
    assert value_of(sa.average_order_value(shop.sales({"revenue": "0.01"}, {"revenue": "0.00"}))) == 0.01
    loss = shop.sales({"revenue": 8, "cost": 9}, {"revenue": "0", "cost": "0.01"})
    assert value_of(sa.profit_margin(loss)) == -12.63


def test_empty_input(shop):
    none = shop.sales()
    for df in (sa.total_revenue(none), sa.total_profit(none), sa.profit_margin(none), sa.average_order_value(none),
               cu.retention_rate(none), cu.churn_rate(none), cu.average_purchase_frequency(none), cu.returning_customers(none),
               op.average_delivery_time(none), op.cancellation_rate(none), op.return_rate(none)):
        assert value_of(df) == 0
    people = shop.customers((1,))
    assert rows_of(dashboards.executive_summary(none, people)) == [(0, 0, 0, 1, 0.0, 0.0, 0.0)]
    assert sa.monthly_revenue(none).count() == 0 and measures.date_table(none).count() == 0


def test_growth_compares_with_the_previous_month_present(shop):
    rows = shop.sales({"order_date": "2024-01-05", "revenue": 100}, {"order_date": "2024-03-05", "revenue": 150},
                      {"order_date": "2024-04-05", "revenue": 0}, {"order_date": "2024-05-05", "revenue": 10})
    assert [r.revenue_growth_pct for r in sa.revenue_growth_mom(rows).collect()] == [None, 50.0, -100.0, None]
    assert [r.month.month for r in sa.recent_growth(rows, 2).collect()] == [4, 5]
    prior = {r.month.month: (r.revenue_prior_month, r.revenue_mom_growth) for r in measures.prior_month(rows, "revenue").collect()}
    assert prior == {1: (None, 0.0), 2: (100, -1.0), 3: (None, 0.0), 4: (150, -1.0), 5: (0, 0.0)}


def test_prior_month_by_group_of_the_same_dates(shop):
    """A gap month keeps its prior value; the last month, there in part, is compared with the same days."""
    sales = shop.sales(
        {"order_date": "2024-01-10", "revenue": 100, "region": "North"}, {"order_date": "2024-01-31", "revenue": 7, "region": "South"},
        {"order_date": "2024-03-05", "revenue": 40, "region": "North"}, {"order_date": "2024-03-25", "revenue": 60, "region": "North"},
        {"order_date": "2024-04-10", "revenue": 80, "region": "South"})
    got = {r.month.month: (r.total_revenue, r.revenue_prior_month, r.revenue_mom_growth) for r in measures.prior_month(sales, "revenue").collect()}
    assert got == {1: (107, None, 0.0), 2: (None, 107, -1.0), 3: (100, None, 0.0), 4: (80, 40, 1.0)}
    by = {(r.region, r.month.month): (r.total_revenue, r.revenue_prior_month) for r in measures.prior_month(sales, "revenue", ["region"]).collect()}
    assert by == {("North", 1): (100, None), ("South", 1): (7, None), ("North", 2): (None, 100), ("South", 2): (None, 7),
                  ("North", 3): (100, None), ("North", 4): (None, 40), ("South", 4): (80, None)}
    only = measures.prior_month(sales, "revenue", where=F.col("region") == "South")
    assert {r.month.month: r.revenue_prior_month for r in only.collect()} == {1: None, 2: 7, 3: None, 4: None}


def test_filtered_kpis(six):
    from_south = measures.kpis(six, [], ["total_orders"], F.col("region") == "South")
    assert value_of(from_south) == 1


def test_profit_from_quantities_equals_stored_profit(shop):
    sales = shop.sales(*[{"product_id": i % 4, "revenue": 30 + i, "quantity": i % 5, "cost": (i % 4 + 1) * (i % 5), "order_date": f"2024-0{1 + i % 3}-03"}
                         for i in range(40)])
    goods = shop.products(*[(k, f"p{k % 3}", f"c{k % 2}", k + 1, 9) for k in range(4)])
    bare = sales.drop("profit", "cost")
    for report in (pr.category_performance, pr.top_products, pr.most_profitable_products, pr.low_margin_products, pr.monthly_summary):
        a, b = (sorted(map(tuple, report(x, goods).collect()), key=str) for x in (sales, bare))
        assert a == b
    cells = pr.profit_cells(bare, goods)
    assert rows_of(sa.sales_summary(cells)) == rows_of(sa.sales_summary(sales))


def test_discount_brackets(six):
    got = rows_of(sa.discount_analysis(six), "discount_bracket", "orders")
    assert got == [("No discount", 2), ("1-10%", 1), ("11-20%", 2), ("21%+", 1)]


def test_customers(six, shop):
    people = shop.customers((1, "2024-01-01"), (2, "2024-02-01"), (3, "2024-02-20"), (4, "2024-05-05"))
    assert value_of(cu.returning_customers(six)) == 2
    assert value_of(cu.retention_rate(six)) == 66.67
    assert value_of(cu.churn_rate(six, 90)) == 66.67     # last orders of 1 and 2 are older than 90 days
    assert value_of(cu.churn_rate(six, 121)) == 33.33    # exactly 121 days is not yet churned
    assert value_of(cu.average_purchase_frequency(six)) == 2.0
    value = rows_of(cu.customer_lifetime_value(six, people), "customer_id", "lifetime_revenue", "total_orders")
    assert value == [(2, 200, 1), (1, 150, 2), (3, 50, 3), (4, 0, 0)]
    assert rows_of(cu.new_customers_by_month(people), "new_customers") == [(1,), (2,), (1,)]


def test_operations(six, goods):
    assert value_of(op.average_delivery_time(six)) == 3.5
    assert value_of(op.return_rate(six)) == value_of(op.cancellation_rate(six)) == 16.67
    assert rows_of(op.regional_operational_performance(six), "region", "avg_delivery_days", "total_orders") == [
        ("North", 3.0, 5), ("South", 6.0, 1)]
    assert rows_of(op.delivery_time_by_category(six, goods)) == [("Home", 4.0, 3), ("Office", 3.0, 3)]


def test_kpis_by_group(six):
    got = measures.kpis(six, ["region"], ["total_customers", "retention_rate", "clv", "profit_margin", "return_rate"])
    assert {r.region: tuple(r)[1:] for r in got.collect()} == {
        "North": (2, 1.0, 100.0, 30 / 200, 0.2), "South": (1, 0.0, 200.0, 0.55, 0.0)}
    assert rows_of(measures.churn_rate_90(six, [])) == [(2 / 3,)]
    with pytest.raises(ValueError):
        measures.kpis(six, [], ["salary"])


def test_calendar_and_new_customers(six, shop):
    table = measures.date_table(six)
    assert table.count() == 178
    first = table.orderBy("date").first()
    assert (first.month_name, first.quarter) == ("Jan 2024", "Q1 2024")
    people = shop.customers((1, "2024-01-04"), (2, "2024-01-05"), (3, "2024-02-20"), (4, "2024-07-01"))
    assert [r.new_customers for r in measures.new_customers(six, people).orderBy("month").collect()] == [1, 1, 0, 0, 0, 0]


def test_revenue_rank_covers_unsold_names(six, goods):
    got = {r.product_name: (r.total_revenue, r.revenue_rank, r.top10_flag) for r in measures.revenue_rank(six, goods).collect()}
    assert got == {"cup": (Decimal(240), 1, "Top 10"), "pen": (Decimal(160), 2, "Top 10"), "unsold": (Decimal(0), 3, "Top 10")}
