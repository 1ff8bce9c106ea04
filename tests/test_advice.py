import pytest

from conftest import rows_of
from martlet.operators import advice as ad


@pytest.fixture
def goods(shop):
    return shop.products(*[(i, f"p{i}", "Office" if i < 5 else "Home") for i in range(1, 9)])


def test_losses_become_critical_above_three(shop, goods):
    def losing(n):
        return ad.rec_unprofitable_products(
            shop.sales(*[{"product_id": i, "revenue": 10, "cost": 10 + i if i <= n else 5} for i in range(1, 9)]), goods).collect()
    assert losing(0) == []
    (three,), (four,) = losing(3), losing(4)
    assert (three.priority, four.priority) == ("High", "Critical")
    assert (four.products, four.worst_product, four.worst_loss, four.total_loss) == (4, "p4", 4, 10)
    assert "p4" in four.finding and "Rs.10" in four.impact


@pytest.mark.parametrize("latest,fires", [(80, True), (81, False), (0, True)])
def test_decline_of_a_fifth(shop, goods, latest, fires):
    sales = shop.sales({"order_date": "2024-01-05", "revenue": 120}, {"order_date": "2024-03-05", "revenue": 80},
                       {"order_date": "2024-04-05", "revenue": latest},
                       {"order_date": "2024-01-05", "product_id": 8, "revenue": 500})  # no latest month: not compared
    got = ad.rec_regional_decline(sales, goods).collect()
    assert bool(got) == fires
    if latest == 80:
        assert (got[0].region, got[0].category, got[0].pct_vs_baseline, got[0].baseline) == ("North", "Office", -20.0, 100.0)


@pytest.mark.parametrize("returned,fires", [(1, True), (0, False)])
def test_return_rate_of_a_tenth(shop, goods, returned, fires):
    sales = shop.sales(*[{"return_status": "Returned" if i < returned else "Cancelled"} for i in range(10)])
    got = ad.rec_high_return_category(sales, goods).collect()
    assert bool(got) == fires and (not fires or "10.0%" in got[0].finding)


@pytest.mark.parametrize("days,fires", [([4, 4], True), ([4, 3], False)])
def test_slow_region(shop, days, fires):
    sales = shop.sales(*[{"region": "Far", "delivery_days": d} for d in days], {"region": "Near", "delivery_days": 1})
    assert rows_of(ad.rec_slow_delivery_region(sales), "region") == ([("Far",)] if fires else [])


def test_at_risk_and_cards_in_order(spark, shop, goods):
    sales = shop.sales({"customer_id": 1, "revenue": 100, "cost": 130, "delivery_days": 9, "return_status": "Returned"},
                       {"customer_id": 2, "revenue": 51, "delivery_days": 9})
    segments = spark.createDataFrame([(1, "At Risk"), (2, "At Risk"), (3, "At Risk"), (4, "Loyal")], "customer_id bigint, segment string")
    (risk,) = ad.rec_at_risk_customers(sales, segments).collect()
    assert (risk.customers, risk.average_spend, risk.at_stake) == (2, 75.5, 151)
    assert "Rs.76 each" in risk.evidence
    cards = ad.recommendation_cards(sales, goods, segments).collect()
    assert [(r.rule, r.priority) for r in cards] == [(1, "High"), (3, "High"), (4, "Medium"), (5, "Medium")]
    none = ad.recommendation_cards(shop.sales(), goods, segments.where("customer_id > 9"))
    assert none.count() == 0
