import random

import pandas as pd
import pytest

from conftest import rows_of
from martlet.operators import segments as sg

KINDS = "customer_id bigint, recency_days int, frequency bigint, monetary decimal(22,2)"


def base_of(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(c, r, f, Decimal(str(m))) for c, r, f, m in rows], KINDS)


@pytest.mark.parametrize("n", [5, 7, 11, 12, 13, 100])
def test_scores_equal_pandas_quintiles(spark, n):
    rnd = random.Random(n)
    days = rnd.sample(range(1000), n)
    rows = [(i + 1, days[i], rnd.randrange(1, 4), round(rnd.uniform(1, 5000), 2)) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["customer_id", "r", "f", "m"]).set_index("customer_id")
    expected = pd.DataFrame({
        "r_score": pd.qcut(pdf.r, 5, labels=[5, 4, 3, 2, 1]).astype(int),
        "f_score": pd.qcut(pdf.f.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int),
        "m_score": pd.qcut(pdf.m, 5, labels=[1, 2, 3, 4, 5]).astype(int)})
    got = {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in sg.rfm_scores(base_of(spark, rows)).collect()}
    assert got == {c: tuple(v) for c, v in expected.iterrows()}


def test_hot_values_and_one_customer(spark):
    """A third of the customers alike, and one who spends more than all others: edges may coincide."""
    rows = [(i, 10 if i % 3 else 700 - i, 1, 5) for i in range(1, 91)] + [(91, 0, 10**6, 10**15)]
    scores = {r.customer_id: r for r in sg.rfm_scores(base_of(spark, rows)).collect()}
    assert scores[91].f_score == scores[91].m_score == 5
    assert sorted(r.f_score for r in scores.values()).count(1) == 19  # (91 - 1) / 5 and the first
    assert {r.m_score for c, r in scores.items() if c != 91} == {1}
    (only,) = sg.rfm_scores(base_of(spark, [(1, 3, 2, 9)])).collect()
    assert (only.r_score, only.f_score, only.m_score, only.rfm_score) == (5, 1, 1, 7)


@pytest.mark.parametrize("r,f,m,expected", [
    (5, 5, 5, "High Value"), (4, 4, 3, "Loyal"), (3, 4, 1, "Loyal"), (4, 2, 5, "New"), (2, 3, 1, "At Risk"), (2, 5, 5, "At Risk"),
    (4, 3, 5, "Dormant"), (3, 3, 3, "Dormant"), (1, 1, 1, "Dormant"), (3, 1, 5, "Dormant")])
def test_segment_rules(spark, r, f, m, expected):
    df = spark.createDataFrame([(r, f, m)], "r int, f int, m int")
    assert df.select(sg.segment_of(df.r, df.f, df.m)).first()[0] == expected


def test_from_sales_to_labelled_customers(shop):
    sales = shop.sales(*[{"customer_id": c, "order_date": f"2024-0{1 + c % 6}-1{c}", "revenue": 10 * c} for c in range(1, 7)
                         for _ in range(c)])
    people = shop.customers(*[(c,) for c in range(1, 9)])
    base = sg.rfm_base(sales, people)
    assert {r.customer_id: (r.recency_days, r.frequency, int(r.monetary)) for r in base.collect()}[6] == (151, 6, 360)
    segments = sg.rfm_segments(sg.rfm_scores(base))
    labelled = dict(rows_of(sg.apply_segments(people, segments), "customer_id", "customer_segment"))
    assert labelled[7] == labelled[8] == "No Orders Yet" and labelled[1] in sg.DESCRIPTIONS
    assert sum(r.customers for r in sg.segment_counts(segments).collect()) == 6
    assert all(r.description == sg.DESCRIPTIONS[r.segment] for r in sg.segment_profile(segments).collect())


def test_order_of_an_unknown_customer_is_ignored(shop):
    sales = shop.sales({"customer_id": 1, "order_date": "2024-01-01"}, {"customer_id": 99, "order_date": "2024-02-01"})
    assert rows_of(sg.rfm_base(sales, shop.customers((1,))), "customer_id", "recency_days") == [(1, 31)]
