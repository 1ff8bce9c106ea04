import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from conftest import rows_of
from martlet.operators import anomalies as an


@pytest.fixture
def season(shop):
    """40 days: a quiet stretch of equal days, noise, a gap of three days and one spike."""
    rnd, rows, start = random.Random(5), [], date(2024, 1, 1)
    for i in range(40):
        if i in (15, 16, 17):
            continue
        amount = 100 if i < 9 else 5000 if i == 30 else 100 + rnd.randrange(40)
        rows.append({"order_date": start + timedelta(i), "revenue": amount, "cost": 60,
                     "return_status": "Returned" if i % 4 == 0 else "Not Returned", "region": "North" if i % 2 else "South"})
    return shop.sales(*rows), shop.customers((1, "2023-12-31"), (2, "2024-01-16"), (3, "2024-02-09"), (4, "2024-02-10"))


def series(daily, metric):
    return pd.DataFrame([(r.date, float(r[metric])) for r in daily.orderBy("date").collect()], columns=["date", "v"]).set_index("date").v


def test_gaps_are_zero_and_signups_outside_are_dropped(season):
    daily = an.daily_metrics(*season)
    assert daily.count() == 40
    gap = {r.date.day: tuple(r)[1:] for r in daily.where("date BETWEEN '2024-01-16' AND '2024-01-18'").collect()}
    assert gap == {16: (0, 0, 0, 0, 1), 17: (0, 0, 0, 0, 0), 18: (0, 0, 0, 0, 0)}
    assert daily.agg({"new_customers": "sum"}).first()[0] == 2


@pytest.mark.parametrize("metric", ["revenue", "returns"])
def test_rolling_equals_pandas(season, metric):
    daily = an.daily_metrics(*season)
    v = series(daily, metric)
    mean, std = v.rolling(14, min_periods=7).mean(), v.rolling(14, min_periods=7).std()
    z = (v - mean) / std.where(std > 1e-9)
    got = {r.date: r for r in an.rolling(daily, [metric]).collect()}
    for d in v.index:
        for mine, theirs in ((got[d].expected_value, mean[d]), (got[d].z_score, z[d])):
            assert (mine is None and np.isnan(theirs)) or mine == pytest.approx(theirs, abs=0.0051), d


def test_iqr_equals_pandas(season):
    daily = an.daily_metrics(*season)
    for metric in an.METRICS:
        v = series(daily, metric)
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        expected = {d for d in v.index if v[d] < q1 - 1.5 * (q3 - q1) or v[d] > q3 + 1.5 * (q3 - q1)}
        assert {r.date for r in an.iqr_flags(daily, [metric]).where("outlier").collect()} == expected


def test_spike_is_found_and_explained(season, shop):
    sales, people = season
    goods = shop.products((1, "pen", "Office"))
    found = an.detect_anomalies(an.daily_metrics(sales, people), sales, goods)
    spike = {(r.metric, r.date.isoformat()): r for r in found.collect()}["revenue", "2024-01-31"]
    assert spike.flagged_by == "z-score" and spike.z_score >= 2.5 and spike.actual_value == 5000
    assert spike.possible_contributors == "South/Office: 5,000"
    gap = {(r.metric, r.date.day): r.possible_contributors for r in found.where("date < '2024-01-20'").collect()}
    assert gap.get(("revenue", 16)) == "no orders that day"
    assert all(r.possible_contributors == "" for r in found.collect() if r.metric not in an.EXPLAINED)
    assert [r.date for r in an.recent_anomalies(found, 3).collect()] == sorted(
        (r.date for r in found.collect()), reverse=True)[:3]
    counts = {r.metric: r.anomalies for r in an.anomaly_counts(found).collect()}
    assert counts["revenue"] == an.anomaly_filter(found, "revenue").count()


def test_fewer_than_nine_days_never_reach_the_threshold(shop):
    sales = shop.sales(*[{"order_date": date(2024, 1, 1 + i), "revenue": 10**6 if i == 7 else 1} for i in range(8)])
    assert an.rolling(an.daily_metrics(sales, shop.customers()), ["revenue"]).where("abs(z_score) >= 2.5").count() == 0


def test_nothing_to_report_is_an_empty_frame(shop):
    sales, goods = shop.sales(), shop.products()
    empty = an.detect_anomalies(an.daily_metrics(sales, shop.customers()), sales, goods)
    assert empty.columns == ["metric", "date", "actual_value", "expected_value", "z_score", "flagged_by", "possible_contributors"]
    assert rows_of(empty) == []
