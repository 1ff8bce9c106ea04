"""Order statistics and ranks against sorting everything."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from martlet.functions.order_stats import iqr_fence, quantile_edges, with_rank

SHAPES = {
    "one": [7], "two": [3, 9], "same": [5] * 40, "negative": list(range(-30, 31)),
    "third_is_one_value": [0] * 400 + [random.Random(1).randrange(10**6) for _ in range(800)],
    "one_far_away": [*range(200), 10**17], "wide": [random.Random(2).randrange(-10**11, 10**11) for _ in range(500)],
}


def expected_edges(values, parts):
    v, n = sorted(values), len(values)
    out = []
    for k in range(1, parts):
        low, rest = divmod((n - 1) * k, parts)
        out.append(v[low] * parts + rest * (v[min(low + 1, n - 1)] - v[low]))
    return out


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v bigint")


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("parts", [4, 5])
def test_edges_equal_sorted_positions(spark, shape, parts):
    (row,) = quantile_edges(frame(spark, SHAPES[shape]), "v", parts).collect()
    assert [int(e) for e in row.edges] == expected_edges(SHAPES[shape], parts)
    assert row.total == len(SHAPES[shape])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=60))
def test_edges_on_any_list(spark, values):
    (row,) = quantile_edges(frame(spark, values), "v", 4).collect()
    assert [int(e) for e in row.edges] == expected_edges(values, 4)


def test_edges_ignore_nulls_and_agree_with_numpy(spark):
    values = [random.Random(3).randrange(1000) for _ in range(101)]
    (row,) = quantile_edges(frame(spark, values + [None] * 50), "v", 4).collect()
    assert np.allclose([float(e) / 4 for e in row.edges], np.quantile(values, [0.25, 0.5, 0.75]))


def test_edges_per_group_have_their_own_extent(spark):
    data = {"a": list(range(50)), "b": [10**12 + i * 7 for i in range(33)], "c": [1]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v bigint")
    got = {r.g: [int(e) for e in r.edges] for r in quantile_edges(df, "v", 4, "g").collect()}
    assert got == {g: expected_edges(vs, 4) for g, vs in data.items()}


def test_fence_of_nothing_is_empty(spark):
    (row,) = iqr_fence(frame(spark, []), "v").collect()
    assert row.fence.low is None and row.fence.high is None


@pytest.mark.parametrize("shape", SHAPES)
def test_rank_shares_and_skips(spark, shape):
    values = SHAPES[shape]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v bigint")
    got = {r.id: r.place for r in with_rank(df, "v", "place").collect()}
    assert got == dict(enumerate(pd.Series(values).rank(method="min", ascending=False).astype(int)))
