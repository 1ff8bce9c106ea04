import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows_of
from martlet import registry
from martlet.operators import churn
from martlet.sources.star import Star


def test_the_label_is_not_a_feature():
    assert "recency_days" not in churn.NUMERIC and churn.TARGET not in churn.NUMERIC
    assert len(churn.NUMERIC) == 6 and churn.CATEGORICAL == "region"


@pytest.mark.parametrize("p,band", [(0.10, "Low Risk"), (0.32, "Low Risk"), (0.33, "Medium Risk"), (0.65, "Medium Risk"),
                                    (0.66, "High Risk"), (0.99, "High Risk")])
def test_risk_bands(spark, p, band):
    assert spark.range(1).select(churn.risk_category(F.lit(p))).first()[0] == band


def test_features(shop):
    sales = shop.sales(
        {"customer_id": 1, "order_date": "2024-01-01", "revenue": 10, "return_status": "Returned"},
        {"customer_id": 1, "order_date": "2024-02-01", "revenue": 20}, {"customer_id": 2, "order_date": "2024-05-31"},
        {"customer_id": 3, "order_date": "2024-02-01"})
    got = {r.customer_id: r for r in churn.churn_features(sales, shop.customers((1,), (2,), (3,), (4,)), 119).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert (one.frequency, one.avg_order_value, one.return_frequency, one.recency_days, one.customer_tenure_days) == (2, 15.0, 0.5, 120, 31)
    assert [got[c].churned for c in (1, 2, 3)] == [1, 0, 1]
    assert {r.churned for r in churn.churn_features(sales, shop.customers((1,)), 120).collect()} == {0}


@pytest.mark.parametrize("sizes", [(40, 13), (1, 2), (8, 0), (97, 3)])
def test_split_takes_a_quarter_of_each_label(spark, sizes):
    rows = [(i * 31, label) for label, n in enumerate(sizes) for i in range(label * 1000, label * 1000 + n)]
    df = spark.createDataFrame(rows, "customer_id bigint, churned int")
    first, again = (dict(rows_of(churn.churn_split(df), "customer_id", "is_test")) for _ in range(2))
    assert first == again
    by_label = dict(rows)
    for label, n in enumerate(sizes):
        assert sum(t for c, t in first.items() if by_label[c] == label) == -(-n // 4)
    if sizes == (40, 13):
        assert first != dict(rows_of(churn.churn_split(df, seed=7), "customer_id", "is_test"))


def test_selection_prefers_the_larger_area_then_the_first():
    assert churn.churn_select({churn.LOGISTIC: 0.8, churn.FOREST: 0.81}) == churn.FOREST
    assert churn.churn_select({churn.LOGISTIC: 0.8, churn.FOREST: 0.8}) == churn.LOGISTIC


def test_models_score_every_customer(spark, monkeypatch):
    monkeypatch.setattr(churn, "TREES", 10)
    star = Star(spark, SMALL)
    trained = churn.train(registry._stored_features(star))
    stages = [type(s).__name__ for s in trained.model.stages]
    assert "StandardScalerModel" in stages and "OneHotEncoderModel" in stages
    metrics = {r.model: r for r in trained.metrics.collect()}
    assert set(metrics) == {churn.LOGISTIC, churn.FOREST}
    for row in metrics.values():
        (tn, fp), (fn, tp) = row.confusion_matrix
        assert round((tp + tn) / (tp + tn + fp + fn), 4) == row.accuracy and 0.5 < row.roc_auc <= 1
    features = registry._features(star)
    scored = churn.churn_score(trained.model, features)
    assert scored.count() == features.count()
    assert scored.where("churn_probability < 0 OR churn_probability > 1").count() == 0
    impact = churn.churn_feature_impact(trained.model, features).collect()
    assert [r.importance for r in impact] == sorted((r.importance for r in impact), reverse=True)
    assert {r.feature for r in impact} > set(churn.NUMERIC)


def test_models_score_after_an_observation(spark, monkeypatch):
    """A session that took one cannot be sent to tasks, so no model may hold it."""
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    monkeypatch.setattr(churn, "TREES", 3)
    features = spark.createDataFrame(
        [(i, "North" if i % 3 else "South", 30 + i % 20, 1 + i % 4, 10.0 * i, 10.0 + i % 7, 0.1 * (i % 3), 5, i % 30, int(i % 5 > 1)) for i in range(1, 81)],
        "customer_id bigint, region string, age int, frequency bigint, monetary double, avg_order_value double, "
        "return_frequency double, recency_days int, customer_tenure_days int, churned int")
    rows = churn.model_input(features)
    for name, fit in ((churn.LOGISTIC, churn.churn_logistic), (churn.FOREST, churn.churn_forest)):
        model = fit(rows)
        (row,) = churn.churn_evaluate(model, name, rows).collect()
        assert sum(map(sum, row.confusion_matrix)) == 80 and 0.5 < row.roc_auc <= 1
        assert churn.churn_score(model, features).where("churn_probability BETWEEN 0 AND 1").count() == 80
        assert not model.stages[-1].hasSummary


def test_unknown_region_is_all_zeros(spark, shop):
    rows = [(i, "North" if i % 2 else "South", 30 + i, i, 10.0 * i, 10.0, 0.1, 5, 9, i % 2) for i in range(1, 9)]
    kinds = ("customer_id bigint, region string, age int, frequency bigint, monetary double, avg_order_value double, "
             "return_frequency double, recency_days int, customer_tenure_days int, churned int")
    known, new = spark.createDataFrame(rows, kinds), spark.createDataFrame([(9, "Mars", 30, 1, 1.0, 1.0, 0.0, 1, 1, 0)], kinds)
    from pyspark.ml import Pipeline
    fitted = Pipeline(stages=churn.preprocessing()).fit(churn.model_input(known))
    features = fitted.transform(churn.model_input(new)).first().features.toArray()
    assert list(features[6:]) == [0.0, 0.0]


def test_queries_on_models_run_after_an_observation(spark, monkeypatch):
    """Each registered query that scores with a fitted model, in a session that took an observation."""
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    monkeypatch.setattr(churn, "TREES", 3)
    monkeypatch.setattr(registry, "_TRAINED", {})
    got = {name: registry.QUERIES[name](spark, SMALL).collect() for name in (
        "churn_forest", "churn_evaluate", "churn_select", "churn_feature_impact", "churn_score", "risk_category",
        "risk_counts", "risk_filter", "churn_model_io", "churn_held_out")}
    everybody = {r.customer_id for r in got["churn_score"]}
    assert len(everybody) == len(got["churn_score"]) == registry.QUERIES["churn_features"](spark, SMALL).count()
    assert sorted(map(tuple, got["churn_model_io"])) == sorted(map(tuple, got["churn_score"]))
    assert {r.customer_id for r in got["risk_category"]} == everybody and all(r.in_range and r.band_agrees for r in got["risk_category"])
    assert sum(r.customers for r in got["risk_counts"]) == len(everybody)
    assert {r.customer_id for r in got["risk_filter"]} == {r.customer_id for r in got["churn_score"] if r.risk_category != "Low Risk"}
    assert {r.customer_id for r in got["churn_forest"]} < everybody
    held = {(r.model, r.churned): r.customers for r in got["churn_held_out"]}
    assert sum(held.values()) == 2 * len(got["churn_forest"])
    best = max(r.roc_auc for r in got["churn_evaluate"])
    assert len(got["churn_evaluate"]) == 2 and [r.roc_auc for r in got["churn_select"]] == [best]
    assert {r.feature for r in got["churn_feature_impact"]} > set(churn.NUMERIC)


def test_forest_keeps_node_ids_and_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(churn, "TREES", 5)
    features = spark.createDataFrame(
        [(i, "North" if i % 3 else "South", 30 + i * 7 % 20, 1 + i % 4, 10.0 * i, 10.0 + i % 7, 0.1 * (i % 3), 5, i % 30, int(i * 13 % 11 > 4)) for i in range(1, 201)],
        "customer_id bigint, region string, age int, frequency bigint, monetary double, avg_order_value double, "
        "return_frequency double, recency_days int, customer_tenure_days int, churned int")
    rows = churn.model_input(features)
    kept = churn.churn_forest(rows).stages[-1]
    assert kept.getCacheNodeIds()
    kind = churn.RandomForestClassifier
    monkeypatch.setattr(churn, "RandomForestClassifier", lambda **settings: kind(**{**settings, "cacheNodeIds": False}))
    walked = churn.churn_forest(rows).stages[-1]
    assert not walked.getCacheNodeIds() and walked.toDebugString.split("\n", 1)[1] == kept.toDebugString.split("\n", 1)[1]
