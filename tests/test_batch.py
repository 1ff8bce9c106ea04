"""Raw CSV files to published results, on the small tables."""

from conftest import SMALL
from martlet import registry
from martlet.operators import churn, quality, segments as sg
from martlet.plans import batch
from martlet.sources import raw, writers
from martlet.sources.schemas import RAW
from martlet.sources.star import Star


def test_from_files_to_reports(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(churn, "TREES", 10)
    star, folder, out = Star(spark, SMALL), str(tmp_path / "raw"), str(tmp_path / "out")
    tables = {"customers": raw.raw_customers(star), "products": raw.raw_products(star), "orders": raw.raw_orders(star)}
    # One file per table, in ingest order: "first of several copies" means first in the file.
    writers.write_csv_star({n: df.coalesce(1).orderBy("seq", registry.KEYS[n]).coalesce(1).select(*RAW[n].names)
                            for n, df in tables.items()}, folder)
    check, results = batch.run(spark, folder, out, registry.AS_OF, registry.REGIONS)
    expected = {a.table: a.cleaned().count() for a in registry.star_audit(star)}
    assert {r.table_name: (r.expected, r.actual, r.status) for r in check.collect()} == {
        t: (n, n, "OK") for t, n in expected.items()}
    of_orders = check.where("table_name = 'orders'").first()
    assert of_orders.orphans == 0 and of_orders.total_revenue == quality.load_total_revenue(registry.star_audit(star).orders.cleaned()).first()[0]
    segmented = results["customers_segmented"]
    assert segmented.count() == expected["customers"]
    assert {r.customer_segment for r in segmented.select("customer_segment").distinct().collect()} <= {*sg.DESCRIPTIONS, sg.NO_ORDERS}
    assert results["churn_predictions"].count() == results["churn_features"].count() > 0
    assert results["churn_metrics"].where("selected").count() == 1
    assert [r.rule for r in results["recommendations"].orderBy("priority_rank", "rule").collect()][0] == 1
    span = results["daily_metrics"].selectExpr("datediff(max(date), min(date)) + 1 AS days", "count(*) AS n", "sum(orders) AS o").first()
    assert span.days == span.n and span.o == expected["orders"] and results["anomalies"].count() > 0
