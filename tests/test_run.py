"""The whole run from raw CSV batches to exports."""

from pathlib import Path

from pyspark.sql import functions as F

from basketry import run
from basketry.sources import sample_tables, scan, sinks, versions


def test_run_from_raw_batches_to_exports(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path)
    for name, df in sample_tables.raw_batches(spark, folder).items():
        dated = df.where(F.col("InvoiceDate") != "not a date").drop("line_no")
        sinks.write_csv(dated, f"{out}/raw/{name}")
    batches = {n: f"{out}/raw/{n}" for n in sample_tables.BATCHES}
    raw_scans, pinned = [], spark.conf.get("spark.checkpoint.dir")
    read = scan.scan_batches
    monkeypatch.setattr(scan, "scan_batches", lambda *a, **b: raw_scans.append(a) or read(*a, **b))
    counted = []
    gate = run.gates.mart_gates
    monkeypatch.setattr(run.gates, "mart_gates", lambda tables, *a: counted.append(tables) or gate(tables, *a))
    marts = run.run(spark, batches, f"{out}/o", home=sample_tables.HOME, k_values=(3, 4), n_init=5)
    assert len(raw_scans) == 1
    # The gates read the files that were published, and nothing pinned is left behind.
    assert all("csv" in t._jdf.queryExecution().toString().lower() for t in counted[0].values())
    pins = Path(pinned.removeprefix("file://")) / "basketry-pins"
    assert not pins.exists() or not any(pins.iterdir())
    assert set(marts) == {
        "dim_date", "fact_orders", "dim_customer", "fact_product_month", "fact_country_month",
        "fact_returns_month", "cohort_retention", "segment_summary", "cluster_summary", "kpi_snapshot",
    }
    reports = {r: scan.read_json_summary(spark, f"{out}/o/reports/{r}") for r in ("sql_manifest", "mart_gates", "clustering_summary")}
    assert reports["sql_manifest"].count() == 13
    assert reports["mart_gates"].where("NOT passed").count() == 0
    assert reports["clustering_summary"].first()["operational_chosen"]["k"] == 4
    kpi = marts["kpi_snapshot"].first()
    dashboard = versions.latest(spark, f"{out}/o/dashboard")
    exported = dashboard.read(spark, "fact_orders", "csv", header=True)
    assert dashboard.tables["fact_orders"]["rows"] == kpi["completed_orders"] and dashboard.number == 1
    assert exported.count() == kpi["completed_orders"]
    lines = spark.read.parquet(f"{out}/o/canonical")
    sold = lines.where("transaction_type = 'completed_sale'").agg(F.sum("line_revenue")).first()[0]
    assert float(sold) == kpi["completed_revenue_gbp"]
