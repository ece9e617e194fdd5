"""The whole run, stage by stage, from raw batches to dashboard exports.

Each stage reads what the one before wrote, and stops the run when one of its
gates fails. From the command line:

    python -m basketry.run OUT NAME=PATH NAME=PATH ... [--format csv] [--home COUNTRY]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.plans import clean, cluster, cohort, eda, gates, marts, rfm, star, stats
from basketry.session import build_session, pin, release
from basketry.sources import named_sql, scan, sinks, versions


def _need(gate_rows: DataFrame, stage: str) -> None:
    failed = gate_rows.where("NOT passed").collect()
    if failed:
        raise RuntimeError(f"{stage}: gates failed: {failed}")


def clean_stage(
    spark: SparkSession, batches: dict[str, str], out: str, fmt: str = "csv",
    date_formats: dict[str, list[str]] | None = None, **options,
) -> DataFrame:
    """Raw batches to the canonical table, partitioned by line class.

    Raw text is parsed once: everything here reads the typed lines that the scan
    has written.
    """
    raw = scan.scan_batches(spark, batches, fmt, date_formats, **options)
    failures = clean.contract_failures(clean.classify(raw)).collect()
    if failures:
        raise RuntimeError(f"Raw table breaks its contract: {[r[0] for r in failures]}")
    names = list(batches)
    sinks.write_json_summary(clean.raw_profile(raw, names), f"{out}/reports/raw_profile")
    sinks.write_json_summary(clean.missing_values(raw), f"{out}/reports/missing_values")
    sinks.write_parquet(
        clean.canonical_table(raw, names), f"{out}/canonical", partition_by="transaction_type"
    )
    lines = spark.read.parquet(f"{out}/canonical")
    summary = clean.cleaning_summary(raw, lines)
    sinks.write_json_summary(summary, f"{out}/reports/cleaning_summary")
    if not scan.read_json_summary(spark, f"{out}/reports/cleaning_summary").first()["matches_unique_rows"]:
        raise RuntimeError("Line classes do not add up to the unique lines.")
    return lines


def star_stage(spark: SparkSession, lines: DataFrame, out: str) -> dict[str, DataFrame]:
    """Star tables as one version, published only after their keys resolve and their rules hold."""
    version = versions.begin(spark, f"{out}/star")
    try:
        found = star.publish_observed(lines, f"{version.root}/{version.folder}")
    except Exception:
        versions.discard(spark, version)
        raise
    version = versions.publish(spark, version, {n: {"rows": r} for n, r in found.rows.items()})
    sinks.write_json_summary(found.row_counts(), f"{out}/reports/star_row_counts")
    failures = spark.createDataFrame([(*k, n) for k, n in found.failures.items()], "table_name string, rule string, failures long")
    sinks.write_json_summary(failures, f"{out}/reports/star_rules")
    return {n: version.read(spark, n) for n in found.rows}


def sql_stage(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """Named statements to CSV with a manifest."""
    star.register(tables)
    star.register({"ranked_customers": star.ranked_customers(tables["fact_sales"])})
    results = named_sql.run_named(spark, named_sql.FILES)
    written = {}
    for name, df in results.items():
        sinks.write_csv(df, f"{out}/sql_results/{name}")
        written[name] = scan.read_csv(spark, f"{out}/sql_results/{name}", df.schema)
    if not written["foreign_key_resolution"].where("failure_count > 0").isEmpty():
        raise RuntimeError("Foreign keys do not resolve.")
    listing = named_sql.manifest(spark, written, f"{out}/sql_results")
    sinks.write_json_summary(listing, f"{out}/reports/sql_manifest")
    return written


def eda_stage(lines: DataFrame, out: str) -> dict[str, DataFrame]:
    parts = sinks.datasets(lines)
    tables = eda.build_eda(parts["completed_sales"], parts["returns"])
    # One row, used by the report and by the marts.
    tables["eda_summary"] = pin(tables["eda_summary"])
    for name, df in tables.items():
        if name != "eda_summary":
            sinks.write_csv(df, f"{out}/eda/{name}")
    sinks.write_json_summary(tables["eda_summary"], f"{out}/reports/eda_summary")
    return tables


def customer_stage(
    spark: SparkSession,
    lines: DataFrame,
    out: str,
    expected_customers: int | None = None,
    expected_value: float | None = None,
) -> dict[str, DataFrame]:
    """RFM segments and cohorts."""
    sales = rfm.require_identified_sales(lines)
    sinks.write_parquet(rfm.rfm_table(sales), f"{out}/customer_rfm")
    table = spark.read.parquet(f"{out}/customer_rfm")
    cohorts = pin(cohort.cohort_long(sales))
    segments = pin(rfm.segment_summary(table))
    checks = gates.customer_gates(table, segments, cohorts, expected_customers, expected_value)
    _need(checks, "customer analytics")
    reports = {
        "segment_summary": segments,
        "segment_action_plan": rfm.segment_action_plan(table),
        "cohort_counts": cohort.widen(cohorts, "active_customers"),
        "cohort_retention": cohort.widen(cohorts, "retention_pct"),
        "retention_curve": cohort.retention_curve(cohorts),
    }
    for name, df in reports.items():
        sinks.write_csv(df, f"{out}/customer_analytics/{name}")
    sinks.write_json_summary(rfm.customer_summary_stats(sales, table), f"{out}/reports/customer_summary")
    sinks.write_json_summary(cohort.cohort_metadata(cohorts), f"{out}/reports/cohort_metadata")
    sinks.write_json_summary(checks, f"{out}/reports/customer_gates")
    return {"rfm": table, "cohorts": cohorts, **reports}


def statistics_stage(table: DataFrame, orders: DataFrame, out: str, home: str) -> DataFrame:
    """Correlations and group tests."""
    stats.check_inputs(table, orders)
    checks = gates.stat_gates(table, orders)
    _need(checks, "statistics")
    tests = pin(stats.hypothesis_tests(table, orders, home))
    pairs = pin(stats.spearman_pairs(table, "customer_id", rfm.MEASURES))
    sinks.write_csv(tests, f"{out}/statistics/hypothesis_tests")
    sinks.write_csv(stats.correlation_matrix(pairs, rfm.MEASURES), f"{out}/statistics/correlation_matrix")
    sinks.write_json_summary(stats.statistical_summary(tests), f"{out}/reports/statistical_summary")
    return tests


def cluster_stage(spark: SparkSession, table: DataFrame, out: str, home: str, **options):
    """K-Means segmentation."""
    built = cluster.build_clusters(table, home, **options)
    _need(
        gates.cluster_gates(
            built["customer_clusters"], built["k_evaluation"], built["cluster_profiles"],
            options.get("k", cluster.OPERATIONAL_K),
        ),
        "clustering",
    )
    sinks.write_parquet(built["customer_clusters"], f"{out}/customer_clusters")
    sinks.write_json_summary(
        cluster.clustering_summary(built["k_evaluation"], built["cluster_profiles"]),
        f"{out}/reports/clustering_summary",
    )
    for name in ("k_evaluation", "cluster_profiles", "rfm_cluster_comparison"):
        sinks.write_csv(built[name], f"{out}/clustering/{name}")
    return {**built, "customer_clusters": spark.read.parquet(f"{out}/customer_clusters")}


def mart_stage(
    spark: SparkSession, lines: DataFrame, tables: dict, customers: dict, clusters: dict, out: str,
    expected=None, file_limit: int | None = None,
) -> dict[str, DataFrame]:
    """Dashboard exports: one version, its totals taken while it is written, checked, then published.

    ``file_limit``: largest file in bytes that the receiver of the exports takes.
    """
    parts = sinks.datasets(lines)
    built = marts.build_marts(
        parts["completed_sales"], parts["returns"], tables["order_summary"], customers["rfm"],
        clusters["customer_clusters"], customers["cohorts"], clusters["cluster_profiles"],
        tables["eda_summary"],
    )
    version, totals, observed = versions.begin(spark, f"{out}/dashboard"), gates.mart_totals(), {}
    try:
        for name, df in built.items():
            metrics = {"_rows": F.count(F.lit(1)), **totals.get(name, {})}
            observed[name] = star.write_observed(df, metrics, lambda d: sinks.write_csv(d, version.path(name)))
        written = {n: scan.read_csv(spark, version.path(n), built[n].schema) for n in built}
        checks = pin(gates.mart_gates(written, expected, {n: v for n, v in observed.items() if n in totals}))
        sizes = sinks.size_report(spark, {n: version.path(n) for n in built}, file_limit)
        sinks.write_json_summary(checks, f"{out}/reports/mart_gates")
        sinks.write_json_summary(sizes, f"{out}/reports/export_sizes")
        _need(checks, "dashboard marts")
        _need(sizes, "export sizes")
    except Exception:
        versions.discard(spark, version)
        raise
    versions.publish(spark, version, {n: {"rows": v["_rows"]} for n, v in observed.items()})
    return written


def run(
    spark: SparkSession, batches: dict[str, str], out: str, fmt: str = "csv",
    home: str = "United Kingdom", date_formats: dict[str, list[str]] | None = None,
    file_limit: int | None = None, **cluster_options,
) -> dict[str, DataFrame]:
    lines = clean_stage(spark, batches, out, fmt, date_formats)
    sql_stage(spark, star_stage(spark, lines, out), out)
    tables = eda_stage(lines, out)
    customers = customer_stage(spark, lines, out)
    statistics_stage(customers["rfm"], tables["order_summary"], out, home)
    clusters = cluster_stage(spark, customers["rfm"], out, home, **cluster_options)
    built = mart_stage(spark, lines, tables, customers, clusters, out, file_limit=file_limit)
    release(spark)
    return built


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("out")
    parser.add_argument("batches", nargs="+", metavar="NAME=PATH")
    parser.add_argument("--format", default="csv")
    parser.add_argument("--home", default="United Kingdom")
    args = parser.parse_args()
    batches = dict(b.split("=", 1) for b in args.batches)
    run(build_session(), batches, args.out, args.format, args.home)


if __name__ == "__main__":
    main()
