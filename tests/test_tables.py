import pytest
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.plans import clean, eda, gates, marts, measures, star
from basketry.sources import scan, sinks


def test_star_of_the_raw_fixture(raw, tmp_path):
    lines = clean.canonical_table(scan.union_batches({"s1": raw}), ["s1"])
    tables = star.publish(lines, str(tmp_path / "star"))
    counts = {r["table_name"]: r["row_count"] for r in star.row_counts(tables).collect()}
    assert counts == {"dim_date": 4, "dim_product": 3, "dim_customer": 1, "dim_country": 1, "fact_sales": 2, "fact_returns": 1, "audit_exclusions": 1}
    assert star.constraint_report(tables).where("failures > 0").count() == 0
    names = {r["stock_code"]: r["product_description"] for r in tables["dim_product"].collect()}
    assert names == {"A1": "Blue Mug", "B2": "Red Mug", "C3": "Unknown product"}


def test_missing_keys_fall_back(spark, raw):
    lines = clean.canonical_table(scan.union_batches({"s1": raw}), ["s1"])
    dims = star.dimensions(lines)
    holed = lines.withColumn("stock_code", F.lit(None).cast("string")).withColumn("country", F.lit(None).cast("string"))
    row = star.with_keys(holed, dims).where("customer_id IS NULL").first()
    assert (row["product_key"], row["country_key"], row["customer_key"]) == (0, 0, None)
    assert star.with_keys(holed, dims).count() == 4


def test_orphans_stop_publishing(spark, raw, tmp_path):
    holed = raw.withColumn("StockCode", F.when(F.col("Invoice") != "100001", F.col("StockCode")))
    lines = clean.canonical_table(scan.union_batches({"s1": holed}), ["s1"])
    with pytest.raises(RuntimeError, match="orphan_sales_products"):
        star.publish(lines, str(tmp_path / "star"))


def test_eda_of_the_raw_fixture(raw):
    lines = clean.canonical_table(scan.union_batches({"s1": raw}), ["s1"])
    parts = sinks.datasets(lines)
    tables = eda.build_eda(parts["completed_sales"], parts["returns"])
    summary = tables["eda_summary"].first()
    assert summary["orders"] == 2 and summary["completed_sales_value_gbp"] == 25.0
    assert summary["repeat_customer_rate_pct"] == 100.0 and summary["average_order_value_gbp"] == 12.5
    assert tables["customer_revenue_deciles"].first()["value_decile"] == 1
    assert tables["monthly_performance"].first()["is_partial_period"]


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    bins = {r["bin"]: r["count"] for r in eda.histogram(df, "v", 10).collect()}
    assert bins == {**{i: 10 for i in range(9)}, 9: 11}
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r["count"] for r in eda.histogram(same, "v", 10).collect()] == [2]
    capped = eda.histogram(df, "v", 10, cap=0.5)
    assert capped.agg(F.sum("count")).first()[0] == 51
    assert eda.histogram(df, "v", 10, cap=0.5, clip=True).agg(F.sum("count")).first()[0] == 101
    assert eda.histogram(df, "v", 4, log=True).agg(F.sum("count")).first()[0] == 101


def test_shares_add_up(tables):
    assert eda.country_share(tables.sales()).agg(F.sum("revenue_share_pct")).first()[0] == pytest.approx(100)
    assert eda.product_performance(tables.sales()).agg(F.sum("revenue_share_pct")).first()[0] == pytest.approx(100)
    curve = tables.cohorts().where("cohort_month_index = 0 AND retention_pct <> 100")
    assert curve.count() == 0


def test_mart_gates_notice_a_wrong_total(tables):
    built = tables.marts()
    assert gates.all_passed(gates.mart_gates(built))
    failed = gates.mart_gates(built, {"completed_orders": 1}).where("NOT passed").collect()
    assert [r["gate"] for r in failed] == ["completed_orders"]


def test_one_to_one_join_is_checked(tables):
    clusters = tables.labelled_clusters()
    with pytest.raises(ValueError, match="not unique"):
        marts.customer_dimension(tables.rfm(), clusters.unionByName(clusters.limit(1)))


def test_marts_need_their_columns(tables):
    nothing = tables.orders().limit(0)
    with pytest.raises(ValueError, match="country"):
        marts.build_marts(tables.sales().drop("country"), *[nothing] * 7)


def test_measures_follow_filters(tables):
    orders = marts.order_fact(tables.orders())
    customers = marts.customer_dimension(tables.rfm(), tables.labelled_clusters())
    whole = measures.sales_measures(orders, []).first()
    by_country = measures.sales_measures(orders, ["country"])
    assert by_country.agg(F.sum("total_orders")).first()[0] == whole["total_orders"]
    blank = measures.measures_by_customer_slice(orders, customers, ["rfm_segment"]).where("rfm_segment IS NULL").first()
    assert blank["anonymous_revenue_share"] == 1.0 and blank["identified_customers"] == 0
    only = measures.measures_by_customer_slice(orders, customers, ["rfm_segment"], {"rfm_segment": ["Champions"]}).collect()
    assert [r["rfm_segment"] for r in only] == ["Champions"]
    one = customers.first()["customer_id"]
    detail = measures.customer_detail(orders, customers, {"customer_id": [one]})
    assert detail.count() == customers.where(F.col("customer_id") == one).first()["frequency_orders"]


def test_monthly_trend_of_one_country(tables):
    mart = marts.country_month(tables.sales())
    trend = measures.monthly_trend(mart, "country", {"country": ["NATION_0"]}).collect()
    months = [r["month_start"] for r in trend]
    assert months == sorted(months) and {r["country"] for r in trend} == {"NATION_0"}


def test_month_without_predecessor_has_no_growth(spark):
    orders = spark.createDataFrame([("2020-01-01", 10.0), ("2020-03-01", 20.0), ("2020-04-01", 30.0)], "m string, order_revenue_gbp double")
    orders = orders.select(F.to_date("m").alias("month_start"), "order_revenue_gbp")
    back = spark.createDataFrame([], "month_start date, absolute_return_value_gbp double")
    got = {str(r["month_start"]): r["month_over_month_growth"] for r in measures.time_measures(orders, back).collect()}
    assert got == {"2020-01-01": None, "2020-03-01": None, "2020-04-01": 0.5}


def test_slices_answer_any_filter(spark):
    """Distinct customers from bitmaps against distinct counts, under filters and totals, over several buckets."""
    people = 70_000
    number = F.col("id")
    customers = spark.range(people).select(
        F.format_string("k%06d", number).alias("customer_id"), (number % 3 == 0).alias("is_repeat_customer"),
        F.when(number % 5 == 0, "Champions").when(number % 5 == 1, "At Risk").otherwise("Hibernating").alias("rfm_segment"),
    )
    buyer = F.when(number % 11 == 0, None).when(number % 4 == 0, 7).otherwise(number % people)
    orders = spark.range(150_000).select(
        number.alias("order_id"), F.format_string("k%06d", buyer.cast("long")).alias("customer_id"), buyer.isNotNull().alias("is_identified_customer"),
        (2000 + number % 3).cast("int").alias("year"), F.concat(F.lit("N"), (number % 7).cast("string")).alias("country"),
        (number % 100 / 4).cast("decimal(18,4)").alias("order_revenue_gbp"), (number % 9).alias("units_sold"),
    ).withColumn("customer_id", F.when(F.col("is_identified_customer"), F.col("customer_id")))
    slices = measures.slice_table(orders, customers, ["year", "country"], ["rfm_segment"]).cache()
    assert slices.select("_bucket").distinct().count() == 3  # two buckets, and orders without a customer
    wide = orders.join(customers, "customer_id", "left")
    for dims, filters in ((["year"], {"country": ["N1", "N4"]}), (["country", "rfm_segment"], {"year": [2001]}), (["rfm_segment"], {"rfm_segment": ["At Risk"]}), ([], None)):
        got = {tuple(r[d] for d in dims): r for r in measures.measures_from_slices(slices, dims, filters).collect()}
        want = measures.slice_by(wide, filters).groupBy(*dims).agg(
            F.count_distinct("customer_id").alias("c"), F.count_distinct(F.when(F.col("is_repeat_customer"), F.col("customer_id"))).alias("r"),
            F.count_distinct("order_id").alias("o"), F.sum("order_revenue_gbp").cast("double").alias("v"),
        ).collect()
        assert len(got) == len(want)
        for w in want:
            g = got[tuple(w[d] for d in dims)]
            assert (g["identified_customers"], g["repeat_customers"], g["total_orders"]) == (w["c"], w["r"], w["o"])
            assert g["total_revenue"] == pytest.approx(w["v"])
    cube = measures.measures_from_slices(slices, ["year", "rfm_segment"], totals=True).collect()
    assert {r["grouped_by"] for r in cube} == {"year,rfm_segment", "year", "rfm_segment", ""}
    total = next(r for r in cube if r["grouped_by"] == "")
    assert total["identified_customers"] == orders.select("customer_id").distinct().count() - 1


def test_wide_tables_are_written_without_a_sort(spark):
    from basketry.session import Stage

    key, seen = "spark.sql.maxConcurrentOutputFileWriters", []

    def build():
        seen.append(spark.conf.get(key, None))
        return spark.range(0, 30_000, 1, 1).selectExpr("id", "concat('t', id % 3) AS kind")

    back = Stage(spark).table(("wide",), build, "kind")
    # Three folders side by side: rows keep their order, and nothing is left set.
    assert seen == ["8"] and spark.conf.get(key, None) is None
    plan = spark._jsparkSession.sharedState().statusStore()
    last = plan.executionsList().last().executionId()
    nodes = plan.planGraph(last).allNodes()
    assert "Sort" not in [nodes.apply(i).name() for i in range(nodes.size())]
    assert {r[0]: r[1] for r in back.groupBy("kind").count().collect()} == {f"t{i}": 10_000 for i in range(3)}


def test_a_named_statement_builds_only_its_tables(spark, folder):
    from basketry.session import stage_of
    from checks.queries import Tables

    place = f"{folder}/."
    assert Tables(spark, place).named({"executive_kpis"})["executive_kpis"].count() == 1
    built = {name for where, name in stage_of(spark)._paths if where == place}
    assert "fact_sales" in built and not built & {"fact_returns", "audit_exclusions", "dim_date"}


def test_date_parts_are_not_formatted_and_equal_the_formatted_text(spark):
    days = ["0999-12-31", "1000-01-01", "1969-12-31", "1992-02-29", "1998-10-01", "9999-12-31", "+12345-02-03", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp_ntz").alias("v"))
    parts = C.date_parts("v")
    wrong = [~parts[p].eqNullSafe(F.date_format("v", form)) for p, form in (("year_month", "yyyy-MM"), ("day_of_week", "EEEE"))]
    assert df.where(wrong[0] | wrong[1]).isEmpty()
    plan = df.select(parts["day_of_week"])._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" not in plan
