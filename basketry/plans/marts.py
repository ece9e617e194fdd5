"""Dashboard tables at order, customer and month grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators.dedup import latest_text
from basketry.operators.ranking import exact_quantiles
from basketry.plans.rfm import segment_plan
from basketry.plans.star import UNKNOWN_PRODUCT
from basketry.schema import require_columns


def calendar(sales: DataFrame) -> DataFrame:
    """Every day from the first to the last sale."""
    ends = sales.agg(
        F.to_date(F.min("invoice_date")).alias("lo"), F.to_date(F.max("invoice_date")).alias("hi")
    )
    day = F.col("date")
    return (
        ends.select("hi", F.explode(F.sequence("lo", "hi")).alias("date"))
        .select(
            "date",
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month_number"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.date_format(day, "yyyy-MM").alias("year_month"),
            C.month_start(day).alias("month_start"),
            C.partial_month(F.date_format(day, "yyyy-MM"), F.col("hi")).alias("is_partial_period"),
        )
    )


def order_fact(orders: DataFrame) -> DataFrame:
    customer = C.id_or_null("customer_id")
    return orders.select(
        F.col("invoice_no").alias("order_id"),
        F.to_date("invoice_date").alias("order_date"),
        C.month_start("invoice_date").alias("month_start"),
        customer.alias("customer_id"),
        "country",
        F.col("order_value_gbp").alias("order_revenue_gbp"),
        F.col("units").alias("units_sold"),
        "distinct_products",
        F.col("product_lines").alias("line_count"),
        customer.isNotNull().alias("is_identified_customer"),
    )


def require_unique(df: DataFrame, column: str, what: str) -> None:
    twice = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{what}: {column} is not unique, a one-to-one join is not possible.")


def customer_dimension(rfm: DataFrame, clusters: DataFrame, check: bool = True) -> DataFrame:
    """RFM rows with their cluster, joined one to one."""
    left = rfm.withColumn("customer_id", C.id_or_null("customer_id"))
    right = clusters.select(
        C.id_or_null("customer_id").alias("customer_id"), "cluster_id", "cluster_label"
    )
    if check:
        require_unique(left, "customer_id", "RFM")
        require_unique(right, "customer_id", "Clusters")
    return left.join(right, "customer_id", "left").select(
        "customer_id",
        F.to_date("first_purchase").alias("first_purchase_date"),
        F.to_date("last_purchase").alias("last_purchase_date"),
        "recency_days",
        "frequency_orders",
        "monetary_value_gbp",
        "average_order_value_gbp",
        "units_purchased",
        "distinct_products",
        (F.col("frequency_orders") >= 2).alias("is_repeat_customer"),
        "r_score",
        "f_score",
        "m_score",
        "rfm_score",
        F.col("segment").alias("rfm_segment"),
        "cluster_id",
        "cluster_label",
    )


def product_month(sales: DataFrame) -> DataFrame:
    """Product x month with the last description by time.

    A missing description counts as 'Unknown product' before the last one is
    taken, so it can win. At one instant the greatest text wins.
    """
    lines = sales.where(F.col("stock_code").isNotNull()).select(
        C.month_start("invoice_date").alias("month_start"),
        "stock_code",
        F.coalesce("description", F.lit(UNKNOWN_PRODUCT)).alias("description"),
        "invoice_date",
        "invoice_no",
        "customer_id",
        "quantity",
        "line_revenue",
    )
    lines = lines.where(F.col("month_start").isNotNull())
    keys = ["month_start", "stock_code"]
    facts = lines.groupBy(*keys).agg(
        C.money(F.sum("line_revenue")).alias("revenue_gbp"),
        F.sum("quantity").alias("units_sold"),
        F.count_distinct("invoice_no").alias("orders"),
        F.count_distinct("customer_id").alias("identified_customers"),
    )
    # Text in the same aggregate would turn it into a sort of all lines.
    return facts.join(latest_text(lines, keys, "description", "invoice_date"), keys)


def country_month(sales: DataFrame) -> DataFrame:
    return (
        sales.where(F.col("country").isNotNull() & F.col("invoice_date").isNotNull())
        .groupBy(C.month_start("invoice_date").alias("month_start"), "country")
        .agg(
            C.money(F.sum("line_revenue")).alias("revenue_gbp"),
            F.count_distinct("invoice_no").alias("orders"),
            F.sum("quantity").alias("units_sold"),
            F.count_distinct("customer_id").alias("identified_customers"),
        )
    )


def returns_month(returns: DataFrame) -> DataFrame:
    return (
        returns.where(F.col("invoice_date").isNotNull())
        .groupBy(C.month_start("invoice_date").alias("month_start"))
        .agg(
            C.money(F.sum("line_revenue")).alias("signed_return_value_gbp"),
            C.money(F.abs(F.sum("line_revenue"))).alias("absolute_return_value_gbp"),
            F.count(F.lit(1)).alias("return_lines"),
            F.sum(F.abs("quantity")).alias("returned_units"),
        )
    )


def segment_mart(rfm: DataFrame) -> DataFrame:
    """All eight segments in original units with their plan."""
    value = F.col("monetary_value_gbp").cast("decimal(28,4)")
    stats = rfm.groupBy("segment").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(value).alias("_value"),
        F.count_if(F.col("frequency_orders") >= 2).alias("_repeat"),
    )
    medians = exact_quantiles(
        rfm,
        ["segment"],
        {
            "median_recency_days": ("recency_days", 0.5),
            "median_frequency_orders": ("frequency_orders", 0.5),
            "median_monetary_value_gbp": ("monetary_value_gbp", 0.5),
        }
    )
    totals = rfm.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v")).alias("s")
    ).scalar()
    n, v = F.coalesce("_n", F.lit(0)), F.coalesce("_value", F.lit(0))
    return (
        segment_plan(rfm.sparkSession)
        .join(stats, "segment", "left")
        .join(medians, "segment", "left")
        .orderBy("segment_order")
        .select(
            F.col("segment").alias("rfm_segment"),
            n.alias("customer_count"),
            C.ratio(n, totals["n"], 100).alias("customer_share_pct"),
            C.money(v).alias("historical_customer_value_gbp"),
            C.ratio(v, totals["v"], 100).alias("historical_value_share_pct"),
            "median_recency_days",
            "median_frequency_orders",
            "median_monetary_value_gbp",
            C.ratio("_repeat", "_n", 100).alias("repeat_customer_rate_pct"),
            "priority",
            "segment_rule",
            "recommended_action",
        )
    )


def cluster_mart(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "cluster_id",
        "cluster_label",
        "customer_count",
        "customer_share_pct",
        F.col("total_monetary_value_gbp").alias("historical_customer_value_gbp"),
        F.col("revenue_share_pct").alias("historical_value_share_pct"),
        "median_recency_days",
        "median_frequency_orders",
        "median_monetary_value_gbp",
        "repeat_customer_rate_pct",
        "dominant_rfm_segment",
        "dominant_rfm_segment_share_pct",
        "label_basis",
        "recommended_action",
    )


def kpi_snapshot(summary: DataFrame) -> DataFrame:
    """One row of confirmed metrics; the data-through day comes from the data."""
    return summary.select(
        "data_through_date",
        F.col("completed_sales_value_gbp").alias("completed_revenue_gbp"),
        F.col("orders").alias("completed_orders"),
        F.col("units_sold").alias("completed_units"),
        "average_order_value_gbp",
        "median_order_value_gbp",
        "identified_customers",
        "repeat_customers",
        "repeat_customer_rate_pct",
        F.col("identified_revenue_gbp").alias("identified_customer_revenue_gbp"),
        "anonymous_revenue_gbp",
        "anonymous_revenue_share_pct",
        "signed_returns_value_gbp",
        "partial_period",
        F.when(
            F.col("partial_period").isNotNull(),
            F.concat(
                "partial_period",
                F.lit(" holds data only through "),
                F.col("data_through_date").cast("string"),
                F.lit(" and is not a complete month."),
            ),
        ).alias("partial_period_note"),
    )


# Columns each mart input must have.
INPUT_COLUMNS = {
    "sales": ["invoice_date", "stock_code", "description", "invoice_no", "customer_id", "country",
              "quantity", "line_revenue"],
    "returns": ["invoice_date", "quantity", "line_revenue"],
    "orders": ["invoice_no", "invoice_date", "customer_id", "country", "order_value_gbp", "units",
               "product_lines", "distinct_products"],
    "rfm": ["customer_id", "first_purchase", "last_purchase", "recency_days", "frequency_orders",
            "monetary_value_gbp", "average_order_value_gbp", "units_purchased",
            "distinct_products", "r_score", "f_score", "m_score", "rfm_score", "segment"],
    "clusters": ["customer_id", "cluster_id", "cluster_label"],
}


def build_marts(
    sales: DataFrame,
    returns: DataFrame,
    orders: DataFrame,
    rfm: DataFrame,
    clusters: DataFrame,
    cohorts: DataFrame,
    cluster_profiles: DataFrame,
    summary: DataFrame,
) -> dict[str, DataFrame]:
    """The ten export tables, all lazy."""
    given = {"sales": sales, "returns": returns, "orders": orders, "rfm": rfm, "clusters": clusters}
    for name, df in given.items():
        require_columns(df, INPUT_COLUMNS[name], f"Mart input {name}")
    return {
        "dim_date": calendar(sales),
        "fact_orders": order_fact(orders),
        "dim_customer": customer_dimension(rfm, clusters),
        "fact_product_month": product_month(sales),
        "fact_country_month": country_month(sales),
        "fact_returns_month": returns_month(returns),
        "cohort_retention": cohorts,
        "segment_summary": segment_mart(rfm),
        "cluster_summary": cluster_mart(cluster_profiles),
        "kpi_snapshot": kpi_snapshot(summary),
    }
