"""Recency, frequency and monetary value: features, scores, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators.ranking import exact_quantiles, metric_ranks, score_bin
from basketry.plans.eda import buyer_features
from basketry.schema import require_columns
from basketry.session import pin

# Segments in report order with rule, action and priority.
SEGMENTS = [
    (
        "Champions",
        "R >= 4, F >= 4, M >= 4, and at least 2 completed orders.",
        "Protect with early access, premium service, and referral invitations.",
        "Protect",
    ),
    (
        "Loyal Customers",
        "R >= 3, F >= 4, M >= 3, and at least 2 completed orders.",
        "Use loyalty rewards, replenishment reminders, and cross-sell offers.",
        "Grow",
    ),
    (
        "Potential Loyalists",
        "R >= 4, F between 2 and 3, M >= 2, and at least 2 completed orders.",
        "Nurture with second-next-purchase offers and category recommendations.",
        "Nurture",
    ),
    (
        "New Customers",
        "R >= 4 and exactly 1 completed order.",
        "Send onboarding, product education, and a timely second-order incentive.",
        "Onboard",
    ),
    (
        "Cannot Lose Them",
        "R <= 2, F >= 4, M >= 4, and at least 2 completed orders.",
        "Prioritise personal reactivation and service recovery before discounting.",
        "Recover",
    ),
    (
        "At Risk",
        "R <= 2 and either F >= 3 or M >= 3.",
        "Trigger win-back journeys based on past categories and purchase timing.",
        "Win back",
    ),
    (
        "Hibernating",
        "R <= 2, F <= 2, and M <= 2.",
        "Use low-cost reactivation tests and suppress if engagement stays absent.",
        "Test",
    ),
    (
        "Need Attention",
        "All remaining customers after the ordered rules above.",
        "Monitor behaviour and use light-touch merchandising or survey prompts.",
        "Monitor",
    ),
]
SEGMENT_NAMES = [s[0] for s in SEGMENTS]

# The conditions of the rules above, in the order they are tried.
CONDITIONS = {
    "Champions": "r_score >= 4 AND f_score >= 4 AND m_score >= 4 AND frequency_orders >= 2",
    "Loyal Customers": "r_score >= 3 AND f_score >= 4 AND m_score >= 3 AND frequency_orders >= 2",
    "Potential Loyalists": (
        "r_score >= 4 AND f_score BETWEEN 2 AND 3 AND m_score >= 2 AND frequency_orders >= 2"
    ),
    "New Customers": "r_score >= 4 AND frequency_orders = 1",
    "Cannot Lose Them": "r_score <= 2 AND f_score >= 4 AND m_score >= 4 AND frequency_orders >= 2",
    "At Risk": "r_score <= 2 AND (f_score >= 3 OR m_score >= 3)",
    "Hibernating": "r_score <= 2 AND f_score <= 2 AND m_score <= 2",
}
OTHERWISE = "Need Attention"

NEEDED = [
    "customer_id",
    "invoice_date",
    "invoice_no",
    "country",
    "stock_code",
    "quantity",
    "line_revenue",
]

MEASURES = [
    "recency_days",
    "frequency_orders",
    "monetary_value_gbp",
    "average_order_value_gbp",
    "active_span_days",
    "units_purchased",
    "distinct_products",
]


def identified_sales(lines: DataFrame) -> DataFrame:
    """Completed sales with a customer; each extra flag counts where it exists."""
    require_columns(lines, NEEDED, "Customer sales")
    keep = F.col("customer_id").isNotNull()
    for flag in ("has_customer_id", "is_completed_sale"):
        if flag in lines.columns:
            keep &= F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    if "transaction_type" in lines.columns:
        keep &= F.coalesce(F.col("transaction_type") == C.SALE, F.lit(False))
    return lines.where(keep)


def require_identified_sales(lines: DataFrame) -> DataFrame:
    sales = identified_sales(lines)
    if sales.isEmpty():
        raise ValueError("No identified completed sales were found.")
    return sales


def snapshot_day(sales: DataFrame):
    """The day after the last sale, as a scalar subquery."""
    return sales.agg(F.date_add(F.to_date(F.max("invoice_date")), 1).alias("d")).scalar()


def rfm_features(identified: DataFrame, snapshot=None) -> DataFrame:
    snapshot = snapshot_day(identified) if snapshot is None else snapshot
    base = buyer_features(identified)
    return base.select(
        "customer_id",
        "primary_country",
        "first_purchase",
        "last_purchase",
        F.datediff(snapshot, F.to_date("last_purchase")).alias("recency_days"),
        F.col("orders").alias("frequency_orders"),
        C.money("revenue").alias("monetary_value_gbp"),
        C.ratio("revenue", "orders").alias("average_order_value_gbp"),
        F.datediff("last_purchase", "first_purchase").alias("active_span_days"),
        F.col("units").alias("units_purchased"),
        "distinct_products",
    )


def score(features: DataFrame) -> DataFrame:
    """Quintile scores 1..5, 5 best; ties go by customer id."""
    ranks = metric_ranks(
        features,
        "customer_id",
        {
            "_r": ("recency_days", False),
            "_f": ("frequency_orders", True),
            "_m": ("monetary_value_gbp", True),
        },
    )
    scored = features.join(ranks, "customer_id").withColumns(
        {f"{m}_score": score_bin(F.col(f"_{m}"), F.col("n")) for m in "rfm"}
    )
    return scored.withColumns(
        {
            "rfm_score": F.col("r_score") + F.col("f_score") + F.col("m_score"),
            "rfm_code": F.concat(*[F.col(f"{m}_score").cast("string") for m in "rfm"]),
        }
    ).drop("_r", "_f", "_m", "n")


def assign_segments(scored: DataFrame) -> DataFrame:
    """First matching rule wins, so every customer has exactly one segment."""
    segment = None
    for name, rule in CONDITIONS.items():
        hit = F.expr(rule)
        segment = F.when(hit, name) if segment is None else segment.when(hit, name)
    return scored.withColumn("segment", segment.otherwise(OTHERWISE))


def rfm_table(identified: DataFrame) -> DataFrame:
    # Scores need the features twice (ranks and join back), so compute them once.
    return assign_segments(score(pin(rfm_features(identified))))


def segment_plan(spark: SparkSession) -> DataFrame:
    """Eight fixed rows: order, rule, action and priority."""
    rows = [(n, i + 1, rule, action, priority) for i, (n, rule, action, priority) in enumerate(SEGMENTS)]
    return spark.createDataFrame(
        rows,
        "segment string, segment_order int, segment_rule string, recommended_action string, priority string",
    )


def segment_action_plan(rfm: DataFrame) -> DataFrame:
    """The plan with the customers each action reaches."""
    sizes = rfm.groupBy("segment").agg(F.count(F.lit(1)).alias("customer_count"))
    return (
        segment_plan(rfm.sparkSession)
        .join(sizes, "segment", "left")
        .select(
            "segment",
            "segment_order",
            "priority",
            "segment_rule",
            "recommended_action",
            F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
        )
    )


def segment_summary(rfm: DataFrame) -> DataFrame:
    """All eight segments, also the empty ones."""
    stats = rfm.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum(F.col("monetary_value_gbp").cast("decimal(28,4)")).alias("_value"),
        F.sum("average_order_value_gbp").alias("_aov"),
        F.sum("frequency_orders").alias("_orders"),
        F.sum("units_purchased").alias("units_purchased"),
        F.sum("distinct_products").alias("_products"),
    )
    medians = exact_quantiles(
        rfm, ["segment"], {"median_recency_days": ("recency_days", 0.5)}
    )
    totals = (
        rfm.agg(
            F.struct(
                F.count(F.lit(1)).alias("customers"),
                F.sum(F.col("monetary_value_gbp").cast("decimal(28,4)")).alias("value"),
            ).alias("s")
        )
    ).scalar()
    n = F.col("customer_count")
    return (
        segment_plan(rfm.sparkSession)
        .join(stats, "segment", "left")
        .join(medians, "segment", "left")
        .withColumn("customer_count", F.coalesce("customer_count", F.lit(0)))
        .select(
            "segment",
            "customer_count",
            C.ratio(n, totals["customers"], 100).alias("customer_share_pct"),
            C.money(F.coalesce("_value", F.lit(0))).alias("monetary_value_gbp"),
            C.ratio(F.coalesce("_value", F.lit(0)), totals["value"], 100).alias("revenue_share_pct"),
            C.ratio("_value", n).alias("average_monetary_value_gbp"),
            C.ratio("_aov", n).alias("average_order_value_gbp"),
            "median_recency_days",
            C.ratio("_orders", n).alias("average_frequency_orders"),
            F.coalesce("units_purchased", F.lit(0)).alias("units_purchased"),
            C.ratio("_products", n).alias("average_distinct_products"),
            "segment_rule",
            "recommended_action",
            "segment_order",
        )
        .orderBy("segment_order")
    )


def customer_summary_stats(identified: DataFrame, rfm: DataFrame) -> DataFrame:
    """One row over all identified customers."""
    value = F.col("monetary_value_gbp").cast("decimal(28,4)")
    lines = identified.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rfm.agg(
        F.count(F.lit(1)).alias("customers"),
        F.to_date(F.min("first_purchase")).alias("first_purchase"),
        F.to_date(F.max("last_purchase")).alias("last_purchase"),
        F.sum(value).alias("_value"),
        F.sum("recency_days").alias("_recency"),
        F.sum("frequency_orders").alias("_orders"),
        *[
            F.count_if(F.col("segment") == s).alias("segment_" + s.lower().replace(" ", "_"))
            for s in SEGMENT_NAMES
        ],
    ).select(
        lines.alias("identified_completed_sales_rows"),
        F.date_add("last_purchase", 1).alias("snapshot_date"),
        "customers",
        "first_purchase",
        "last_purchase",
        C.money(F.round("_value", 2)).alias("total_monetary_value_gbp"),
        C.rounded_ratio("_recency", "customers").alias("average_recency_days"),
        C.rounded_ratio("_orders", "customers").alias("average_frequency_orders"),
        C.rounded_ratio("_value", "customers").alias("average_customer_value_gbp"),
        *["segment_" + s.lower().replace(" ", "_") for s in SEGMENT_NAMES],
    )
