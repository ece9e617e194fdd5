"""Descriptive tables over completed sales and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators.dedup import latest_text, most_common
from basketry.operators.ranking import decile_bin, exact_quantiles, global_row_number
from basketry.plans.star import UNKNOWN, UNKNOWN_PRODUCT
from basketry.session import pin

REVENUE = "line_revenue"


def first_known(value: str, by: str = "transaction_line_id"):
    """First non-null value in load order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(by)))


def order_summary(sales: DataFrame) -> DataFrame:
    """One row per invoice.

    All lines meet in one hash aggregate by invoice and its attributes; the
    picks and counts then see one row per product, buyer and country of an
    invoice. These rows are dealt out by invoice once, which serves the picks,
    the distinct products and the sums alike.
    """
    grain = (
        sales.where(F.col("invoice_no").isNotNull())
        .groupBy("invoice_no", "customer_id", "country", "stock_code")
        .agg(
            F.min("invoice_date").alias("_date"),
            F.min("transaction_line_id").alias("_line"),
            F.sum(REVENUE).alias("_value"),
            F.sum("quantity").alias("_units"),
            F.count(F.lit(1)).alias("_lines"),
        )
    )
    return (
        grain.repartition("invoice_no")
        .groupBy("invoice_no")
        .agg(
            F.min("_date").alias("invoice_date"),
            first_known("customer_id", "_line").alias("customer_id"),
            first_known("country", "_line").alias("country"),
            F.sum("_value").alias("order_value"),
            F.sum("_units").alias("units"),
            F.sum("_lines").alias("product_lines"),
            F.count_distinct("stock_code").alias("distinct_products"),
        )
        .withColumn("order_value_gbp", C.money("order_value"))
    )


def distinct_per(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """Distinct non-null values of ``column`` per ``key``, by two light aggregates."""
    pairs = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.lit(1).alias("_one"))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def buyer_features(identified: DataFrame) -> DataFrame:
    """Per identified customer: usual country, dates, orders, value, breadth.

    Lines meet once, by customer, invoice and country; the products are counted
    apart, so no line is expanded.
    """
    usual = most_common(identified, "customer_id", "country", "primary_country", UNKNOWN)
    per_order = identified.groupBy("customer_id", "invoice_no").agg(
        F.min("invoice_date").alias("_first"),
        F.max("invoice_date").alias("_last"),
        F.sum(REVENUE).alias("_revenue"),
        F.sum("quantity").alias("_units"),
    )
    totals = per_order.groupBy("customer_id").agg(
        F.min("_first").alias("first_purchase"),
        F.max("_last").alias("last_purchase"),
        F.count("invoice_no").alias("orders"),
        F.sum("_revenue").alias("revenue"),
        F.sum("_units").alias("units"),
    )
    products = distinct_per(identified, "customer_id", "stock_code", "distinct_products")
    return (
        totals.join(products, "customer_id", "left")
        .withColumn("distinct_products", F.coalesce("distinct_products", F.lit(0)).cast("long"))
        .join(usual, "customer_id")
    )


def customer_summary(sales: DataFrame) -> DataFrame:
    return (
        buyer_features(sales.where(F.col("customer_id").isNotNull()))
        .withColumns(
            {
                "customer_revenue_gbp": C.money("revenue"),
                "average_order_value_gbp": C.ratio("revenue", "orders"),
                "active_span_days": F.datediff("last_purchase", "first_purchase"),
                "is_repeat_customer": F.col("orders") > 1,
            }
        )
    )


def last_sale_day(sales: DataFrame):
    """Last calendar day with sales, as a scalar subquery."""
    return sales.agg(F.to_date(F.max("invoice_date")).alias("d")).scalar()


def monthly_performance(sales: DataFrame, orders: DataFrame) -> DataFrame:
    """Line totals by month, joined by order totals of the month an order began."""
    lines = (
        sales.where(F.col("year_month").isNotNull())
        .groupBy("year_month")
        .agg(
            F.sum(REVENUE).alias("revenue"),
            F.sum("quantity").alias("units"),
            F.count(F.lit(1)).alias("sales_lines"),
            F.count_distinct("customer_id").alias("identified_customers"),
        )
    )
    begun = orders.select(
        F.date_format("invoice_date", "yyyy-MM").alias("year_month"), "order_value", "invoice_no"
    )
    totals = begun.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_value").alias("_value")
    )
    medians = exact_quantiles(
        begun, ["year_month"], {"median_order_value_gbp": ("order_value", 0.5)}
    )
    # A window over months: bounded by the calendar.
    previous = F.lag("revenue_gbp").over(Window.orderBy("year_month"))
    return (
        lines.join(totals, "year_month", "left")
        .join(medians, "year_month", "left")
        .withColumn("revenue_gbp", C.money("revenue"))
        .select(
            "year_month",
            "revenue_gbp",
            "units",
            "sales_lines",
            "identified_customers",
            "orders",
            C.ratio("_value", "orders").alias("average_order_value_gbp"),
            "median_order_value_gbp",
            ((F.try_divide(F.col("revenue_gbp"), previous) - 1) * 100).alias(
                "month_over_month_growth_pct"
            ),
            C.partial_month(F.col("year_month"), last_sale_day(sales)).alias("is_partial_period"),
        )
        .orderBy("year_month")
    )


def complete_months(monthly: DataFrame) -> DataFrame:
    return monthly.where(~F.col("is_partial_period"))


def total_of(df: DataFrame, column: str):
    """Grand total as a scalar subquery, so that no window gathers all rows."""
    return df.agg(F.sum(column).alias("t")).scalar()


def _totals_and_breadth(sales: DataFrame, key: str, units: str) -> DataFrame:
    """Revenue, units, orders and identified customers per key.

    Lines collapse to (key, invoice) first, which carries the sums and counts the
    orders; customers are counted by a second light aggregate.
    """
    per_order = sales.groupBy(key, "invoice_no").agg(
        F.sum(REVENUE).alias("_revenue"), F.sum("quantity").alias("_units")
    )
    totals = per_order.groupBy(key).agg(
        F.sum("_units").alias(units), F.sum("_revenue").alias("revenue"), F.count("invoice_no").alias("orders")
    )
    buyers = distinct_per(sales, key, "customer_id", "identified_customers")
    return totals.join(buyers, key, "left").withColumn(
        "identified_customers", F.coalesce("identified_customers", F.lit(0)).cast("long")
    )


def country_share(sales: DataFrame) -> DataFrame:
    placed = sales.where(F.col("country").isNotNull())
    by_country = _totals_and_breadth(placed, "country", "units")
    total = total_of(placed, "line_revenue")
    return by_country.select(
        "country",
        C.money("revenue").alias("revenue_gbp"),
        "orders",
        "identified_customers",
        "units",
        C.ratio("revenue", "orders").alias("average_order_value_gbp"),
        C.ratio("revenue", total, 100).alias("revenue_share_pct"),
    ).orderBy(F.desc("revenue_gbp"), "country")


def latest_descriptions(lines: DataFrame) -> DataFrame:
    return latest_text(
        lines.where(F.col("stock_code").isNotNull()),
        ["stock_code"],
        "description",
        "invoice_date",
        UNKNOWN_PRODUCT,
    )


def product_performance(sales: DataFrame) -> DataFrame:
    """One row per product; sort or limit it where a report needs that."""
    coded = sales.where(F.col("stock_code").isNotNull())
    by_product = _totals_and_breadth(coded, "stock_code", "units_sold")
    return by_product.join(latest_descriptions(coded), "stock_code", "left").select(
        "stock_code",
        "units_sold",
        C.money("revenue").alias("revenue_gbp"),
        "orders",
        "identified_customers",
        "description",
        C.ratio("revenue", total_of(coded, "line_revenue"), 100).alias("revenue_share_pct"),
    )


def return_product_performance(returns: DataFrame) -> DataFrame:
    coded = returns.where(F.col("stock_code").isNotNull())
    by_product = coded.groupBy("stock_code").agg(
        F.sum(F.abs("quantity")).alias("returned_units"),
        C.money(F.sum(REVENUE)).alias("signed_return_value_gbp"),
        F.count_distinct("invoice_no").alias("return_invoices"),
    )
    return by_product.join(latest_descriptions(coded), "stock_code", "left").withColumn(
        "absolute_return_value_gbp", F.abs("signed_return_value_gbp")
    )


def weekday_performance(sales: DataFrame) -> DataFrame:
    return (
        sales.where(F.col("day_of_week").isNotNull())
        .groupBy("day_of_week")
        .agg(
            C.money(F.sum(REVENUE)).alias("revenue_gbp"),
            F.count_distinct("invoice_no").alias("orders"),
        )
        .withColumn("weekday_order", C.weekday_order("day_of_week"))
        .orderBy("weekday_order")
    )


def hourly_performance(sales: DataFrame) -> DataFrame:
    return (
        sales.where(F.col("invoice_date").isNotNull())
        .groupBy(F.hour("invoice_date").alias("hour"))
        .agg(
            C.money(F.sum(REVENUE)).alias("revenue_gbp"),
            F.count_distinct("invoice_no").alias("orders"),
        )
        .orderBy("hour")
    )


def revenue_deciles_qcut(customers: DataFrame) -> DataFrame:
    """Customers by falling revenue in ten quantile bins (not NTILE)."""
    ranked = global_row_number(
        customers.select("customer_id", "revenue"), [F.desc("revenue"), "customer_id"], "_rank"
    )
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = total_of(ranked, "revenue")
    return (
        ranked.groupBy(decile_bin(F.col("_rank"), n).alias("value_decile"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("_revenue"))
        .select(
            "value_decile",
            "customers",
            C.money("_revenue").alias("revenue_gbp"),
            C.ratio("_revenue", total, 100).alias("revenue_share_pct"),
        )
        .orderBy("value_decile")
    )


def eda_summary(sales: DataFrame, returns: DataFrame, orders: DataFrame, customers: DataFrame):
    """One row of headline metrics.

    Every input is reduced to one row on its own; the rows meet as scalar
    subqueries.
    """
    known = F.col("customer_id").isNotNull()
    flagged = F.col("is_line_revenue_outlier")

    def one(df: DataFrame):
        return df.select(F.struct("*").alias("s")).scalar()

    order = one(
        orders.agg(F.count(F.lit(1)).alias("orders"), F.sum("order_value").alias("value"))
    )
    median = exact_quantiles(orders, [], {"m": ("order_value", 0.5)}).scalar()
    customer = one(
        customers.agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if("is_repeat_customer").alias("repeats"),
        )
    )
    back = returns.agg(F.sum(REVENUE).alias("v")).scalar()
    deciles = revenue_deciles_qcut(customers)
    top = deciles.where("value_decile = 1").select("revenue_share_pct").scalar()
    zero = F.lit(0).cast("decimal(18,4)")
    totals = sales.agg(
        F.count(F.lit(1)).alias("completed_sales_rows"),
        F.coalesce(F.sum(REVENUE), zero).alias("_total"),
        F.sum("quantity").alias("units_sold"),
        F.coalesce(F.sum(F.when(known, F.col(REVENUE))), zero).alias("_known"),
        F.coalesce(F.sum(F.when(~known, F.col(REVENUE))), zero).alias("_anonymous"),
        F.coalesce(F.sum(F.when(flagged, F.col(REVENUE))), zero).alias("_flagged"),
        F.count_if(flagged).alias("line_revenue_outlier_rows"),
        F.to_date(F.max("invoice_date")).alias("data_through_date"),
    )
    last = F.col("data_through_date")
    partial = C.partial_month(F.date_format(last, "yyyy-MM"), last)
    return totals.select(
        "completed_sales_rows",
        C.money(F.round("_total", 2)).alias("completed_sales_value_gbp"),
        order["orders"].alias("orders"),
        "units_sold",
        C.rounded_ratio(order["value"], order["orders"]).alias("average_order_value_gbp"),
        C.money(F.round(median.cast("decimal(28,4)"), 2)).alias("median_order_value_gbp"),
        customer["customers"].alias("identified_customers"),
        customer["repeats"].alias("repeat_customers"),
        C.rounded_ratio(customer["repeats"], customer["customers"], 100).alias(
            "repeat_customer_rate_pct"
        ),
        C.money(F.round("_known", 2)).alias("identified_revenue_gbp"),
        C.money(F.round("_anonymous", 2)).alias("anonymous_revenue_gbp"),
        C.rounded_ratio("_anonymous", "_total", 100).alias("anonymous_revenue_share_pct"),
        C.money(F.round(F.coalesce(back, zero), 2)).alias("signed_returns_value_gbp"),
        C.rounded_ratio(F.abs(F.coalesce(back, zero)), "_total", 100).alias(
            "absolute_return_value_to_sales_pct"
        ),
        "line_revenue_outlier_rows",
        C.rounded_ratio("line_revenue_outlier_rows", "completed_sales_rows", 100).alias(
            "line_revenue_outlier_share_pct"
        ),
        C.money(F.round("_flagged", 2)).alias("flagged_revenue_gbp"),
        C.rounded_ratio("_flagged", "_total", 100).alias("flagged_revenue_share_pct"),
        F.round(top, 2).alias("top_customer_decile_revenue_share_pct"),
        "data_through_date",
        F.when(partial, F.date_format(last, "yyyy-MM")).alias("partial_period"),
    )


def value_percentiles(df: DataFrame, column: str, probs=(0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """(percentile, value) rows of one measure."""
    names = {f"p{round(p * 100)}": p for p in probs}
    wide = exact_quantiles(df, [], {n: (column, p) for n, p in names.items()})
    return wide.unpivot([], list(names), "percentile", "value")


def describe(df: DataFrame, columns: list[str], probs=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(metric, count, mean, std, min, percentiles, max), one row per column."""
    labels = {f"p{round(p * 100)}": p for p in probs}
    wanted = {f"{c}_{name}": (c, p) for c in columns for name, p in labels.items()}
    # One row of numbers, read first so that the table below is one plain pass.
    quantiles = exact_quantiles(df, [], wanted).first()
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.count(c).alias("count"),
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev(F.col(c).cast("double")).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            *[F.lit(quantiles[f"{c}_{name}"]).cast("double").alias(name) for name in labels],
            F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def histogram(
    df: DataFrame, column: str, bins: int, cap: float | None = None, clip=False, log=False
) -> DataFrame:
    """Counts in equal-width bins between the least and the greatest value.

    ``cap`` is a quantile: values above it are left out, or drawn down to it
    with ``clip``. ``log`` bins log(1 + x). The last bin includes its end.
    """
    value = F.col(column).cast("double")
    data = df.select(value.alias("v")).where(F.col("v").isNotNull())
    if cap is not None:
        limit = exact_quantiles(df, [], {"limit": (column, cap)}).first()[0]
        if limit is not None:
            data = (
                data.select(F.least("v", F.lit(limit)).alias("v"))
                if clip
                else data.where(F.col("v") <= limit)
            )
    if log:
        data = data.select(F.log1p("v").alias("v"))
    # Collapsing equal values first keeps the two later passes small.
    counts = data.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    lo = F.lit(lo).cast("double")
    width = (F.lit(hi).cast("double") - lo) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - lo, width)), F.lit(0))
    filled = counts.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.sum("c").alias("count")
    )
    return filled.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "count",
    )


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles per group and whiskers at the last value within 1.5 IQR.

    For groups one would draw side by side: a handful of them.
    """
    quartiles = exact_quantiles(
        df, [group], {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)}
    )
    counts = df.groupBy(group, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    spread = F.col("q3") - F.col("q1")
    inside = F.col("_v").between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread)
    return (
        counts.join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.sum("_c").alias("count"),
        )
    )


def revenue_splits(sales: DataFrame) -> DataFrame:
    """Revenue of identified against anonymous lines, and flagged against other."""
    sums = sales.agg(
        F.sum(F.when(F.col("customer_id").isNotNull(), F.col(REVENUE))).alias("Identified"),
        F.sum(F.when(F.col("customer_id").isNull(), F.col(REVENUE))).alias("Anonymous"),
        F.sum(F.when(F.col("is_line_revenue_outlier"), F.col(REVENUE))).alias("High-Revenue Flags"),
        F.sum(F.when(~F.col("is_line_revenue_outlier"), F.col(REVENUE))).alias("Other Sales Lines"),
    )
    names = sums.columns
    split = F.when(F.col("line_group").isin(*names[:2]), "identification").otherwise("outlier")
    return (
        sums.unpivot([], names, "line_group", "_revenue")
        .select(split.alias("split"), "line_group", C.money(F.coalesce("_revenue", F.lit(0))).alias("revenue_gbp"))
    )


def top_n(df: DataFrame, group: str, value: str, n: int, cut: int | None = None) -> DataFrame:
    """The n groups with the greatest total, ties by name; long labels cut."""
    totals = df.groupBy(group).agg(F.sum(value).alias(value))
    label = F.substring(group, 1, cut) if cut else F.col(group)
    return totals.orderBy(F.desc(value), group).limit(n).withColumn("label", label)


def build_eda(sales: DataFrame, returns: DataFrame) -> dict[str, DataFrame]:
    """All descriptive tables and the summary. Orders and customers feed several."""
    orders, customers = pin(order_summary(sales), wide=True), pin(customer_summary(sales), wide=True)
    return {
        "monthly_performance": monthly_performance(sales, orders),
        "country_performance": country_share(sales),
        "product_performance": product_performance(sales),
        "return_product_performance": return_product_performance(returns),
        "weekday_performance": weekday_performance(sales),
        "hourly_performance": hourly_performance(sales),
        "order_summary": orders,
        "customer_summary": customers,
        "customer_revenue_deciles": revenue_deciles_qcut(customers),
        "eda_summary": eda_summary(sales, returns, orders, customers),
    }
