"""Slice-aware measures and detail views over the marts.

Orders and customers are counted from order and customer rows, never summed
from month marts: distinct counts do not add up over slices. Bitmaps of customers
do, so ``slice_table`` answers any filter without the orders.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators.ranking import global_row_number


def slice_by(df: DataFrame, filters: dict[str, list] | None) -> DataFrame:
    for column, values in (filters or {}).items():
        df = df.where(F.col(column).isin(values))
    return df


def _sales_measures():
    revenue = F.col("order_revenue_gbp").cast("decimal(28,4)")
    known = F.col("is_identified_customer")
    zero = F.lit(0).cast("decimal(28,4)")
    return [
        F.sum(revenue).alias("_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("units_sold").alias("units_sold"),
        F.count_distinct("customer_id").alias("identified_customers"),
        F.coalesce(F.sum(F.when(~known, revenue)), zero).alias("_anonymous"),
    ]


def _sales_output():
    return [
        C.money("_revenue").alias("total_revenue"),
        "total_orders",
        "units_sold",
        C.ratio("_revenue", "total_orders").alias("average_order_value"),
        "identified_customers",
        C.money("_anonymous").alias("anonymous_revenue"),
        C.ratio("_anonymous", "_revenue").alias("anonymous_revenue_share"),
    ]


def sales_measures(orders: DataFrame, dims: list[str], filters=None) -> DataFrame:
    """Revenue, orders, units, AOV, identified customers and anonymous share."""
    return slice_by(orders, filters).groupBy(*dims).agg(*_sales_measures()).select(*dims, *_sales_output())


def customer_measures(customers: DataFrame, dims: list[str], filters=None) -> DataFrame:
    """Repeat customers and rate, customers at risk, historical value."""
    value = F.sum(F.col("monetary_value_gbp").cast("decimal(28,4)"))
    return (
        slice_by(customers, filters)
        .groupBy(*dims)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if("is_repeat_customer").alias("repeat_customers"),
            F.count_if(F.col("rfm_segment") == "At Risk").alias("at_risk_customers"),
            C.money(value).alias("historical_customer_value"),
        )
        .withColumn("repeat_customer_rate", C.ratio("repeat_customers", "customers"))
    )


def measures_by_customer_slice(
    orders: DataFrame, customers: DataFrame, dims: list[str], filters=None
) -> DataFrame:
    """Sales and customer measures per customer attribute.

    Customers filter orders, not the other way round. Orders without a
    customer fall into the blank slice unless a filter removes it.
    """
    chosen = slice_by(customers, filters)
    how = "inner" if filters else "left"
    # Orders first shrink to one row per customer: a join on the id of a very
    # large buyer, or on a missing id, then meets one row and not its orders.
    revenue = F.col("order_revenue_gbp").cast("decimal(28,4)")
    per_customer = orders.groupBy("customer_id").agg(
        F.sum(revenue).alias("_revenue"),
        F.count_distinct("order_id").alias("_orders"),
        F.sum("units_sold").alias("units_sold"),
    )
    zero = F.lit(0).cast("decimal(38,4)")
    sales = (
        per_customer.join(chosen.select("customer_id", *dims), "customer_id", how)
        .groupBy(*dims)
        .agg(
            F.sum("_revenue").alias("_revenue"),
            F.sum("_orders").alias("total_orders"),
            F.sum("units_sold").alias("units_sold"),
            F.count("customer_id").alias("identified_customers"),
            F.coalesce(F.sum(F.when(F.col("customer_id").isNull(), F.col("_revenue"))), zero).alias(
                "_anonymous"
            ),
        )
        .select(*dims, *_sales_output())
    )
    people = customer_measures(customers, dims, filters)
    same = None
    for i, d in enumerate(dims):
        people = people.withColumnRenamed(d, f"_d{i}")
        match = F.col(d).eqNullSafe(F.col(f"_d{i}"))
        same = match if same is None else same & match
    return sales.join(people, same, "left").drop(*[f"_d{i}" for i in range(len(dims))])


def slice_table(orders: DataFrame, customers: DataFrame, dims: list[str], traits: list[str]) -> DataFrame:
    """Finest slices by order columns ``dims`` and customer columns ``traits``, ready for any filter and total.

    Revenue, orders and units add up; customers do not, so a slice holds the bits
    of its customers' numbers, in buckets of fixed size, and the bits of those who
    buy repeatedly. An order lies in one slice. Orders shrink to one row per
    customer and slice before they meet the numbers, so a very large buyer is a
    few rows; orders without a customer have no bits.
    """
    revenue = F.col("order_revenue_gbp").cast("decimal(28,4)")
    sums = orders.groupBy("customer_id", *dims).agg(
        F.sum(revenue).alias("_revenue"), F.count_distinct("order_id").alias("_orders"), F.sum("units_sold").alias("_units")
    )
    known = F.col("customer_id").isNotNull()
    ids = sums.where(known).select("customer_id").distinct().join(
        customers.select("customer_id", F.col("is_repeat_customer").alias("_repeat"), *traits), "customer_id", "left"
    )
    numbered = global_row_number(ids, ["customer_id"], "_number")
    both = sums.where(known).join(numbered, "customer_id").unionByName(sums.where(~known), allowMissingColumns=True)
    place = F.bitmap_bit_position("_number")
    return (
        both.withColumns({"_bucket": F.bitmap_bucket_number("_number"), "_place": place})
        .groupBy(*dims, *traits, "_bucket")
        .agg(
            F.sum("_revenue").alias("_revenue"),
            F.sum("_orders").alias("_orders"),
            F.sum("_units").alias("_units"),
            F.sum(F.when(~known, F.col("_revenue"))).alias("_anonymous"),
            F.bitmap_construct_agg("_place").alias("_customers"),
            F.bitmap_construct_agg(F.when(F.col("_repeat"), F.col("_place"))).alias("_repeats"),
        )
    )


def measures_from_slices(slices: DataFrame, dims: list[str], filters=None, totals: bool = False) -> DataFrame:
    """Measures by any of the slices' columns under any filter on them, from the slices alone.

    With ``totals`` every subset of ``dims`` is grouped by; ``grouped_by`` names
    it, since a blank slice and a total both show as null.
    """
    subsets = [list(c) for n in range(len(dims), -1 if totals else len(dims) - 1, -1) for c in combinations(dims, n)]
    label = F.concat_ws(",", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    zero = F.lit(0).cast("decimal(38,4)")
    merged = (
        slice_by(slices, filters)
        .groupingSets([[*s, "_bucket"] for s in subsets], *dims, "_bucket")
        .agg(
            label.alias("grouped_by"),
            *[F.sum(c).alias(c) for c in ("_revenue", "_orders", "_units", "_anonymous")],
            F.bitmap_count(F.bitmap_or_agg("_customers")).alias("_customers"),
            F.bitmap_count(F.bitmap_or_agg("_repeats")).alias("_repeats"),
        )
    )
    return (
        merged.groupBy("grouped_by", *dims)
        .agg(
            F.sum("_revenue").alias("_revenue"),
            F.sum("_orders").alias("total_orders"),
            F.sum("_units").alias("units_sold"),
            F.sum("_customers").alias("identified_customers"),
            F.coalesce(F.sum("_anonymous"), zero).alias("_anonymous"),
            F.sum("_repeats").alias("repeat_customers"),
        )
        .select(
            "grouped_by", *dims, *_sales_output(), "repeat_customers",
            C.ratio("repeat_customers", "identified_customers").alias("repeat_customer_rate"),
        )
    )


def time_measures(orders: DataFrame, returns_month: DataFrame) -> DataFrame:
    """Month revenue against the previous calendar month, and return ratios.

    Unlike a lag over present months, a month after a gap has no predecessor.
    """
    monthly = orders.groupBy("month_start").agg(
        F.sum(F.col("order_revenue_gbp").cast("decimal(28,4)")).alias("_revenue")
    )
    previous = monthly.select(
        F.add_months("month_start", 1).alias("month_start"), F.col("_revenue").alias("_previous")
    )
    back = returns_month.select("month_start", F.col("absolute_return_value_gbp").alias("return_value"))
    revenue = F.col("_revenue").cast("double")
    before = F.col("_previous").cast("double")
    return (
        monthly.join(previous, "month_start", "left")
        .join(back, "month_start", "left")
        .select(
            "month_start",
            revenue.alias("total_revenue"),
            before.alias("previous_month_revenue"),
            C.ratio(F.col("_revenue") - F.col("_previous"), "_previous").alias(
                "month_over_month_growth"
            ),
            "return_value",
            F.try_divide(F.col("return_value"), revenue).alias("return_value_to_sales_ratio"),
        )
    )


def customer_detail(orders: DataFrame, customers: DataFrame, filters=None) -> DataFrame:
    """Profile of a customer next to each of that customer's orders."""
    profile = slice_by(customers, filters).select(
        "customer_id",
        "first_purchase_date",
        "last_purchase_date",
        F.col("monetary_value_gbp").alias("historical_customer_value"),
        "frequency_orders",
        "average_order_value_gbp",
        "rfm_segment",
        "cluster_label",
    )
    # Missing ids match nothing; leaving them out keeps them off the shuffle.
    known = orders.where(F.col("customer_id").isNotNull()).select(
        "customer_id", "order_id", "order_date", "country", "order_revenue_gbp", "units_sold",
        "distinct_products",
    )
    return known.join(profile, "customer_id")


def monthly_trend(mart: DataFrame, column: str, filters=None) -> DataFrame:
    """Month rows of one product or country, or of all of them."""
    return slice_by(mart, filters).orderBy(column, "month_start")


def product_month_matrix(product_month: DataFrame, top: int = 15, months: list[str] | None = None):
    """Revenue of the top products, one column per month.

    Without a month list it is read from the data first: one value per month.
    """
    labelled = product_month.withColumn("_month", F.date_format("month_start", "yyyy-MM"))
    if months is None:
        months = [r[0] for r in labelled.select("_month").distinct().orderBy("_month").collect()]
    revenue = F.col("revenue_gbp").cast("decimal(28,4)")
    best = (
        labelled.groupBy("stock_code")
        .agg(F.sum(revenue).alias("_total"))
        .orderBy(F.desc("_total"), "stock_code")
        .limit(top)
    )
    # Bounded: the limit above.
    return (
        labelled.join(F.broadcast(best.select("stock_code")), "stock_code", "left_semi")
        .groupBy("stock_code")
        .pivot("_month", months)
        .agg(F.sum("revenue_gbp"))
    )
