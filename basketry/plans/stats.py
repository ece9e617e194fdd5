"""Rank correlations, group tests and their adjusted p-values.

Spark reduces the customers and orders to one row per test; the p-values are
then computed from those few numbers on the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.functions import probability as P
from basketry.operators.ranking import average_ranks, exact_quantiles, holm, running_total
from basketry.plans.rfm import MEASURES
from basketry.schema import require_columns

ORDER_FEATURES = ["order_value_gbp", "units", "product_lines", "distinct_products"]
ALPHA = 0.05
CORRELATIONS = "spearman_correlations"
GROUP_TESTS = "confirmatory_group_tests"

TEST_SCHEMA = (
    "test_id string, family string, test_name string, comparison string, sample_size_total long, "
    "sample_size_group_1 long, sample_size_group_2 long, group_1 string, group_2 string, "
    "group_1_summary string, group_2_summary string, statistic_name string, statistic double, "
    "raw_p_value double, effect_size_name string, effect_size double"
)


def check_inputs(rfm: DataFrame, orders: DataFrame) -> None:
    """Required columns, and no gaps in them."""
    needed = {"customers": (rfm, ["customer_id", "primary_country", *MEASURES]),
              "orders": (orders, ["invoice_no", "country", "order_value_gbp"])}
    for what, (df, columns) in needed.items():
        require_columns(df, columns, f"Statistical input {what}")
        gap = F.lit(False)
        for c in columns:
            gap |= F.col(c).isNull()
        if not df.where(gap).isEmpty():
            raise ValueError(f"Statistical input {what} contains missing values.")


def with_groups(df: DataFrame, country: str, home: str) -> DataFrame:
    data = df.withColumn("geography", C.geography(country, home))
    if "frequency_orders" in df.columns:
        data = data.withColumn("is_repeat_customer", F.col("frequency_orders") >= 2)
    return data


def spearman_pairs(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(feature_1, feature_2, rho) for every pair of features, in one pass."""
    ranks = average_ranks(df, key, features)
    pairs = [
        F.struct(
            F.lit(a).alias("feature_1"),
            F.lit(b).alias("feature_2"),
            F.corr(f"rank_{a}", f"rank_{b}").alias("rho"),
        )
        for a, b in combinations(features, 2)
    ]
    return ranks.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def correlation_matrix(pairs: DataFrame, features: list[str]) -> DataFrame:
    """Square matrix, one row per feature, from the pairs."""
    mirrored = (
        pairs.unionByName(
            pairs.select(
                F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "rho"
            )
        )
    )
    return (
        mirrored.groupBy(F.col("feature_1").alias("feature"))
        .pivot("feature_2", features)
        .agg(F.max("rho"))
        .select("feature", *[F.when(F.col("feature") == f, 1.0).otherwise(F.col(f)).alias(f) for f in features])
    )


def mann_whitney(df: DataFrame, value: str, first_group) -> DataFrame:
    """One row: U of the first group, sizes, tie term and rank-biserial effect.

    The rank sum comes from the histogram of values, so tied rows are never
    brought together.
    """
    histogram = (
        df.select(F.col(value).cast("double").alias("v"), first_group.alias("g"))
        .where(F.col("v").isNotNull() & F.col("g").isNotNull())
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("g")).alias("c1"))
    )
    ranked = running_total(histogram, ["v"], "c")
    # Twice the average rank is a whole number, so the sum stays exact.
    twice = (F.col("c1") * (2 * F.col("before") + F.col("c") + 1)).cast("decimal(38,0)")
    ties = F.col("c").cast("double") * (F.col("c").cast("double") ** 2 - 1)
    n1 = F.col("n_group_1").cast("double")
    n2 = F.col("n_group_2").cast("double")
    return (
        ranked.agg(
            F.sum("c1").alias("n_group_1"),
            F.sum(F.col("c") - F.col("c1")).alias("n_group_2"),
            F.sum(twice).alias("_twice"),
            F.sum(ties).alias("tie_term"),
        )
        .withColumn("u_statistic", F.col("_twice").cast("double") / 2 - n1 * (n1 + 1) / 2)
        .withColumn("rank_biserial", F.try_divide(2 * F.col("u_statistic"), n1 * n2) - 1)
        .drop("_twice")
    )


def contingency(customers: DataFrame, home: str) -> DataFrame:
    """Geography x repeat status, both rows present even when empty."""
    counted = with_groups(customers, "primary_country", home).agg(
        *[
            F.struct(
                F.lit(place).alias("geography"),
                F.count_if(here & ~F.col("is_repeat_customer")).alias("one_time_customers"),
                F.count_if(here & F.col("is_repeat_customer")).alias("repeat_customers"),
            ).alias(name)
            for name, place, here in (
                ("a", home, F.col("geography") == home),
                ("b", "International", F.col("geography") != home),
            )
        ]
    )
    return counted.select(F.explode(F.array("a", "b")).alias("r")).select("r.*")


def chi_square(table: DataFrame) -> DataFrame:
    """Pearson statistic without correction, and Cramer's V, of a 2 x 2 table."""
    a, b = F.col("one_time_customers"), F.col("repeat_customers")
    cells = table.agg(
        F.collect_list(F.struct(a.alias("a"), b.alias("b"))).alias("r"),
        F.sum(a).cast("double").alias("ca"),
        F.sum(b).cast("double").alias("cb"),
    )
    n = F.col("ca") + F.col("cb")

    def deviation(cell, column_total, row):
        expected = (row["a"] + row["b"]) * column_total / n
        return F.try_divide((cell - expected) * (cell - expected), expected)

    statistic = F.aggregate(
        "r",
        F.lit(0.0),
        lambda total, row: total
        + deviation(row["a"].cast("double"), F.col("ca"), row)
        + deviation(row["b"].cast("double"), F.col("cb"), row),
    )
    return cells.select(
        statistic.alias("chi_square"),
        F.sqrt(F.try_divide(statistic, n)).alias("cramers_v"),
        n.cast("long").alias("n"),
    )


def geo_repeat_rate(customers: DataFrame, home: str) -> DataFrame:
    return (
        with_groups(customers, "primary_country", home)
        .groupBy("geography")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            (100 * F.avg(F.col("is_repeat_customer").cast("int"))).alias("repeat_rate_pct"),
        )
    )


def group_summaries(customers: DataFrame, orders: DataFrame, home: str) -> DataFrame:
    """Median value by repeat status and by geography, repeat share by geography."""
    people = with_groups(customers, "primary_country", home)
    sales = with_groups(orders, "country", home)
    status = F.when(F.col("is_repeat_customer"), "repeat").otherwise("one_time")
    by_status = exact_quantiles(
        people.withColumn("group", status), ["group"], {"value": ("monetary_value_gbp", 0.5)}
    ).withColumn("measure", F.lit("median_customer_value"))
    by_place = exact_quantiles(
        sales.withColumnRenamed("geography", "group"),
        ["group"],
        {"value": ("order_value_gbp", 0.5)}
    ).withColumn("measure", F.lit("median_order_value"))
    shares = people.groupBy(F.col("geography").alias("group")).agg(
        F.avg(F.col("is_repeat_customer").cast("int")).alias("value")
    ).withColumn("measure", F.lit("repeat_proportion"))
    return by_status.unionByName(by_place).unionByName(shares).select("measure", "group", "value")


def _correlation_rows(pairs: list, medians, n: int) -> list[tuple]:
    rows = []
    for a, b, rho in pairs:
        rho = float("nan") if rho is None else rho
        rows.append(
            (
                f"spearman__{a}__{b}", CORRELATIONS, "Spearman rank correlation", f"{a} versus {b}",
                n, None, None, a, b, f"median={medians[a]:.4f}", f"median={medians[b]:.4f}",
                "Spearman rho", rho, P.spearman_p(rho, n), "Spearman rho", rho,
            )
        )
    return rows


def _mann_whitney_row(r, medians: dict, groups, names, test_id, what) -> tuple:
    summaries = [f"median_gbp={medians.get(g, float('nan')):.2f}" for g in groups]
    n1, n2 = r["n_group_1"] or 0, r["n_group_2"] or 0
    u = r["u_statistic"] if n1 and n2 else float("nan")
    return (
        test_id, GROUP_TESTS, "Mann-Whitney U", f"{what}: {names[0]} versus {names[1]}",
        n1 + n2, n1, n2, names[0], names[1], *summaries, "Mann-Whitney U", u,
        P.mann_whitney_p(u, n1, n2, r["tie_term"] or 0.0), "Rank-biserial correlation",
        r["rank_biserial"],
    )


def hypothesis_tests(customers: DataFrame, orders: DataFrame, home: str) -> DataFrame:
    """All correlation and group tests with Holm-adjusted p-values per family."""
    people = with_groups(customers, "primary_country", home)
    sales = with_groups(orders, "country", home)
    table = contingency(customers, home)
    value_test = partial(mann_whitney, people, "monetary_value_gbp", F.col("is_repeat_customer"))
    order_test = partial(mann_whitney, sales, "order_value_gbp", F.col("geography") == home)
    # Independent jobs of a few result rows each, submitted side by side.
    with ThreadPoolExecutor(7) as pool:
        jobs = [
            pool.submit(job)
            for job in (
                lambda: group_summaries(customers, orders, home).collect(),
                lambda: spearman_pairs(customers, "customer_id", MEASURES).collect(),
                lambda: exact_quantiles(customers, [], {f: (f, 0.5) for f in MEASURES}).first(),
                customers.count,
                lambda: value_test().first(),
                lambda: order_test().first(),
                lambda: (table.collect(), chi_square(table).first()),
            )
        ]
        summaries, pairs, medians, n, by_status, by_place, (counts, chi) = [j.result() for j in jobs]
    values = {(r["measure"], r["group"]): r["value"] for r in summaries}
    rows = _correlation_rows(pairs, medians, n)
    rows.append(
        _mann_whitney_row(
            by_status,
            {g: v for (m, g), v in values.items() if m == "median_customer_value"},
            ["repeat", "one_time"], ["Repeat customers", "One-time customers"],
            "mann_whitney__repeat_vs_one_time_customer_value", "Customer value",
        )
    )
    rows.append(
        _mann_whitney_row(
            by_place,
            {g: v for (m, g), v in values.items() if m == "median_order_value"},
            [home, "International"], [f"{home} orders", "International orders"],
            "mann_whitney__home_vs_international_order_value", "Order value",
        )
    )
    sizes = {r["geography"]: r["one_time_customers"] + r["repeat_customers"] for r in counts}
    share = {g: v for (m, g), v in values.items() if m == "repeat_proportion"}
    parts = [f"repeat_proportion={share.get(g, float('nan')):.4f}" for g in (home, "International")]
    statistic = chi["chi_square"] if chi["chi_square"] is not None else float("nan")
    rows.append(
        (
            "chi_square__geography_vs_repeat_status", GROUP_TESTS,
            "Pearson chi-square test of independence", "Repeat status by geography",
            chi["n"], sizes[home], sizes["International"], f"{home} customers",
            "International customers", *parts, "Chi-square", statistic,
            P.chi_square_one_df(statistic), "Cramer's V", chi["cramers_v"],
        )
    )
    tests = customers.sparkSession.createDataFrame(rows, TEST_SCHEMA)
    return holm(tests, "family", "raw_p_value", "test_id").withColumns(
        {
            "p_adjustment": F.lit("Holm (within test family)"),
            "effect_magnitude": C.effect_magnitude(F.col("effect_size")),
            "alpha": F.lit(ALPHA),
            "reject_null": F.col("adjusted_p_value") < ALPHA,
        }
    )


def strongest(correlations: DataFrame, n: int = 5) -> DataFrame:
    """The n rows of greatest absolute effect."""
    return correlations.orderBy(F.desc(F.abs("effect_size")), "comparison").limit(n)


def statistical_summary(tests: DataFrame) -> DataFrame:
    """One row: counts, range of the correlations, the strongest five, the group tests, sample sizes.

    Arrays hold one entry per test of a fixed list.
    """
    correlation, group = F.col("family") == CORRELATIONS, F.col("family") == GROUP_TESTS
    brief = F.struct("test_id", "statistic", "raw_p_value", "adjusted_p_value", "effect_size", "effect_magnitude", "reject_null")
    top = strongest(tests.where(correlation)).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.abs("effect_size")).alias("o"), "comparison", brief.alias("b")))),
            lambda x: x["b"],
        )
    )
    return tests.agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(correlation).alias("correlations"),
        F.count_if(group).alias("confirmatory_group_tests"),
        F.count_if(F.col("reject_null")).alias("holm_adjusted_significant"),
        F.min(F.when(correlation, F.col("effect_size"))).alias("least_correlation"),
        F.max(F.when(correlation, F.col("effect_size"))).alias("greatest_correlation"),
        F.max(F.when(correlation, F.col("sample_size_total"))).alias("customers"),
        F.max(F.when(F.col("test_id").startswith("mann_whitney__home"), F.col("sample_size_total"))).alias("orders"),
        F.sort_array(F.collect_list(F.when(group, brief))).alias("group_tests"),
    ).withColumn("strongest_correlations", top.scalar())
