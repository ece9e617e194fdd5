"""Star schema: four dimensions, two facts and the audit of excluded lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators.dedup import latest_text
from basketry.operators.ranking import global_row_number, ntile_bin
from basketry.sources.sinks import datasets

UNKNOWN_PRODUCT = "Unknown product"
UNKNOWN = "Unknown"
OUTLIER_FLAGS = ["is_quantity_outlier", "is_unit_price_outlier", "is_line_revenue_outlier"]


def dim_date(lines: DataFrame) -> DataFrame:
    """Days that occur on any line."""
    day = F.col("full_date")
    number = F.weekday(day) + 1
    return (
        lines.where(F.col("invoice_date").isNotNull())
        .select(F.to_date("invoice_date").alias("full_date"))
        .distinct()
        .select(
            C.date_key(day).alias("date_key"),
            day,
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.date_format(day, "yyyy-MM").alias("year_month"),
            F.dayofmonth(day).alias("day_of_month"),
            F.date_format(day, "EEEE").alias("day_of_week"),
            number.alias("day_of_week_number"),
            (number >= 6).cast("int").alias("is_weekend"),
        )
    )


def dim_product(lines: DataFrame) -> DataFrame:
    coded = lines.where(F.col("stock_code").isNotNull())
    named = latest_text(coded, ["stock_code"], "description", "invoice_date", UNKNOWN_PRODUCT)
    return global_row_number(
        named.withColumnRenamed("description", "product_description"), ["stock_code"], "product_key"
    )


def dim_customer(lines: DataFrame) -> DataFrame:
    """Identified buyers with first and last day and their usual country.

    One chain of two aggregations: the per-country counts that decide the
    usual country also carry the dates, so no join back is needed.
    """
    bought = lines.where(F.col("customer_id").isNotNull() & F.col("is_completed_sale"))
    per_country = bought.groupBy("customer_id", "country").agg(
        F.count("country").alias("_lines"),
        F.min("invoice_date").alias("_first"),
        F.max("invoice_date").alias("_last"),
    )
    customers = per_country.groupBy("customer_id").agg(
        F.min(F.struct((-F.col("_lines")).alias("_rank"), "country"))["country"].alias("_usual"),
        F.to_date(F.min("_first")).alias("first_purchase_date"),
        F.to_date(F.max("_last")).alias("last_purchase_date"),
    )
    return global_row_number(
        customers.select(
            "customer_id",
            F.coalesce("_usual", F.lit(UNKNOWN)).alias("primary_country"),
            "first_purchase_date",
            "last_purchase_date",
        ),
        ["customer_id"],
        "customer_key",
    )


def dim_country(lines: DataFrame) -> DataFrame:
    names = lines.where(F.col("country").isNotNull()).select(F.col("country").alias("country_name"))
    return global_row_number(names.distinct(), ["country_name"], "country_key")


def dimensions(lines: DataFrame) -> dict[str, DataFrame]:
    return {
        "dim_date": dim_date(lines),
        "dim_product": dim_product(lines),
        "dim_customer": dim_customer(lines),
        "dim_country": dim_country(lines),
    }


def look_up(facts: DataFrame, dim: DataFrame, on: str, dim_id: str, key: str) -> DataFrame:
    """Left lookup of a surrogate key that spreads missing ids over many tasks.

    A null id matches nothing, yet a shuffled join would send all of them to
    one task. Each gets a stand-in of its own, made from its line id, that no id
    can equal. No hint: by its
    written size the dimension is broadcast, or else AQE splits hot ids.
    """
    salt = F.xxhash64("transaction_line_id").cast("string")
    stand_in = F.coalesce(F.col(on), F.concat(F.lit("\u0000"), salt))
    keys = dim.select(F.col(dim_id).alias("_dim_id"), F.col(key))
    return (
        facts.withColumn("_lookup", stand_in)
        .join(keys, F.col("_lookup") == F.col("_dim_id"), "left")
        .drop("_lookup", "_dim_id")
    )


def with_keys(lines: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Surrogate keys; unknown product or country is 0, unknown customer null."""
    sent, back = C.narrowed(lines)
    # Countries and days are short of values: their small keys go into the larger joins instead of names and times.
    keyed = look_up(lines.withColumns(sent).drop(*back) if sent else lines, dims["dim_country"], "country", "country_name", "country_key")
    keyed = keyed.withColumn("date_key", C.date_key("invoice_date"))
    keyed = look_up(keyed, dims["dim_product"], "stock_code", "stock_code", "product_key")
    keyed = look_up(keyed, dims["dim_customer"], "customer_id", "customer_id", "customer_key")
    return keyed.select(
        *[back[c].alias(c) if c in back else F.col(c) for c in lines.columns],
        F.coalesce("country_key", F.lit(0)).alias("country_key"),
        "date_key",
        F.coalesce("product_key", F.lit(0)).alias("product_key"),
        "customer_key",
    )


_FACT_KEYS = [
    "transaction_line_id",
    "invoice_no",
    "date_key",
    "product_key",
    "customer_key",
    "country_key",
    "quantity",
    "unit_price",
]


def fact_sales(lines: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    return with_keys(datasets(lines)["completed_sales"], dims).select(
        *_FACT_KEYS, "line_revenue", *[F.col(c).cast("int").alias(c) for c in OUTLIER_FLAGS]
    )


def fact_returns(lines: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    return with_keys(datasets(lines)["returns"], dims).select(
        *_FACT_KEYS, F.col("line_revenue").alias("signed_return_value")
    )


def audit_exclusions(lines: DataFrame) -> DataFrame:
    return datasets(lines)["excluded_records"].select(
        "transaction_line_id",
        "invoice_no",
        "stock_code",
        "invoice_date",
        "quantity",
        "unit_price",
        "exclusion_reason",
    )


def facts(lines: DataFrame, dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "fact_sales": fact_sales(lines, dims),
        "fact_returns": fact_returns(lines, dims),
        "audit_exclusions": audit_exclusions(lines),
    }


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def orphan_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Fact keys without a dimension row, per relationship.

    Distinct keys are counted first, so the anti-join sees each key once and
    its size follows the dimension, not the fact.
    """
    checks = [
        ("orphan_sales_dates", "fact_sales", "dim_date", "date_key"),
        ("orphan_sales_products", "fact_sales", "dim_product", "product_key"),
        ("orphan_sales_countries", "fact_sales", "dim_country", "country_key"),
        ("orphan_return_dates", "fact_returns", "dim_date", "date_key"),
        ("orphan_return_products", "fact_returns", "dim_product", "product_key"),
    ]
    parts = [
        tables[fact]
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(tables[dim].select(key), key, "left_anti")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("failure_count"))
        .select(F.lit(name).alias("check_name"), "failure_count")
        for name, fact, dim, key in checks
    ]
    return reduce(DataFrame.unionByName, parts)


# Column rules of the star tables: (table, column, rule, condition that must hold).
_UNIQUE_COLUMNS = [
    ("dim_date", "date_key"),
    ("dim_date", "full_date"),
    ("dim_product", "product_key"),
    ("dim_product", "stock_code"),
    ("dim_customer", "customer_key"),
    ("dim_customer", "customer_id"),
    ("dim_country", "country_key"),
    ("dim_country", "country_name"),
    ("fact_sales", "transaction_line_id"),
    ("fact_returns", "transaction_line_id"),
    ("audit_exclusions", "transaction_line_id"),
]
_CHECKS = {
    "dim_date": {"is_weekend_binary": "is_weekend IN (0, 1)"},
    "fact_sales": {
        "quantity_positive": "quantity > 0",
        "unit_price_positive": "unit_price > 0",
        "line_revenue_positive": "line_revenue > 0",
        **{f"{c}_binary": f"{c} IN (0, 1)" for c in OUTLIER_FLAGS},
    },
}
_REQUIRED = {
    "dim_date": ["full_date", "year", "quarter", "month", "month_name", "year_month"],
    "dim_product": ["stock_code", "product_description"],
    "dim_customer": ["customer_id", "primary_country"],
    "dim_country": ["country_name"],
    "fact_sales": ["invoice_no", "date_key", "product_key", "country_key"],
    "fact_returns": ["invoice_no", "date_key", "product_key", "country_key", "quantity"],
    "audit_exclusions": ["exclusion_reason"],
}


# Gaps that raw lines may have and cleaning keeps: reported, but no reason to stop.
_GAPS = {("fact_returns", "quantity_not_null")}


def _rules(name: str) -> dict[str, Column]:
    """Failures of a table's NOT NULL and CHECK rules, as aggregates of one pass."""
    rules = {f"{c}_not_null": F.count_if(F.col(c).isNull()) for c in _REQUIRED[name]}
    for rule, condition in _CHECKS.get(name, {}).items():
        rules[rule] = F.count_if(~F.coalesce(F.expr(condition), F.lit(True)))
    return rules


def _unique_report(tables: dict[str, DataFrame]) -> list[DataFrame]:
    reports = []
    for name, column in _UNIQUE_COLUMNS:
        # Surplus rows per value: copies meet in the partial aggregate.
        surplus = tables[name].groupBy(column).agg((F.count(F.lit(1)) - 1).alias("_surplus"))
        reports.append(
            surplus.agg(F.coalesce(F.sum("_surplus"), F.lit(0)).alias("failures")).select(
                F.lit(name).alias("table_name"), F.lit(f"{column}_unique").alias("rule"), "failures"
            )
        )
    return reports


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that break a NOT NULL, UNIQUE or CHECK rule: (table, rule, failures)."""
    reports = []
    for name, df in tables.items():
        rules = _rules(name)
        counted = df.agg(*[failures.alias(rule) for rule, failures in rules.items()])
        reports.append(counted.unpivot([], list(rules), "rule", "failures").select(
            F.lit(name).alias("table_name"), "rule", "failures"
        ))
    return reduce(DataFrame.unionByName, [*reports, *_unique_report(tables)])


@dataclass(frozen=True)
class Published:
    """Star tables, and what was counted while they were written: rows, and failures by rule."""

    tables: dict[str, DataFrame]
    rows: dict[str, int]
    failures: dict[tuple[str, str], int]

    def row_counts(self) -> DataFrame:
        return self._spark().createDataFrame(list(self.rows.items()), "table_name string, row_count long")

    def constraint_report(self) -> DataFrame:
        """As the function of this name; only the UNIQUE rules read the tables again, and of them the keys alone."""
        counted = [(*place, n) for place, n in self.failures.items()]
        frame = self._spark().createDataFrame(counted, "table_name string, rule string, failures long")
        return reduce(DataFrame.unionByName, [frame, *_unique_report(self.tables)])

    def _spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession


def write_observed(df: DataFrame, metrics: dict[str, Column], write) -> dict:
    """``write(df)``, and the aggregates ``metrics`` of the rows that pass on the way."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return seen.get


def publish_observed(lines: DataFrame, folder: str) -> Published:
    """Write the star tables, counted as they are written, and hand them out only if their rules hold.

    Facts look their keys up in the written dimensions, whose file sizes let
    Catalyst broadcast the small ones.
    """
    spark = lines.sparkSession
    rows, failures = {}, {}

    def written(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in tables.items():
            rules = _rules(name)
            taken = write_observed(
                df, {"rows": F.count(F.lit(1)), **rules}, lambda d: d.write.mode("overwrite").parquet(f"{folder}/{name}")
            )
            rows[name] = taken["rows"]
            failures.update({(name, rule): taken[rule] for rule in rules})
        return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}

    dims = written(dimensions(lines))
    found = Published({**dims, **written(facts(lines, dims))}, rows, failures)
    broken = orphan_counts(found.tables).where("failure_count > 0").collect()
    if broken:
        raise RuntimeError(f"Foreign keys do not resolve: {broken}")
    broken = [r for r in found.constraint_report().where("failures > 0").collect() if (r["table_name"], r["rule"]) not in _GAPS]
    if broken:
        raise RuntimeError(f"Star tables break their rules: {broken}")
    return found


def publish(lines: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The tables of ``publish_observed``."""
    return publish_observed(lines, folder).tables


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views for the named statements."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def ranked_customers(fact_sales: DataFrame) -> DataFrame:
    """One row per customer with revenue and NTILE(10) by falling revenue."""
    per_customer = (
        fact_sales.where(F.col("customer_key").isNotNull())
        .groupBy("customer_key")
        .agg(F.sum("line_revenue").alias("revenue"))
    )
    ranked = global_row_number(per_customer, [F.desc("revenue"), "customer_key"], "place")
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.withColumn("value_decile", ntile_bin(F.col("place"), n, 10))
