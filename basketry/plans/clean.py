"""Raw lines to the reconciled canonical table, with its profile and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators.dedup import copies_by_identity, drop_exact_copies
from basketry.operators.ranking import exact_quantiles, global_row_number
from basketry.schema import IDENTITY

FENCED = ["quantity", "unit_price", "line_revenue"]


def classify(lines: DataFrame) -> DataFrame:
    """Revenue and the four line flags."""
    return lines.withColumns(
        {
            "line_revenue": C.line_revenue(),
            "is_cancelled": C.is_cancelled(),
            "is_return": C.is_return(),
            "is_completed_sale": C.is_completed_sale(),
            "has_customer_id": F.col("customer_id").isNotNull(),
        }
    )


def enrich(lines: DataFrame) -> DataFrame:
    """Calendar parts, line class and exclusion reason."""
    return lines.withColumns(
        {
            **C.date_parts(),
            "transaction_type": C.transaction_type(),
            "exclusion_reason": C.exclusion_reason(),
        }
    )


def load_order() -> list:
    """Load position first; identity breaks ties, so the order is total."""
    return ["load_seq", *IDENTITY]


def with_line_ids(unique_lines: DataFrame) -> DataFrame:
    return global_row_number(unique_lines, load_order(), "transaction_line_id", wide=True)


def upper_fences(df: DataFrame, measures: list[str], where=None) -> DataFrame:
    """One row of Q3 + 1.5 (Q3 - Q1) per measure; null without any value."""
    source = df if where is None else df.where(where)
    wanted = {f"{m}_q{int(p * 100)}": (m, p) for m in measures for p in (0.25, 0.75)}
    return exact_quantiles(source, [], wanted).select(
        *[
            (F.col(f"{m}_q75") + 1.5 * (F.col(f"{m}_q75") - F.col(f"{m}_q25"))).alias(f"{m}_upper")
            for m in measures
        ]
    )


def flag_above(df: DataFrame, fences: DataFrame, measures: list[str], where=None) -> DataFrame:
    """``is_<measure>_outlier``: flagged, never removed."""
    limits = fences.select(F.struct(*[f"{m}_upper" for m in measures]).alias("s")).scalar()
    keep = F.lit(True) if where is None else where
    return df.withColumns(
        {
            f"is_{m}_outlier": F.coalesce(
                keep & (F.col(m).cast("double") > limits[f"{m}_upper"]), F.lit(False)
            )
            for m in measures
        }
    )


def canonical_table(lines: DataFrame, batch_names: list[str], given: list[str] | None = None) -> DataFrame:
    """Standardised lines -> unique, numbered, classified and flagged lines; ``given`` as in ``drop_exact_copies``."""
    unique = with_line_ids(drop_exact_copies(lines, given))
    full = enrich(classify(unique)).withColumn("source_batch", C.batch_name(batch_names))
    sale = F.col("is_completed_sale")
    return flag_above(full, upper_fences(full, FENCED, sale), FENCED, sale)


def raw_profile(lines: DataFrame, batch_names: list[str]) -> DataFrame:
    """One row that describes the raw lines without changing them.

    Lines collapse by identity first, in the only full-width shuffle, with their
    count and the number of batches that hold them; everything else is weighted
    by that count. Distinct values are counted by narrow aggregates.
    """
    copies = copies_by_identity(lines, len(batch_names))
    data = classify(copies)
    sale, back, n = F.col("is_completed_sale"), F.col("is_return"), F.col("copies")
    revenue = F.col("line_revenue") * n

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    def distinct(column: str):
        # One light aggregate each; together they would repeat every row.
        present = lines.where(F.col(column).isNotNull()).select(column).distinct()
        return present.agg(F.count(F.lit(1)).alias("n")).scalar()

    # Bounded: batch names are a list held by the driver.
    names = F.array(*[F.lit(name) for name in batch_names])
    present = F.sort_array(F.collect_list("batch"))
    batches = (
        lines.select(C.batch_number().alias("batch"))
        .distinct()
        .agg(F.array_join(F.transform(present, lambda i: F.element_at(names, i + 1)), ",").alias("b"))
        .scalar()
    )
    return data.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
        F.coalesce(F.sum(n - F.col("batches")), F.lit(0)).alias("duplicates_within_batch"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates_across_batches"),
        rows(sale).alias("completed_sales"),
        rows(back).alias("returns_or_cancellations"),
        rows(F.col("customer_id").isNull()).alias("anonymous_rows"),
        rows(F.col("unit_price") <= 0).alias("non_positive_price_rows"),
        rows(F.col("quantity") <= 0).alias("non_positive_quantity_rows"),
        rows(F.col("invoice_date").isNull()).alias("unparseable_date_rows"),
        F.min("invoice_date").alias("minimum_invoice_date"),
        F.max("invoice_date").alias("maximum_invoice_date"),
        C.money(F.sum(revenue)).alias("all_signed_value"),
        C.money(F.sum(F.when(sale, revenue))).alias("completed_sales_value"),
        C.money(F.sum(F.when(back, revenue))).alias("returns_value"),
    ).withColumns(
        {
            "source_batches": batches,
            "countries": distinct("country"),
            "products": distinct("stock_code"),
            "customers": distinct("customer_id"),
            "invoices": distinct("invoice_no"),
        }
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing, percent) of the columns that have gaps, in one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return (
        counted.unpivot(["_rows"], df.columns, "column_name", "missing_count")
        .where("missing_count > 0")
        .select(
            "column_name",
            "missing_count",
            C.rounded_ratio("missing_count", "_rows", 100, 4).alias("missing_pct"),
        )
    )


def contract_failures(classified: DataFrame, batches_needed: int = 2) -> DataFrame:
    """Blocking failures of a raw table, one row each; no rows means it passes."""
    facts = classified.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("invoice_date").alias("dates"),
        F.count("invoice_no").alias("invoices"),
        F.count("stock_code").alias("codes"),
        F.count_if(F.col("is_completed_sale")).alias("sales"),
        F.count_distinct(C.batch_number()).alias("batches"),
    )
    rules = [
        (F.col("n") == 0, "no_rows"),
        (F.col("dates") == 0, "no_parsed_invoice_dates"),
        (F.col("invoices") == 0, "no_invoice_numbers"),
        (F.col("codes") == 0, "no_product_codes"),
        (F.col("sales") == 0, "no_completed_sales"),
        (F.col("batches") < batches_needed, "too_few_batches"),
    ]
    return facts.select(
        F.explode(F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))).alias(
            "failure"
        )
    )


def cleaning_summary(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Counts, values, fences and flags of the cleaning step, one row."""
    kind = F.col("transaction_type")
    sale = kind == C.SALE
    fences = upper_fences(cleaned, FENCED, F.col("is_completed_sale"))
    limits = fences.select(F.struct("*").alias("s")).scalar()
    rows = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = cleaned.agg(
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(sale).alias("completed_sales"),
        F.count_if(kind == C.RETURN).alias("returns_or_cancellations"),
        F.count_if(kind == C.EXCLUDED).alias("excluded_non_sales"),
        F.count_if(sale & F.col("has_customer_id")).alias("customer_sales"),
        F.count_if(sale & ~F.col("has_customer_id")).alias("anonymous_sales"),
        C.money(F.sum(F.when(sale, F.col("line_revenue")))).alias("completed_sales_value"),
        C.money(F.sum(F.when(kind == C.RETURN, F.col("line_revenue")))).alias("returns_value"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer_id_rows"),
        F.count_if(F.col("description").isNull()).alias("missing_description_rows"),
        *[F.count_if(F.col(f"is_{m}_outlier")).alias(f"{m}_outliers") for m in FENCED],
    )
    parts = F.col("completed_sales") + F.col("returns_or_cancellations") + F.col("excluded_non_sales")
    return counted.withColumns(
        {
            "input_rows": rows,
            "exact_duplicates_removed": rows - F.col("unique_rows"),
            "matches_unique_rows": parts == F.col("unique_rows"),
            **{f"{m}_upper": limits[f"{m}_upper"] for m in FENCED},
        }
    )
