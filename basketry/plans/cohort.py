"""Monthly acquisition cohorts, their retention, and the flow of customers between months.

A customer's history is a bitmap of active months, built by one aggregate over
the lines. Cohorts, retention and re-activation are read off these bits; equal
histories are counted once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import columns as C

#: Months in one word of a bitmap.
WORD = 60


def _number(day) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _month(number) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))


def _active(months: str, place: str) -> Column:
    """Whether the bit of a month is set; months before the first word have none."""
    return F.expr(f"{place} >= 0 AND (shiftright(get({months}, CAST({place} DIV {WORD} AS INT)), CAST({place} % {WORD} AS INT)) & 1L) = 1L")


@dataclass(frozen=True)
class Histories:
    """``first, months, customers``: equal bitmaps and how many customers have them; months count from ``base``."""

    table: DataFrame
    base: int
    last: int
    last_day: object


def customer_bitmaps(identified: DataFrame, base: int, last: int) -> DataFrame:
    """``customer_id, first, months``: words of bits, one bit a month from ``base`` on.

    Lines combine on the map side, so a customer with a third of all lines
    sends one row a task.
    """
    place = (_number("invoice_date") - base).alias("place")
    lines = identified.select("customer_id", place).where(F.col("place").isNotNull())
    words = range((last - base) // WORD + 1)
    bits = [F.expr(f"bit_or(CASE WHEN place DIV {WORD} = {w} THEN shiftleft(1L, CAST(place % {WORD} AS INT)) ELSE 0L END)") for w in words]
    return lines.groupBy("customer_id").agg(F.min("place").alias("first"), F.array(*bits).alias("months"))


def histories(identified: DataFrame) -> Histories:
    """The width of the bitmaps is the data's number of months, so one row is read first."""
    ends = identified.agg(
        F.min(_number("invoice_date")).alias("base"), F.max(_number("invoice_date")).alias("last"),
        F.to_date(F.max("invoice_date")).alias("day"),
    ).first()
    base = ends["base"] or 0
    last = base if ends["last"] is None else ends["last"]
    table = customer_bitmaps(identified, base, last).groupBy("first", "months").agg(F.count(F.lit(1)).alias("customers"))
    return Histories(table, base, last - base, ends["day"])


def _observable(found: Histories) -> DataFrame:
    """A row per history and month from its first to the data's last."""
    return found.table.select("*", F.explode(F.sequence(F.col("first"), F.lit(found.last))).alias("place"))


def cohort_long(identified: DataFrame) -> DataFrame:
    """Acquisition month x observable month: active customers and retention.

    An observable month without buyers is 0; months that lie after the data are
    absent.
    """
    found = histories(identified)
    active = F.coalesce(F.sum(F.when(_active("months", "place"), F.col("customers"))), F.lit(0))
    counted = _observable(found).groupBy("first", "place").agg(active.alias("active_customers"), F.sum("customers").alias("cohort_size"))
    months = counted.withColumns({"acquisition_month": _month(F.col("first") + found.base), "purchase_month": _month(F.col("place") + found.base)})
    last_day = F.lit(found.last_day).cast("date")
    return months.select(
        "acquisition_month",
        "purchase_month",
        (F.col("place") - F.col("first")).alias("cohort_month_index"),
        "cohort_size",
        "active_customers",
        C.rounded_ratio("active_customers", "cohort_size", 100).alias("retention_pct"),
        C.partial_month(F.date_format("purchase_month", "yyyy-MM"), last_day).alias("is_partial_period"),
    )


def customer_flow(identified: DataFrame) -> DataFrame:
    """Per month: active customers, and the new, retained, re-activated and lapsed ones.

    Retained were active in the month before too; re-activated bought earlier
    but not in the month before; lapsed were active in the month before only.
    A month without buyers counts as any other.
    """
    found = histories(identified)
    now, before, first = _active("months", "place"), _active("months", "(place - 1)"), F.col("place") == F.col("first")

    def people(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("customers"))), F.lit(0))

    flow = _observable(found).groupBy("place").agg(
        people(now).alias("active_customers"),
        people(first).alias("new_customers"),
        people(now & before).alias("retained_customers"),
        people(now & ~before & ~first).alias("reactivated_customers"),
        people(~now & before).alias("lapsed_customers"),
    )
    return flow.select(_month(F.col("place") + found.base).alias("month_start"), *[c for c in flow.columns if c != "place"])


def widen(long: DataFrame, value: str) -> DataFrame:
    """Matrix with month_0..month_N; cells after the data stay null.

    The width is the data's number of months, so one value is read first.
    """
    top = long.agg(F.max("cohort_month_index")).first()[0]
    width = 0 if top is None else top + 1
    labelled = long.select(
        F.date_format("acquisition_month", "yyyy-MM").alias("acquisition_month"),
        F.concat(F.lit("month_"), F.col("cohort_month_index").cast("string")).alias("_index"),
        value,
    )
    return (
        labelled.groupBy("acquisition_month")
        .pivot("_index", [f"month_{i}" for i in range(width)])
        .agg(F.max(value))
    )


def cohort_metadata(long: DataFrame) -> DataFrame:
    return long.agg(
        F.count_distinct("acquisition_month").alias("acquisition_months"),
        F.date_format(F.min("acquisition_month"), "yyyy-MM").alias("first_acquisition_month"),
        F.date_format(F.max("purchase_month"), "yyyy-MM").alias("latest_purchase_month"),
        F.max("cohort_month_index").alias("max_cohort_month_index"),
        F.date_format(
            F.max(F.when(F.col("is_partial_period"), F.col("purchase_month"))), "yyyy-MM"
        ).alias("partial_month"),
    )


def retention_curve(long: DataFrame) -> DataFrame:
    """Mean retention by month index, per acquisition year."""
    return long.groupBy(
        F.year("acquisition_month").alias("acquisition_year"), "cohort_month_index"
    ).agg(
        F.count(F.lit(1)).alias("cohorts"),
        C.ratio(
            F.sum(F.col("retention_pct").cast("decimal(9,2)")), F.count(F.lit(1))
        ).alias("mean_retention_pct"),
    )
