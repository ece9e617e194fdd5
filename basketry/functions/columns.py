"""Column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.schema import BATCH_STEP, LOAD_SEQ, MONEY, REVENUE

SALE = "completed_sale"
RETURN = "return_or_cancellation"
EXCLUDED = "excluded_non_sale"

# Upper bounds of the effect-size bands.
EFFECT_BANDS = ((0.1, "negligible"), (0.3, "small"), (0.5, "moderate"))

# Fixed values.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def strip(c) -> Column:
    """Trim every kind of white space; Spark's own trim knows only the blank."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tidy_text(c) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def id_text(c) -> Column:
    """Drop a float tail from an id, then trim; a blank id stays a value."""
    return strip(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""))


def id_or_null(c) -> Column:
    """Trim, drop a float tail, and treat a blank id as missing."""
    return F.nullif(F.regexp_replace(strip(F.col(c).cast("string")), r"\.0$", ""), F.lit(""))


def amount_text(c) -> Column:
    """Currency text to a number, 0 when it is not one."""
    bare = strip(F.regexp_replace(F.col(c).cast("string"), r"[,£]|GBP", ""))
    return F.coalesce(bare.try_cast("double"), F.lit(0.0))


def line_revenue() -> Column:
    return (F.col("quantity") * F.col("unit_price")).cast(REVENUE)


def is_cancelled() -> Column:
    return F.coalesce(F.upper("invoice_no").startswith("C"), F.lit(False))


def is_return() -> Column:
    return F.coalesce(is_cancelled() | (F.col("quantity") < 0), F.lit(False))


def is_completed_sale() -> Column:
    return F.coalesce(
        ~is_cancelled() & (F.col("quantity") > 0) & (F.col("unit_price") > 0), F.lit(False)
    )


def transaction_type() -> Column:
    return (
        F.when(F.col("is_completed_sale"), SALE)
        .when(F.col("is_return"), RETURN)
        .otherwise(EXCLUDED)
    )


def exclusion_reason() -> Column:
    """Why a line is neither sale nor return; null for sales and returns."""
    reason = (
        F.when(F.col("invoice_no").isNull(), "missing_invoice")
        .when(F.col("quantity") <= 0, "non_positive_quantity")
        .when(F.col("unit_price") <= 0, "non_positive_price")
        .otherwise("other_invalid_non_sale")
    )
    return F.when(~F.col("is_completed_sale") & ~F.col("is_return"), reason)


def year_month(c) -> Column:
    """``yyyy-MM`` of a date; put together from numbers, since formatting takes several times as long."""
    plain = F.concat(F.year(c), F.when(F.month(c) < 10, "-0").otherwise("-"), F.month(c))
    return F.when(F.year(c).between(1000, 9999), plain).otherwise(F.date_format(c, "yyyy-MM"))


def date_parts(c: str = "invoice_date") -> dict[str, Column]:
    return {
        "invoice_day": F.to_date(c),
        "year": F.year(c),
        "quarter": F.quarter(c),
        "month": F.month(c),
        "year_month": year_month(c),
        "day_of_month": F.dayofmonth(c),
        "day_of_week": F.try_element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(c) + 1),
        "hour": F.hour(c),
    }


def date_key(c) -> Column:
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def month_start(c) -> Column:
    return F.trunc(c, "MM")


def months_between_starts(later, earlier) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def ratio(num, den, scale: float = 1.0) -> Column:
    """``scale * num / den`` in double precision, null when ``den`` is 0."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    top = num.cast("double")
    if scale != 1.0:
        top = F.lit(float(scale)) * top
    return F.try_divide(top, den.cast("double"))


def rounded_ratio(num, den, scale: int = 1, digits: int = 2) -> Column:
    """Ratio of exact numbers rounded half up as a decimal, given as double."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    top = num.cast("decimal(30,4)") * F.lit(scale)
    return F.round(F.try_divide(top, den.cast("decimal(28,4)")), digits).cast("double")


def money(c) -> Column:
    """Exact decimal to the double of the output edge."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def effect_magnitude(c) -> Column:
    size = F.abs(c)
    out = None
    for bound, name in EFFECT_BANDS:
        out = F.when(size < bound, name) if out is None else out.when(size < bound, name)
    return out.otherwise("large")


def geography(c, home: str) -> Column:
    return F.when(F.col(c) == home, home).otherwise("International")


def weekday_order(c) -> Column:
    """Position of an English weekday name, Monday first."""
    return F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col(c)).cast("int")


def partial_month(month_label, last_day) -> Column:
    """True for the month of ``last_day`` when the data stop before its end."""
    return (month_label == F.date_format(last_day, "yyyy-MM")) & (last_day < F.last_day(last_day))


def load_position(batch, position) -> Column:
    """Load position of row ``position`` of batch number ``batch``."""
    batch = batch if isinstance(batch, Column) else F.lit(batch)
    return (batch.cast(LOAD_SEQ) * F.lit(Decimal(BATCH_STEP)) + position.cast(LOAD_SEQ)).cast(LOAD_SEQ)


def batch_number(c: str = "load_seq") -> Column:
    return F.expr(f"CAST({c} div CAST({BATCH_STEP} AS DECIMAL(38,0)) AS INT)")


def place_in_batch(c: str = "load_seq") -> Column:
    return (F.col(c) % F.lit(Decimal(BATCH_STEP))).cast("long")


def batch_name(names: list[str], c: str = "load_seq") -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), batch_number(c) + 1)


#: What most prices fit into, with all their digits.
SHORT_MONEY = T.DecimalType(18, 4)


def narrowed(lines) -> tuple[dict[str, Column], dict[str, Column]]:
    """For lines in a shuffle: columns that take the place of wide decimals, and what gives these back, by name.

    A wide decimal takes some 24 bytes. A price goes in 8 where that is all of it,
    and a revenue only where it is not quantity times price.
    """
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    sent, back = {}, {}
    if kinds.get("unit_price") == MONEY:
        price, short = F.col("unit_price"), F.col("unit_price").try_cast(SHORT_MONEY)
        whole = short.try_cast(MONEY).eqNullSafe(price)
        sent |= {"_short_price": F.when(whole, short), "_price": F.when(~whole, price)}
        back["unit_price"] = F.coalesce(F.col("_short_price").try_cast(MONEY), F.col("_price"))
    if "unit_price" in back and "quantity" in kinds and kinds.get("line_revenue") == REVENUE:
        def product(price: Column) -> Column:
            return F.try_multiply(F.col("quantity"), price).try_cast(REVENUE)

        own = ~product(F.col("unit_price")).eqNullSafe(F.col("line_revenue"))
        sent |= {"_own_revenue": own, "_revenue": F.when(own, F.col("line_revenue"))}
        back["line_revenue"] = F.when(F.col("_own_revenue"), F.col("_revenue")).otherwise(product(back["unit_price"]))
    return sent, back
