from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.plans import star
from basketry.schema import MONEY, REVENUE
from basketry.session import Stage, pin

SCHEMA = (
    "transaction_line_id long, invoice_no string, stock_code string, invoice_date timestamp_ntz, customer_id string, country string, "
    f"quantity decimal(18,4), unit_price {MONEY.simpleString()}, line_revenue {REVENUE.simpleString()}"
)


def lines_of(spark):
    """Prices of few and of many digits, missing ones, and revenues that are not the product."""
    values = [("2", "5.25", "10.5"), ("2", "0.000000000001", "0"), ("3", "1234567890123456.123456789012", None), (None, "1", "7"),
              ("1", None, None), ("-1", "2", "-2"), ("2", "3", None), ("2", "3", "6.0000001"), ("99999999999999", "9999999999999999", "1")]
    number = lambda v: None if v is None else Decimal(v)
    rows = [(i, f"{i}", f"A{i % 3}", None, f"{i % 2}", "X", *map(number, v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_narrowed_lines_come_back_whole(spark):
    lines = lines_of(spark)
    sent, back = C.narrowed(lines)
    there = lines.withColumns(sent).drop(*back)
    got = there.select(*[back.get(c, F.col(c)).alias(c) for c in lines.columns])
    assert got.schema == lines.schema and sorted(got.collect()) == sorted(lines.collect())
    assert there.where("_price IS NOT NULL").count() == 3 and there.where("_own_revenue").count() == 5
    assert C.narrowed(lines.select("quantity")) == ({}, {})


def test_wide_decimals_stay_out_of_the_look_ups(spark):
    """Keys are found for narrow lines, and the lines come back as they were."""
    lines = lines_of(spark)
    dims = {
        "dim_country": spark.createDataFrame([("X", 1)], "country_name string, country_key long"),
        "dim_product": spark.createDataFrame([("A1", 1), ("A2", 2)], "stock_code string, product_key long"),
        "dim_customer": spark.createDataFrame([("0", 5)], "customer_id string, customer_key long"),
    }
    keyed = star.with_keys(lines, dims)
    assert keyed.columns == [*lines.columns, "country_key", "date_key", "product_key", "customer_key"]
    assert sorted(keyed.select(*lines.columns).collect()) == sorted(lines.collect())
    assert {(r["stock_code"], r["product_key"]) for r in keyed.collect()} == {("A0", 0), ("A1", 1), ("A2", 2)}
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    sent = [line for line in plan.splitlines() if "_lookup#" in line and "Project [" in line]
    assert len(sent) >= 3 and not any(re.search(r"[\[ ](unit_price|line_revenue)#\d+[,\]]", line) for line in sent)


def test_tables_between_steps_are_packed(spark, tmp_path):
    df = spark.range(10).select("id", F.col("id").cast("string").alias("s"))
    held = [*pin(df, wide=True).inputFiles(), *Stage(spark).table(("x", "y"), lambda: df).inputFiles()]
    assert held and all(".zstd." in f for f in held)
