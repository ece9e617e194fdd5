"""Transaction lines derived from a TPC-H-like set of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.schema import IDENTITY, MONEY, QUANTITY

BATCHES = ["batch_1", "batch_2"]
HOME = "NATION_0"
#: Given by ``invoice_no``; the lines lie by it where orders are too many to broadcast.
ORDER_KEY = "l_orderkey"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    # No join hints: file sizes let Catalyst broadcast the small tables and
    # shuffle the large ones, and AQE splits hot keys of the latter. Buyers are
    # looked up for orders, of which there are fewer and narrower than lines.
    # Orders come last, so that the lines lie by order when they are de-duplicated.
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    bills = (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return (
        table(spark, folder, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(bills, F.col("l_orderkey") == F.col("o_orderkey"))
    )


def transaction_lines(spark: SparkSession, folder: str, keep: list[str] | None = None) -> DataFrame:
    """The 8 identity columns and ``load_seq``, already typed; with ``keep`` also these columns of the tables."""
    returned = F.col("l_returnflag") == "R"
    free = (F.col("l_returnflag") == "A") & (F.col("l_tax") >= 0.08)
    batch = F.when(F.year("o_orderdate") < 1998, 0).otherwise(1).cast("long")
    return _joined(spark, folder).select(
        F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias(
            "invoice_no"
        ),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stock_code"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("p_name")).alias("description"),
        (F.when(returned, -1).otherwise(1) * F.col("l_quantity").cast("int")).cast(QUANTITY).alias("quantity"),
        F.col("o_orderdate").alias("invoice_date"),
        F.when(free, F.lit(0)).otherwise(F.col("p_retailprice")).cast(MONEY).alias("unit_price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string")).alias(
            "customer_id"
        ),
        F.col("n_name").alias("country"),
        C.load_position(batch, F.col("l_linenumber")).alias("load_seq"),
        *(keep or []),
    )


def raw_batches(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The same lines as untidy text under raw headers, one table per batch."""
    lines = transaction_lines(spark, folder)
    code = F.substring("stock_code", 2, 20).cast("long")
    text = lines.select(
        F.concat(F.lit("  "), "invoice_no", F.lit("\t")).alias("Invoice"),
        F.concat(F.lit(" "), "stock_code").alias("StockCode"),
        F.concat(F.lit(" "), F.replace("description", F.lit(" "), F.lit("  ")), F.lit(" ")).alias(
            "Description"
        ),
        F.when(code % 97 == 0, "n/a").otherwise(F.col("quantity").cast("int").cast("string")).alias("Quantity"),
        F.when(code % 89 == 0, "not a date")
        .otherwise(F.date_format("invoice_date", "yyyy-MM-dd HH:mm"))
        .alias("InvoiceDate"),
        F.when(code % 83 == 0, "free").otherwise(F.col("unit_price").cast("decimal(18,4)").cast("string")).alias("Price"),
        F.concat("customer_id", F.lit(".0")).alias("Customer ID"),
        F.concat("country", F.lit(" ")).alias("Country"),
        F.lit("ignored").alias("Remark"),
        C.place_in_batch().alias("line_no"),
        C.batch_number().alias("_batch"),
    )
    return {
        name: text.where(F.col("_batch") == i).drop("_batch") for i, name in enumerate(BATCHES)
    }


def overlapping_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The lines once, and the early lines again as a third batch of copies."""
    lines = transaction_lines(spark, folder)
    again = lines.where(F.col("invoice_date") < F.lit("1997-01-01").cast("timestamp"))
    third = C.load_position(2, C.place_in_batch())
    return lines.unionByName(again.withColumn("load_seq", third)).select(*IDENTITY, "load_seq")


def event_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The event table in the shape of sale lines, for hours and outliers."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("invoice_no"),
        "event_type",
        F.col("ts").alias("invoice_date"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("value").cast("decimal(18,4)").alias("line_revenue"),
    )
