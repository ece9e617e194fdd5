"""Scans: several raw batches into one canonical table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import columns as C
from basketry.schema import IDENTITY, MONEY, QUANTITY, header_map
from basketry.session import pin


def rename_to_canonical(df: DataFrame) -> DataFrame:
    """Keep the canonical columns only, under their canonical names."""
    names = header_map(df.columns)
    by_target = {target: raw for raw, target in names.items()}
    return df.select(*[F.col(f"`{by_target[c]}`").alias(c) for c in IDENTITY])


def coerce_types(df: DataFrame, date_formats: list[str] | None = None) -> DataFrame:
    """Bad numbers and dates become null; nothing is dropped or rounded.

    Dates are ISO text, or text in one of ``date_formats`` (the first that fits).
    """
    formats = [F.try_to_timestamp(F.col("invoice_date").cast("string"), F.lit(f)) for f in date_formats or ()]
    date = F.col("invoice_date").try_cast(T.TimestampNTZType())
    if formats:
        date = F.coalesce(date, *[f.cast(T.TimestampNTZType()) for f in formats])
    return df.withColumns(
        {
            "quantity": F.col("quantity").try_cast(QUANTITY),
            "invoice_date": date,
            "unit_price": F.col("unit_price").try_cast(MONEY),
        }
    )


def tidy_strings(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "invoice_no": C.strip(F.col("invoice_no").cast("string")),
            "stock_code": C.strip(F.col("stock_code").cast("string")),
            "description": C.tidy_text(F.col("description").cast("string")),
            "customer_id": C.id_text("customer_id"),
            "country": C.strip(F.col("country").cast("string")),
        }
    )


def standardise(
    df: DataFrame, ordinal: Column | None = None, batch: int = 0, date_formats: list[str] | None = None
) -> DataFrame:
    """One raw batch as canonical lines with their load position.

    ``ordinal`` is the position of the row inside its batch. The default numbers
    rows by partition, which is only stable for frames that are; batches read
    from files are numbered by ``scan_batches``.
    """
    ordinal = F.monotonically_increasing_id() if ordinal is None else ordinal
    names = header_map(df.columns)
    by_target = {target: raw for raw, target in names.items()}
    canonical = df.select(
        *[F.col(f"`{by_target[c]}`").alias(c) for c in IDENTITY],
        C.load_position(batch, ordinal).alias("load_seq"),
    )
    return coerce_types(tidy_strings(canonical), date_formats)


def _each_batch(batches: dict, one) -> DataFrame:
    if not batches:
        raise ValueError("No transaction batches were given.")
    parts = []
    for index, (name, raw) in enumerate(batches.items()):
        try:
            parts.append(one(index, name, raw))
        except ValueError as error:
            raise ValueError(f"Invalid schema in batch '{name}': {error}") from error
    return reduce(DataFrame.unionByName, parts)


def union_batches(
    batches: dict[str, DataFrame], ordinal: str | None = None, date_formats: dict[str, list[str]] | None = None
) -> DataFrame:
    """Standardise every batch, number it by its place in the dict, and union."""
    formats = date_formats or {}

    def one(index: int, name: str, raw: DataFrame) -> DataFrame:
        position = F.col(ordinal).cast("long") if ordinal else None
        return standardise(raw, position, index, formats.get(name))

    return _each_batch(batches, one)


_ROW_MASK = (1 << 33) - 1


def scan_batches(
    spark: SparkSession, paths: dict[str, str], fmt: str = "csv",
    date_formats: dict[str, list[str]] | None = None, **options,
) -> DataFrame:
    """Read one path per batch, once, and number its rows by file name, place of the block, and row.

    CSV columns stay text until they are coerced. The typed lines are written to
    the shared folder, so raw text is parsed a single time. A row's position is
    the number of rows in the blocks before its own, plus its row in the block;
    the sums run over one row per block, so the numbers are the same however the
    files are split.
    """
    if fmt == "csv":
        options = {"header": True, "inferSchema": False, **options}
    formats = date_formats or {}

    def one(index: int, name: str, path: str) -> DataFrame:
        raw = spark.read.format(fmt).options(**options).load(path)
        by_target = {target: header for header, target in header_map(raw.columns).items()}
        placed = raw.select(
            *[F.col(f"`{by_target[c]}`").alias(c) for c in IDENTITY],
            F.lit(index).alias("_batch"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id"),
        )
        return coerce_types(tidy_strings(placed), formats.get(name))

    lines = pin(_each_batch(paths, one), wide=True)
    row = F.col("_id").bitwiseAND(F.lit(_ROW_MASK))
    split = ["_batch", "_file", "_block"]
    blocks = lines.groupBy(*split).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per block of a file.
    before = Window.partitionBy("_batch").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.col("_before") + row - F.col("_first")
    return lines.join(offsets, split).select(
        *IDENTITY, C.load_position(F.col("_batch"), position).alias("load_seq")
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a stated schema; select from the result to prune columns."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json_summary(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)
