"""Sinks, output gates, and the five datasets of the cleaned table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.columns import EXCLUDED, RETURN, SALE


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("dateFormat", "yyyy-MM-dd")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_json_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def datasets(lines: DataFrame) -> dict[str, DataFrame]:
    """The five overlapping datasets as filters over one table, not as copies.

    Over a table partitioned by ``transaction_type`` each reads its own
    directory only.
    """
    kind = F.col("transaction_type")
    return {
        "completed_sales": lines.where(kind == SALE),
        "returns": lines.where(kind == RETURN),
        "excluded_records": lines.where(kind == EXCLUDED),
        "customer_sales": lines.where((kind == SALE) & F.col("has_customer_id")),
        "anonymous_sales": lines.where((kind == SALE) & ~F.col("has_customer_id")),
    }


def written_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and size of the data files in a folder, on whatever file system the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), int(s.getLen())) for s in fs.listStatus(target) if s.isFile()]
    return sorted(f for f in found if f[0][0] not in "_.")


def size_report(spark: SparkSession, paths: dict[str, str], limit: int | None = None) -> DataFrame:
    """One row per written file, and one with the total: bytes, limit, passed.

    ``limit`` is the largest file the receiver takes, in bytes; without one
    every row passes. The total has no limit.
    """
    rows = [(n, f, size) for n, p in paths.items() for f, size in written_files(spark, p)]
    rows = [(*r, limit, limit is None or r[2] < limit) for r in rows]
    rows.append(("total", None, sum(r[2] for r in rows), None, True))
    return spark.createDataFrame(rows, "table string, file string, bytes long, limit_bytes long, passed boolean")


def write_bundle(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write every table as CSV; the folder of each."""
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, df in tables.items():
        write_csv(df, paths[name])
    return paths


def swap_in(spark: SparkSession, fresh: str, final: str) -> None:
    """Put a finished folder in the place of an earlier one, which goes only after that."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(final)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{final}.{uuid.uuid4().hex}.old")
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, aside):
        raise RuntimeError(f"Could not move {final} aside.")
    moved = False
    try:
        fs.mkdirs(target.getParent())
        moved = fs.rename(source, target)
        if not moved:
            raise RuntimeError(f"Could not move {fresh} to {final}.")
    finally:
        if replaced and moved:
            fs.delete(aside, True)
        elif replaced:
            fs.rename(aside, target)
