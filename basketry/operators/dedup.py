"""Duplicates and latest-record picks by aggregation.

Copies are combined on the map side, so a line repeated in a third of all rows
costs one row per map task and never gathers in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import batch_number
from basketry.schema import IDENTITY


def drop_exact_copies(df: DataFrame, given: list[str] | None = None) -> DataFrame:
    """One row per identity, keeping the load position of the first copy.

    Nulls are equal. The batch of the survivor follows from its ``load_seq``.
    ``given`` names further columns whose values the identity determines: rows
    that already lie together by them, as after a join on them, are not shuffled again.
    """
    return df.groupBy(*(given or []), *IDENTITY).agg(F.min("load_seq").alias("load_seq")).select(*IDENTITY, "load_seq")


def copies_by_identity(df: DataFrame, batches: int) -> DataFrame:
    """Distinct lines with the number of their copies and of the batches that hold one.

    One shuffle: the batches of a line are bits of longs, 63 to each, so that
    copies combine on the map side in a plain hash aggregate.
    """
    number, words = batch_number(), range(0, max(batches, 1), 63)
    one = F.lit(1).cast("long")
    bits = [F.when(number.between(w, w + 62), F.call_function("shiftleft", one, number - w)) for w in words]
    held = [F.bit_or(bit).alias(f"_held{i}") for i, bit in enumerate(bits)]
    counted = df.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("copies"), *held)
    counts = [F.coalesce(F.bit_count(f"_held{i}"), F.lit(0)) for i in range(len(held))]
    total = sum(counts[1:], counts[0])
    return counted.select(*IDENTITY, "copies", total.cast("long").alias("batches"))


def latest_text(
    df: DataFrame, keys: list[str], text: str, when: str, default: str | None = None
) -> DataFrame:
    """Text of the newest row per key; the greatest text wins at one instant.

    Collapsing to (key, text) first keeps the heavy step a hash aggregate over
    fixed-width buffers; the newest-pick then sees distinct texts only.
    """
    newest = df.groupBy(*keys, text).agg(F.max(when).alias("_newest"))
    picked = newest.groupBy(*keys).agg(
        F.max_by(F.struct(text), F.struct("_newest", text))[text].alias(text)
    )
    if default is not None:
        picked = picked.withColumn(text, F.coalesce(text, F.lit(default)))
    return picked


def most_common(df: DataFrame, key: str, value: str, out: str, default: str) -> DataFrame:
    """Most frequent non-null value per key, the lowest one on ties."""
    counts = df.groupBy(key, value).agg(F.count(value).alias("_count"))
    ranked = counts.groupBy(key).agg(
        F.min(F.struct((-F.col("_count")).alias("_neg"), F.col(value))).alias("_best")
    )
    return ranked.select(key, F.coalesce(F.col("_best")[value], F.lit(default)).alias(out))
