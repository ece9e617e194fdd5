"""Corpus preparation in five stages, each an operator of ``basketry.llm`` over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.mixing import mixed_documents
from basketry.llm.neardup import NearDuplicates, without_near_duplicates
from basketry.llm.packing import pack
from basketry.llm.shared import pinned, remove, table
from basketry.llm.substrings import without_repeats
from basketry.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below 0.5."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by runs of five words at a similarity of 0.8."""
    return without_near_duplicates(docs, NearDuplicates(shingle=5, percent=80))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier; ``n_chars`` follows the text."""
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return without_repeats(docs).withColumn("n_chars", length).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]
#: The toxicity scores and the random choices of the mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder for the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = pinned(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        before = path
    return docs
