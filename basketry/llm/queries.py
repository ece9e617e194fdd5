"""Registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, mixing, neardup, packing, pseudo, quality, rules, spelling, substrings, toxicity, turns, urls, warc
from .shared import table


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of 2048 words over all documents."""
    return packing.pack(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.judged(docs, table(spark, folder, "labels"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.archived(pages).select(*columns)


def op4_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: every hundredth id, against all rows."""
    return ann.search(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    book = rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.failed(F.col("failures"), rules.POLICIES["base"]).alias("base_failed"),
        (~rules.failed(F.col("failures"), rules.POLICIES["v2"])).alias("kept"),
    )


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


def op7_minmax_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, neardup.NearDuplicates(shingle=2)).drop("repeats")


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: Host rules of the contract, then word rules for the urls that none of them fits.
URL_RULES = [
    urls.host_rule("allow", "org", "/"),
    urls.host_rule("block", "example.org", "/es/"),
    urls.host_rule("block", "example.org", "/en/1"),
    urls.host_rule("allow", "com", "/fr/"),
    urls.host_rule("block", "com", "/de/"),
    *[urls.word_rule("block", w) for w in ("casino", "porn", "viagra", "xxx")],
]


def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.judge_urls(pages, URL_RULES)
    host_rules = F.col("rule").isin([r.name for r in URL_RULES if r.weight])
    return judged.select("page_id", "host", "path", F.when(host_rules, F.col("rule")).alias("rule"), "verdict")


def op10_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo.pseudo_likelihood(table(spark, folder, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations, repaired."""
    rows = table(spark, folder, "conversations")
    return turns.repaired_conversations(rows, turns.damaged(rows))


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judged(docs, table(spark, folder, "labels"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_warc, op4_learned_partitions, op5_quality_rules, op6_substring_dedup,
        op7_minmax_near_duplicates, op8_source_mixing, op9_url_filters, op10_pseudo_likelihood, op11_conversation_repair,
        op12_quality, op13_spelling_variants,
    )
}
