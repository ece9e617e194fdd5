"""Quality rules as a bitmask ledger.

One pass over the texts takes all measurements and runs every rule once; the
ledger keeps the measurements and one long with a bit for each rule that failed.
Policies are masks over these bits, so a new policy version, or the effect of
leaving a rule out, needs only the ledger.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mix64, rolled, span_hashes, text_batches, utf8_chunks, word_spans

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_bars", "n_shouts",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: does its key occur again in its text; did it occur before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    joint = mix64(keys ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint, kind="stable")
    same = joint[order[1:]] == joint[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    before[order[1:]] = same
    return again, before


def measure_chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Measurements of the texts in ``data``, one row per text in the order of ``MEASURES``."""
    n = len(offsets) - 1
    out = np.zeros((n, len(MEASURES)), dtype=np.int64)
    if not len(data):
        return out
    starts, ends, counts = word_spans(data, offsets)
    texts = np.repeat(np.arange(n), counts)
    hashes = span_hashes(data, starts, ends)
    # A code point has exactly one byte that is no continuation byte.
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    word_at = np.searchsorted(starts, offsets)
    out[:, 0] = counts
    out[:, 1] = _segment_sums(points[ends] - points[starts], word_at)
    symbol = np.isin(data, _SYMBOLS)
    out[:, 2] = _segment_sums(symbol, offsets)

    # Lines with a word, hashed from the blank-exact bytes between line feeds.
    feed = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    begins = begins[begins < len(data)]
    closes = np.append(begins[1:], len(data))
    closes = closes - (data[closes - 1] == 10)
    worded = np.searchsorted(starts, closes) > np.searchsorted(starts, begins)
    begins, closes = begins[worded], closes[worded]
    if len(begins):
        lines_of = np.searchsorted(offsets, begins, side="right") - 1
        _, before = _repeats(span_hashes(data, begins, closes), lines_of)
        out[:, 3] = np.bincount(lines_of, weights=before, minlength=n)
        out[:, 5] = np.bincount(lines_of, minlength=n)

    triples = rolled(hashes, 3)
    if len(triples):
        inside = texts[:-2] == texts[2:]
        at = np.flatnonzero(inside)
        again, _ = _repeats(triples[at], texts[at])
        covered = np.zeros(len(hashes), dtype=bool)
        for j in range(3):
            covered[at[again] + j] = True
        out[:, 4] = np.bincount(texts, weights=covered, minlength=n)

    upper = (data >= 65) & (data <= 90)
    out[:, 6] = _segment_sums(upper, offsets)
    out[:, 7] = _segment_sums(upper | ((data >= 97) & (data <= 122)), offsets)
    out[:, 8] = _segment_sums(data == 124, offsets)
    out[:, 9] = _segment_sums(data == 33, offsets)
    return out


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; its place in the rule list is its bit."""

    name: str
    fails: str


#: Bits never change their meaning: new rules are appended.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines"),
    Rule("capitals", "n_letters >= 50 and 2 * n_upper > n_letters"),
    Rule("bars", "5 * n_bars > n_words"),
    Rule("shouting", "4 * n_shouts > n_words"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
)
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("too_short", "repeats"),
    "v1": ("too_short", "repeats", "symbols", "bars"),
    "v2": tuple(r.name for r in RULES),
}


def mask(names: Iterable[str], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in set(names))


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` without its text, with the measurements and ``failures``, a long of failure bits.

    Null text: measured as empty. One row per row, repeated rows and null ids
    included. Columns of ``df`` named like a measurement or ``failures`` are
    replaced.
    """
    if len(rules) > 63:
        raise ValueError("a ledger has 63 bits")
    text_batches(df.sparkSession)
    names = {text, "failures", *MEASURES}
    kept = df.select(*[c for c in df.columns if c not in names], text)
    schema = T.StructType([f for f in kept.schema.fields if f.name != text])
    others = list(schema.names)
    for name in MEASURES:
        schema = schema.add(name, "long")

    def run(batches):
        for batch in batches:
            rows = [measure_chunk(data, offsets) for _, data, offsets in utf8_chunks(batch.column(text))]
            values = np.concatenate(rows) if rows else np.zeros((0, len(MEASURES)), np.int64)
            columns = [batch.column(c) for c in others]
            columns += [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *MEASURES])

    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failures = F.lit(0).cast("long")
    for bit in bits:
        failures = failures.bitwiseOR(bit)
    return kept.mapInArrow(run, schema).withColumn("failures", failures)


def failed(failures: Column, policy: Iterable[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a rule of ``policy`` failed."""
    return failures.bitwiseAND(F.lit(mask(policy, rules)).cast("long")) != 0


def ablations(book: DataFrame, policy: Iterable[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of ``policy``: rows it fails, rows only it fails, rows kept without it.

    One aggregation over the failure bits; the texts are not read again.
    """
    policy = [r.name for r in rules if r.name in set(policy)]
    if not policy:
        return book.sparkSession.createDataFrame([], "rule string, failed long, alone long, kept_without long")
    held = F.col("failures").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    by_mask = book.groupBy(held.alias("held")).agg(F.count("*").alias("n"))
    sums = []
    for name in policy:
        bit = mask([name], rules)
        has = F.col("held").bitwiseAND(F.lit(bit).cast("long")) != 0
        alone = F.col("held") == bit
        zero = F.col("held") == 0
        count = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (has, alone, alone | zero)]
        sums.append(F.struct(F.lit(name).alias("rule"), *[c.alias(a) for c, a in zip(count, ("failed", "alone", "kept_without"))]))
    return by_mask.agg(F.array(*sums).alias("all")).select(F.inline("all"))
