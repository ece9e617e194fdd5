"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letters.

A word is the binary vector of its letter multiset: one place per letter and
occurrence. An insertion or deletion of a letter changes one place, a
replacement two, so near words lie within a Hamming distance of two. The places
are dealt into ``PARTS`` parts; at most two parts then differ, and for every way
of leaving two parts out the letters of the other parts are a signature. Near
words share at least one of them.

Words of few syllables are often anagrams of each other, and signatures alone
would join these. One edit also leaves the first or the second half of the
shorter word in place, so each signature is refined by either half. Words that
share a refined signature are joined and verified letter by letter. A signature
of more than ``BUCKET`` words is not joined as a whole: its words meet by their
forms with one letter left out, of which a group is bounded by the alphabet.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64, pinned, remove, text_batches

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run of a document in ``SLIP`` loses a letter.
SLIP = 199
PARTS, DIFFERING, BUCKET = 4, 2, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 2**64)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """``key, run`` for every maximal run of at least ``least`` letters, A to Z in lower case; null text: none."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))
    return docs.select(F.col(key).alias("key"), found.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def slipped(key: Column, run: Column, slip: int = SLIP) -> Column:
    """``run``, without one letter where the checksum of key and run says so; a null key counts as empty text."""
    check = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(check, F.length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(check % slip == 0, short).otherwise(run)


def vocabulary(words: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words with at least ``least`` letters and ``count`` occurrences."""
    counted = words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= count)


# Signatures ---------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n, base, dtype=np.uint64))
    return out


def signatures(words: list[str], parts: int = PARTS, differing: int = DIFFERING) -> np.ndarray:
    """Keys of each word, one row per word: signatures refined by a half.

    Keys are 64-bit hashes: a collision costs a comparison, no result.
    """
    length = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), length)
    first = np.cumsum(length) - length

    # Places of the binary vector: (letter, how many of it came before in the word).
    order = np.lexsort((flat, owner))
    letter, of = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (letter[1:] != letter[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(new)
    nth = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
    place = mix64((letter.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64)) * _ODD + _ODD)
    part = mix64(place + _ODD) % np.uint64(parts)
    sums = np.zeros((len(words), parts), dtype=np.uint64)
    for p in range(parts):
        chosen = np.append(np.where(part == p, place, np.uint64(0)), np.uint64(0))
        sums[:, p] = np.add.reduceat(chosen, first) if len(words) else 0

    # Hashes of stretches from prefix sums, moved to power 0.
    most = int(length.max(initial=0))
    up, down = _powers(_BASE, most), _powers(_BACK, most)
    within = np.arange(len(flat)) - np.repeat(first, length)
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(mix64(flat.astype(np.uint64) * _ODD) * up[within], out=total[1:])

    def stretch(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return (total[first + to] - total[first + at]) * down[at]

    halves = []
    for shorter in (length, length - 1):  # of the two words of a pair
        half = shorter // 2
        kind = shorter.astype(np.uint64) * np.uint64(2)
        halves.append(mix64(stretch(np.zeros_like(half), half) + mix64(kind * _ODD)))
        halves.append(mix64(stretch(length - (shorter - half), length) + mix64((kind + np.uint64(1)) * _ODD)))

    keys = []
    for i, kept in enumerate(combinations(range(parts), parts - differing)):
        signature = mix64(sums[:, kept].sum(axis=1, dtype=np.uint64) + np.uint64((i + 1) * int(_ODD) % 2**64))
        keys += [mix64(signature + half) for half in halves]
    return np.stack(keys, axis=1)


def signed(words: DataFrame) -> DataFrame:
    """``word, n, sig``: one row per word and signature."""

    def run(batches):
        for batch in batches:
            keys = signatures(batch.column("word").to_pylist())
            flat = pa.array(keys.ravel().view(np.int64))
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
            lists = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), lists], names=["word", "n", "sigs"])

    listed = words.select("word", "n").mapInArrow(run, "word string, n long, sigs array<long>")
    return listed.select("word", "n", F.explode("sigs").alias("sig"))


# Near words ---------------------------------------------------------------------


def _meet(rows: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of near words that agree in ``on``."""
    left = rows.select(*on, F.col("word").alias("u"), F.col("n").alias("nu"))
    right = rows.select(*on, F.col("word").alias("v"), F.col("n").alias("nv"))
    lengths = F.abs(F.length("u") - F.length("v")) <= 1
    met = left.join(right, on).filter((F.col("u") < F.col("v")) & lengths)
    return met.filter(F.levenshtein("u", "v", 1) == 1).select("u", "nu", "v", "nv")


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, list[str]]:
    """``u, nu, v, nv`` for all pairs of words (``word, n``; words unique) with exactly one edit between them, ``u < v``.

    Also returns the paths that the rows are kept at.
    """
    signs, signs_path = pinned(signed(words), "signatures")
    sizes = signs.groupBy("sig").agg(F.count("*").alias("size")).filter("size > 1")
    shared, shared_path = pinned(signs.join(sizes, "sig"), "shared-signatures")
    few = _meet(shared.filter(F.col("size") <= bucket), ["sig"])
    # From here on groups are words that one letter turns into the same form.
    without = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    hot = shared.filter(F.col("size") > bucket).withColumn("at", F.explode(F.expr("sequence(0, length(word))")))
    many = _meet(hot.withColumn("form", without).drop("at").distinct(), ["sig", "form"])
    pairs, path = pinned(few.unionByName(many).distinct(), "near-words")
    for done in (signs_path, shared_path):
        remove(words.sparkSession, done)
    return pairs, [path]


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word its ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    ``words`` holds ``word, n`` with unique words. The form is the near word of
    largest ``n``, on ties the least in code-point order, if it has at least
    ``ratio`` times the word's ``n``. Counts grow with each step from form to
    form, so the way to the root is logarithmic, and halved by each round.
    """
    spark = words.sparkSession
    words, _ = pinned(words.select("word", "n"), "words")
    pairs, _ = near_pairs(words)
    there = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("near_n"))
    back = pairs.select(F.col("v").alias("word"), F.col("u").alias("near"), F.col("nu").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    nearest = there.unionByName(back).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(nearest, "word", "left").withColumn("form_n", -F.col("best.less"))
    strong = F.col("form_n") >= ratio * F.col("n")
    told, _ = pinned(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"),
            F.when(strong, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    ways, path = pinned(told.filter("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = ways.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond")
        step, step_path = pinned(longer, "ways")
        moved = not step.filter("beyond is not null").isEmpty()
        remove(spark, path)
        ways, path = step.drop("beyond"), step_path
        if not moved:
            break
    ends = told.join(ways, "word", "left")
    return ends.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """Variants among the words of all texts, some of which lose a letter first (``slipped``).

    Null and empty texts have no words. Every occurrence counts, also in rows
    that repeat; rows of one key lose the same letters. A null key counts as
    empty text. Other columns play no part. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    found = runs(docs, key, text)
    return variants(vocabulary(found.select(slipped(F.col("key"), F.col("run"), slip).alias("word"))))
