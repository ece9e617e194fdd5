"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document's expected number of copies is
target over source size. The whole part is taken outright. The fractions are
rounded dependently: two documents are paired and words of expected mass move
from one to the other, in a random direction that leaves both expectations as
they were, until one fraction is 0 or 1. Since mass moves in words, the words of
the source don't change. Each block of a source ends with at most one document
still fractional; these residuals meet in ever fewer blocks, up a tree, until a
source has one left, which goes to the nearer whole number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import global_row_number
from .shared import fresh, pinned, word_count

#: Rows of one block, and residuals that meet in one block of the next level.
BLOCK_ROWS = 4096
CYCLE = (5, 2, 1)
MOST_COPIES = 3


def pair_off(size: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int | None]:
    """Round ``share`` (expected copies, 0 to 1) pair by pair; the place of the one left fractional, if any.

    The expectation of every share is unchanged, and so is the sum of size times share.
    """
    out = share.astype(np.float64).copy()
    draws = rng.random(len(out))
    held = None
    for j in range(len(out)):
        if out[j] <= 0.0 or out[j] >= 1.0:
            continue
        if held is None:
            held = j
            continue
        i = held
        a, b = size[i] * out[i], size[j] * out[j]
        room_i, room_j = size[i] - a, size[j] - b
        to_i, to_j = min(room_i, b), min(room_j, a)
        if draws[j] * (to_i + to_j) < to_j:  # probability of the move to i
            fills, out[i], out[j] = room_i <= b, (a + to_i) / size[i], (b - to_i) / size[j]
            done, held = (i, j) if fills else (j, i)
            out[done] = 1.0 if fills else 0.0
        else:
            fills, out[i], out[j] = room_j <= a, (a - to_j) / size[i], (b + to_j) / size[j]
            done, held = (j, i) if fills else (i, j)
            out[done] = 1.0 if fills else 0.0
        if not 1e-9 < out[held] < 1 - 1e-9:
            out[held] = round(out[held])
            held = None
    return out, held


def source_targets(sized: DataFrame, most: float = MOST_COPIES, cycle=CYCLE, share: float = 1.0) -> DataFrame:
    """``source, source_size, n, target`` from rows of ``source, size``.

    Sources in code point order, null last, weigh as ``cycle`` repeats. They share
    ``share`` of all words by weight, none above ``most`` times its size: the level is
    found by rounds of sums over all sources, each of which stops more of them.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = global_row_number(sums, [F.col("source").asc_nulls_last()], "_place")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    place = F.pmod(F.col("_place") - 1, F.lit(len(cycle))).cast("int") + 1
    weighed, _ = pinned(placed.withColumn("_weight", F.element_at(weights, place)).drop("_place"), "sources")
    whole = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    total, ceiling = share * float(whole[0] or 0), F.col("source_size").cast("double") * F.lit(float(most))
    left, weight, stopped = total, whole[1] or 0.0, 0
    while True:
        free = F.lit(left) * F.col("_weight") / F.lit(weight) if weight else F.lit(0.0)
        over = free > ceiling if weight else F.lit(True)
        row = weighed.agg(
            F.sum(F.when(over, ceiling)), F.sum(F.when(~over, F.col("_weight"))), F.count_if(over)
        ).first()
        if row[2] == stopped:
            return weighed.withColumn("target", F.when(over, ceiling).otherwise(free)).drop("_weight")
        left, weight, stopped = total - row[0], row[1] or 0.0, row[2]


def mix(
    df: DataFrame, source: str = "source", size: Column | None = None, text: str = "text",
    keys: tuple[str, ...] = ("doc_id",), seed: int = 7, most: int = MOST_COPIES, cycle=CYCLE, share: float = 1.0,
) -> DataFrame:
    """``keys``, size, source, source_size, target, copies and taken, one row per row of ``df``.

    ``share``: words of the mix over words of the input. Random numbers follow
    from ``seed``, source and keys, so reruns agree; rows equal in keys and size
    get the same numbers of copies in some order. Empty documents take the
    nearest whole number of copies and no words; a source without words has
    target 0. Null sources are one source, the last; null text has size 0.
    """
    size = word_count(F.col(text)) if size is None else size
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    sized, _ = pinned(df.select(*named, F.col(source).cast("string").alias("source"), size.alias("size")), "sizes")
    goals, _ = pinned(
        source_targets(sized, most, cycle, share).select(
            F.col("source").alias("_source"), "source_size", "target", F.ceil(F.col("n") / BLOCK_ROWS).alias("_blocks")
        ),
        "targets",
    )
    key_columns = [f"_key{i}" for i in range(len(keys))]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sized.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_rate", F.least(rate, F.lit(float(most))))
        .withColumn("_whole", F.floor("_rate"))
        .withColumn("_part", F.col("_rate") - F.col("_whole"))
    )
    settled = (F.col("size") == 0) | (F.col("_part") <= 1e-9) | (F.col("_part") >= 1 - 1e-9)
    plain = rows.filter(settled).withColumn("_part", F.round("_part"))
    hashed = F.xxhash64(*key_columns, "size", F.lit(seed))
    open_rows = rows.filter(~settled).withColumn("_block", F.pmod(hashed, F.col("_blocks")))

    schema = T.StructType([*rows.schema.fields, T.StructField("_block", T.LongType()), T.StructField("_left", T.BooleanType())])

    def rounding(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            order = pdf[key_columns].astype("string").fillna("")
            order = order.assign(_size=-pdf["size"])
            pdf = pdf.loc[order.sort_values(["_size", *key_columns], kind="stable").index]
            name = pdf["source"].iloc[0]
            name = -1 if pd.isna(name) else zlib.crc32(name.encode())
            rng = np.random.default_rng([seed, level, name + 1, int(pdf["_block"].iloc[0])])
            part, left = pair_off(pdf["size"].to_numpy(), pdf["_part"].to_numpy(), rng)
            flags = np.zeros(len(pdf), dtype=bool)
            if left is not None:
                flags[left] = True
            return pdf.assign(_part=part, _left=flags)[schema.names]

        return run

    done, level = [plain.drop("_rate", "_blocks")], 0
    while True:
        grouped = open_rows.groupBy("source", "_block")
        level_rows, _ = pinned(grouped.applyInPandas(rounding(level), schema), f"mix-{level}")
        done.append(level_rows.filter(~F.col("_left")).drop("_rate", "_blocks", "_block", "_left"))
        rest = level_rows.filter("_left").drop("_left")
        most_left = rest.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most_left <= 1:
            done.append(rest.withColumn("_part", F.round("_part")).drop("_rate", "_blocks", "_block"))
            break
        level += 1
        open_rows = rest.withColumn("_block", F.floor(F.col("_block") / BLOCK_ROWS))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("_whole") + F.col("_part")).cast("long")
    return out.select(
        *[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], "size", "source", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (not at all: gone).

    Rows equal in key and text are one document that occurs several times: their
    copies are added up and given to one of the rows. The join is on key and text
    hash, so other columns may be anything.
    """
    digest, joint, copies = fresh(docs, "text_hash", "joint_key", "joint_copies")
    marked = docs.withColumns({digest: F.xxhash64(text), joint: F.col(key)})
    taken = mix(marked, text=text, keys=(joint, digest), **options)
    total = taken.groupBy(joint, digest).agg(F.sum("copies").alias(copies), F.count("*").alias("rows"))
    total = total.withColumnsRenamed({joint: f"{joint}_r", digest: f"{digest}_r", "rows": f"{copies}_rows"})
    match = F.col(joint).eqNullSafe(F.col(f"{joint}_r")) & (F.col(digest) == F.col(f"{digest}_r"))
    found = marked.join(total.filter(F.col(copies) > 0), match)
    alone = found.filter(F.col(f"{copies}_rows") == 1)
    several = found.filter(F.col(f"{copies}_rows") > 1).dropDuplicates([joint, digest])
    every = alone.unionByName(several)
    times = F.sequence(F.lit(1).cast("long"), F.col(copies))
    return every.withColumn(copies, F.explode(times)).select(*docs.columns)
