"""Best-fit packing under conflicts.

Documents fill bins of a fixed number of words. No bin holds two documents of
one source, or two of one duplicate cluster. Within a shard, documents come in
order of falling size; bins are kept in order of their residual room, and each
carries a bitmap of its sources and one of its clusters. The search starts at
the first bin with room enough and goes on to the next until both bitmaps allow
the document: that is the tightest compatible bin. If there is none, a new bin
opens.

Shards are dealt by hash, so no source, cluster or text gathers in one task, and
hold about ``shard_rows`` rows at every input size. Bins never cross shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import word_count

CAPACITY = 2048
SHARD_ROWS = 4000


def best_fit(sizes, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, items in falling order of size.

    ``sources`` and ``clusters`` may hold None, which conflicts with nothing.
    """
    bits: dict = {}

    def bit(kind: str, value) -> int:
        return 0 if value is None else 1 << bits.setdefault((kind, value), len(bits))

    rooms: list[tuple[int, int]] = []  # (residual room, bin), ascending
    source_map: list[int] = []
    cluster_map: list[int] = []
    bins, offsets = [], []
    # A cluster or source with one item can't conflict and needs no bit.
    seen: dict = {}
    for kind, values in (("s", sources), ("c", clusters)):
        for v in values:
            seen[kind, v] = seen.get((kind, v), 0) + 1
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit = bit("s", source) if seen["s", source] > 1 else 0
        cluster_bit = bit("c", cluster) if seen["c", cluster] > 1 else 0
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms):
            b = rooms[at][1]
            if not (source_map[b] & source_bit or cluster_map[b] & cluster_bit):
                break
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        source_map[b] |= source_bit
        cluster_map[b] |= cluster_bit
        bins.append(b)
        offsets.append(capacity - room)
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets


def pack(
    df: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source",
    cluster: Column | None = None, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``key, piece, n_words, source, cluster, bin_id, bin_offset``: where each piece of each document lies.

    Documents longer than a bin are cut: each full piece (numbered from 0) is a
    bin of its own, the rest is packed like any other document. ``cluster``
    defaults to the hash of the words in lower case; documents without words, or
    with null text, have size 0, no cluster, and one piece. Null sources conflict
    with nothing. Rows that repeat a key and text are copies of one cluster, so
    they go to different bins. ``bin_id`` is shard and number within it as text.
    """
    words = F.coalesce(F.col(text), F.lit(""))
    if cluster is None:
        plain = F.trim(F.regexp_replace(F.lower(words), "[\\x20\\x09-\\x0D]+", " "))
        cluster = F.when(plain != "", F.xxhash64(plain))
    rows = df.select(
        F.col(key).alias(key),
        F.col(source).cast("string").alias("source"),
        cluster.cast("string").alias("cluster"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(key), F.col(text)).alias("hash"),
    )
    total = df.count()
    shards = max(1, -(-total // shard_rows))
    full = F.floor(F.col("size") / capacity)
    rows = rows.withColumn("full", full).withColumn("rest", F.col("size") - full * capacity)
    tail = F.when((F.col("rest") > 0) | (F.col("size") == 0), F.array(F.struct(F.col("full").alias("piece"), F.col("rest").alias("n_words"))))
    whole = F.when(
        F.col("full") > 0,
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("full") - 1),
            lambda i: F.struct(i.alias("piece"), F.lit(capacity).cast("long").alias("n_words")),
        ),
    )
    empty = F.array().cast("array<struct<piece:bigint,n_words:bigint>>")
    pieces = F.concat(F.coalesce(whole, empty), F.coalesce(tail, empty))
    rows = rows.withColumn("shard", F.pmod("hash", F.lit(shards)))
    rows = rows.select(key, "source", "cluster", "hash", "shard", F.inline(pieces))

    key_type = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {key_type}, piece long, n_words long, source string, cluster string, bin_id string, bin_offset long"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.assign(_size=-pdf["n_words"]).sort_values(["_size", "hash", "piece"], kind="stable").index
        pdf = pdf.loc[order].reset_index(drop=True)
        plain = {c: [None if pd.isna(v) else v for v in pdf[c]] for c in ("source", "cluster")}
        bins, offsets = best_fit(pdf["n_words"].tolist(), plain["source"], plain["cluster"], capacity)
        shard = int(pdf["shard"].iloc[0])
        return pdf.assign(bin_id=[f"{shard}-{b}" for b in bins], bin_offset=offsets)[
            [key, "piece", "n_words", "source", "cluster", "bin_id", "bin_offset"]
        ]

    return rows.groupBy("shard").applyInPandas(run, schema)
