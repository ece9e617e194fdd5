"""Removal of repeated passages by FM-index shards.

A window is a run of ``WINDOW`` words. The least hash among its ``SEED``-word runs
is the window's anchor; equal windows have equal anchors, so a window whose anchor
occurs once in the corpus can't repeat. Only the stretches around anchors that
occur more often go on: equal stretches are combined to their earliest place, and
the rest is dealt to shards by anchor. Each shard is indexed (suffix array,
Burrows-Wheeler transform, wavelet matrix), its stretches are streamed through the
index by backward search, and each window's earliest place is the least over its
suffix range. Windows that are their own earliest place stay; all other windows
of the stretches mark their words for removal.

An anchor with very many different stretches (the edge of a passage that many
documents share) would fill one shard: its windows are dealt one by one instead.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex, range_minima
from .shared import fresh, mix64, pinned, remove, rolled, span_hashes, text_batches, utf8_chunks, word_spans

WINDOW, SEED = 20, 8
#: Stretches of one anchor beyond which its windows are dealt one by one.
STRETCHES = 1000
#: Words per index shard.
SHARD_WORDS = 400_000
_PART = "array<struct<seed:bigint,start:int,windows:int,words:binary>>"


def anchors(words: np.ndarray, counts: np.ndarray, window: int, seed: int):
    """Windows grouped by anchor: anchor hash, text, first window in the text, number of windows."""
    empty = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(words) < window:
        return empty
    h = rolled(words, seed)
    span = window - seed + 1
    # Place of the leftmost least hash among ``span`` runs, by doubling.
    at, width = np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        width += step
    texts = np.repeat(np.arange(len(counts)), counts)
    valid = np.flatnonzero(texts[: len(at)] == texts[window - 1 : window - 1 + len(at)])
    if not len(valid):
        return empty
    anchor, owner = at[valid], texts[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(valid)))
    begins = np.cumsum(counts) - counts
    text = owner[first]
    return h[anchor[first]], text, valid[first] - begins[text], sizes


def _seeds(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """``rid, held``: the distinct anchors of each document, each with how often it holds them."""

    def run(batches):
        for batch in batches:
            rids = np.asarray(batch.column("rid"))
            for at, data, offsets in utf8_chunks(batch.column("text")):
                starts, ends, counts = word_spans(data, offsets)
                h, text, _, _ = anchors(span_hashes(data, starts, ends), counts, window, seed)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h))).astype(np.int32)
                bounds = np.searchsorted(text[first], np.arange(len(counts) + 1)).astype(np.int32)
                held = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n)], names=["seed", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[at : at + len(counts)]), pa.ListArray.from_arrays(pa.array(bounds), held)],
                    names=["rid", "held"],
                )

    return rows.select("rid", "text").mapInArrow(run, "rid long, held array<struct<seed:bigint,n:int>>")


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _stretches(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """Per document its words; with repeated anchors (``seeds``) its text and stretches, else its digest."""

    def run(batches):
        for batch in batches:
            rids, ids = batch.column("rid"), batch.column("key")
            wanted = batch.column("seeds")
            for at, data, offsets in utf8_chunks(batch.column("text")):
                size = len(offsets) - 1
                starts, ends, counts = word_spans(data, offsets)
                h, text, first, windows = anchors(span_hashes(data, starts, ends), counts, window, seed)
                lists = wanted.slice(at, size)
                known = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(size), lengths)
                joint = mix64(known ^ mix64(owner.astype(np.uint64)))
                hit = np.flatnonzero(np.isin(mix64(h ^ mix64(text.astype(np.uint64))), joint))
                by_text = np.searchsorted(text[hit], np.arange(size + 1))
                raw, texts, digests, pieces = data.tobytes(), [], [], []
                for i in range(size):
                    own = hit[by_text[i] : by_text[i + 1]]
                    whole = raw[offsets[i] : offsets[i + 1]]
                    if not len(own):
                        texts.append(None)
                        digests.append(_digest(whole.split()))
                        continue
                    texts.append(whole)
                    digests.append(None)
                    words = whole.split()
                    plain = b" ".join(words)
                    ends_at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    begins_at = np.append(0, ends_at)
                    low, high = begins_at[first[own]], ends_at[first[own] + windows[own] + window - 2] - 1
                    pieces.extend(plain[x:y] for x, y in zip(low.tolist(), high.tolist()))
                part = pa.StructArray.from_arrays(
                    [
                        pa.array(h[hit].view(np.int64)), pa.array(first[hit].astype(np.int32)),
                        pa.array(windows[hit].astype(np.int32)), pa.array(pieces, pa.binary()),
                    ],
                    names=["seed", "start", "windows", "words"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        rids.slice(at, size), ids.slice(at, size), pa.array(counts), pa.array(digests, pa.string()),
                        pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(by_text.astype(np.int32)), part),
                    ],
                    names=["rid", "key", "n_words", "digest", "text", "parts"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, key {kind}, n_words long, digest string, text binary, parts {_PART}")


def first_windows(words: list[bytes], windows: np.ndarray, place: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """For each stretch the bits of its windows that are the earliest of their words in this shard.

    ``place`` orders the documents (equal: the same document), ``start`` is the
    stretch's first word in its document.
    """
    lengths = windows + window - 1
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    begins, ends, _ = word_spans(data, np.array([0, len(data)]))
    _, ids = np.unique(span_hashes(data, begins, ends), return_inverse=True)
    slots = lengths + 1
    at = np.cumsum(slots) - slots
    symbols = np.zeros(int(slots.sum()), dtype=np.int64)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols[np.repeat(at, lengths) + within] = ids + 1
    index = FMIndex(symbols)

    # Place of every symbol of the text in the order of documents and positions.
    inside = np.arange(len(symbols)) - np.repeat(at, slots)
    order = np.repeat(place, slots) * (int(start.max()) + int(slots.max()) + 1) + np.repeat(start, slots) + inside

    stretch = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    patterns = at[stretch] + nth
    lo, hi = index.search(patterns, window)
    earliest = range_minima(order[index.order], lo, hi)
    first = (earliest == order[patterns]) | (hi - lo == 1)
    bits = np.zeros(len(windows), dtype=np.int64)
    np.bitwise_or.at(bits, stretch[first], np.int64(1) << nth[first])
    return bits


def _kept(parts: DataFrame, window: int) -> DataFrame:
    """``rid, key, start, bits`` of the windows that stay, from distinct stretches dealt by ``shard``."""
    kind = parts.schema["key"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owners = pdf[["key", "rid"]].drop_duplicates().sort_values(["key", "rid"], na_position="last")
        owners = owners.assign(_place=np.arange(len(owners)))
        pdf = pdf.merge(owners, on=["key", "rid"], how="left")
        bits = first_windows(
            [bytes(x) for x in pdf["words"]], pdf["windows"].to_numpy().astype(np.int64), pdf["_place"].to_numpy(),
            pdf["start"].to_numpy().astype(np.int64), window,
        )
        return pdf.assign(bits=bits).loc[bits != 0, ["rid", "key", "start", "bits"]]

    return parts.groupBy("shard").applyInPandas(run, f"rid long, key {kind}, start int, bits long")


def _earliest(parts: DataFrame) -> DataFrame:
    """Equal stretches of one anchor at their earliest place."""
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "rid", "start")).alias("place")
    grouped = parts.groupBy("seed", "words", "windows").agg(first)
    return grouped.select("seed", "words", "windows", "place.key", "place.rid", "place.start")


def _cut(stretch: DataFrame, window: int) -> DataFrame:
    """Every window of a stretch as a stretch of its own, under the hash of its words."""
    w = F.split(F.col("words").cast("string"), " ")
    each = F.transform(
        F.sequence(F.lit(0), F.col("windows") - 1),
        lambda i: F.struct(
            (F.col("start") + i).alias("start"),
            F.concat_ws(" ", F.slice(w, i + 1, window)).cast("binary").alias("words"),
        ),
    )
    single = stretch.select("key", "rid", F.inline(each)).withColumn("windows", F.lit(1))
    return single.withColumn("seed", F.xxhash64("words"))


def _split(df: DataFrame, key: str, text: str, window: int, seed: int, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of documents without repeated anchors, and of those with; the latter with ``rid`` and their kept text if asked."""
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("key", "text"))
    seeds, seeds_path = pinned(_seeds(rows, window, seed), "seeds")
    seeds = seeds.select("rid", F.inline("held"))
    counted = seeds.groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed")
    repeated, repeated_path = pinned(counted, "anchors")
    lists = seeds.select("seed", "rid").join(repeated, "seed").groupBy("rid").agg(F.collect_set("seed").alias("seeds"))
    lists, lists_path = pinned(lists, "anchor-lists")
    remove(df.sparkSession, repeated_path)
    remove(df.sparkSession, seeds_path)

    found = rows.join(lists, "rid", "left").select("rid", "key", "text", "seeds")
    docs, _ = pinned(_stretches(found, window, seed), "stretches")
    remove(df.sparkSession, lists_path)

    every = docs.select("rid", "key", F.inline("parts"))
    parts, parts_path = pinned(_earliest(every), "distinct")
    crowded = parts.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > STRETCHES).select("seed")
    crowded, crowded_path = pinned(crowded, "crowded")
    single, single_path = pinned(_earliest(_cut(parts.join(crowded, "seed", "left_semi"), window)), "windows")
    dealt = parts.join(crowded, "seed", "left_anti").unionByName(single)
    words = dealt.agg(F.sum(F.col("windows") + window - 1).alias("n")).first().n or 0
    shards = max(1, -(-words // SHARD_WORDS))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards)))
    kept = _kept(dealt, window).groupBy("rid", "key").agg(F.collect_list(F.struct("start", "bits")).alias("kept"))
    kept, _ = pinned(kept, "kept")
    for path in (parts_path, crowded_path, single_path):
        remove(df.sparkSession, path)

    same = (F.col("rid") == F.col("rid_k")) & F.col("key").eqNullSafe(F.col("key_k"))
    kept = kept.withColumnsRenamed({"rid": "rid_k", "key": "key_k"})
    ranges = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["windows"].alias("windows")))
    hit = docs.filter("text is not null").select("rid", "key", "n_words", "text", ranges.alias("parts"))
    hit = hit.join(kept, same, "left").select("rid", "key", "n_words", "text", "parts", "kept")
    cut = _without(hit, window, keep_text)
    whole = docs.filter("text is null").select(
        "key", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256")
    )
    return whole, cut


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` (of the kept words joined by one blank), a row per row.

    A word is removed if a window over it has the same words as a window that
    starts earlier: in a document of smaller key, or before it in its own. Null
    keys come last. Rows that share a key are ordered by the hash of key and text;
    rows equal in both are one document and get the same result. Null text has no
    words; texts shorter than a window lose nothing. Other columns don't matter.
    """
    whole, cut = _split(df, key, text, window, seed, False)
    return whole.unionByName(cut.drop("rid")).withColumnRenamed("key", key)


def without_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """``df`` with the repeated words taken out of its texts, all rows kept.

    Texts that lose words become their kept words joined by one blank; the others
    stay as they are. The rule is that of ``remove_repeats``.
    """
    _, cut = _split(df, key, text, window, seed, True)
    rid, other, new = fresh(df, "rid", "other_key", "new_text")
    changed = cut.filter("n_removed > 0").groupBy("rid", "key").agg(F.first("kept_text").alias(new))
    changed = changed.withColumnsRenamed({"rid": f"{rid}_c", "key": other})
    marked = df.withColumn(rid, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))))
    same = (F.col(rid) == F.col(f"{rid}_c")) & F.col(key).eqNullSafe(F.col(other))
    return marked.join(changed, same, "left").withColumn(text, F.coalesce(new, text)).select(*df.columns)


def _flat(lists: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start``, field ``name`` and row of every entry of a column of lists; null: none."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", name))
    return (*values, np.repeat(np.arange(len(lists)), lengths))


def _without(hit: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Texts without the words of the windows that go."""
    kind = hit.schema["key"].dataType.simpleString()
    schema = f"rid long, key {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def run(batches):
        for batch in batches:
            size = len(batch)
            sizes = batch.column("n_words").to_numpy(zero_copy_only=False)
            base = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            gone = np.zeros(total, dtype=bool)
            start, n, owner = _flat(batch.column("parts"), "windows")
            gone[np.repeat(base[owner] + start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = True
            start, bits, owner = _flat(batch.column("kept"), "bits")
            for j in range(window):
                stays = (bits >> j) & 1 == 1
                gone[(base[owner] + start)[stays] + j] = False
            # A window ends before its document does, so no sum crosses a border.
            cover = np.zeros(total + window + 1, dtype=np.int64)
            at = np.flatnonzero(gone)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            keep = (np.cumsum(cover)[:total] == 0).tolist()
            removed, digests, texts = np.zeros(size, dtype=np.int64), [], []
            for i, text in enumerate(batch.column("text")):
                words = text.as_py().split()
                rest = list(compress(words, keep[base[i] : base[i] + len(words)]))
                removed[i] = len(words) - len(rest)
                digests.append(_digest(rest))
                if keep_text:
                    texts.append(b" ".join(rest).decode("utf-8", "replace"))
            columns = [batch.column(c) for c in ("rid", "key", "n_words")]
            columns += [pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["rid", "key", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return hit.mapInArrow(run, schema)
